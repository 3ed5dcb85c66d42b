import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noticeworks.llm import queries, token_blocks

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "B", "a,", "é.", "é!", ",", "é", "ß", "中", "😀", "1", "23", ".", ",", "'s", "'ll", "-", "_", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", " ", "　", "\x1c", "\x00", "​", "﻿", "<|endoftext|>", " <|endoftext|>", "the", " the"]


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_library():
    rng = random.Random(2)
    texts = [None, "", " ", "\n", " a", "a ", "a\n", "\na", "a \nb", "a\n b", "x " * 3000] + ["".join(rng.choices(ODD, k=rng.randint(1, 12))) for _ in range(6000)]
    for pieces in (50, 500_000):
        got = [x.tolist() for x in token_blocks.Encoder(PATH, pieces).encode(texts, chars=5000)]
        assert got == library(texts)


def test_long_texts_are_encoded_in_parts():
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD[:-4], k=400)) for _ in range(60)]
    encoder = token_blocks.Encoder(PATH)
    for encoder.PART in (1, 17, 100):
        assert [x.tolist() for x in encoder.encode(texts)] == library(texts)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some words, and  MORE\nlines", "", None, "a" * 100]
    encoder = token_blocks.Encoder(path)
    assert not encoder.apart
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("at_once", [1, 2, 256])
def test_document_sums(monkeypatch, at_once):
    monkeypatch.setattr(token_blocks, "AT_ONCE", at_once)
    rng = np.random.default_rng(at_once)
    for sizes in ([], [0], [3], [1, 0, 2500, 0, 7, 1024, 1], [0, 0]):
        docs = [rng.integers(0, 50_257, n).astype("<u4") for n in sizes]
        lengths, sums = token_blocks.document_sums(token_blocks.encode_shard(docs, block=64))
        assert lengths.tolist() == sizes and sums == [zlib.crc32(d.tobytes()) for d in docs]


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_shard_round_trip(block):
    rng = np.random.default_rng(block)
    cases = [[], [np.zeros(0, "<u4")], [np.array([7], "<u4")] * 3, [np.array([0, 2**32 - 1, 5, 5], "<u4")], [rng.integers(0, 50_257, n).astype("<u4") for n in (0, 1, 1023, 1024, 1025, 5000)], [np.where(rng.random(4000) < 0.02, rng.integers(0, 2**32, 4000), rng.integers(90, 99, 4000)).astype("<u4")]]
    for docs in cases:
        body = token_blocks.encode_shard(docs, block=block)
        assert [d.tolist() for d in token_blocks.decode_shard(body)] == [d.tolist() for d in docs]
        whole, n = np.concatenate([np.zeros(0, "<u4"), *docs]), -(-sum(map(len, docs)) // block)
        for first in range(0, n, max(1, n // 5)):
            assert token_blocks.decode_blocks(body, first, first + 1).tolist() == whole[first * block : (first + 1) * block].tolist()


def test_outliers_are_patched():
    ids = np.full(100_000, 1000, "<u4")
    ids[::100] = 2**31
    assert len(token_blocks.encode_shard([ids])) < 15_000


def brute(rows):
    out, start = [], 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (doc_id, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op5_token_id_blocks(spark, sf).collect())) == brute(rows)


def test_edge_rows(spark):
    rows = [(5, None), (5, ""), (-3, "b"), (9, "a b " * 20_000), (7, "same"), (7, "same"), (None, "x"), (2**62, "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as body", "3 as start")
    got = sorted((tuple(r)[3:] for r in token_blocks.token_output(df.repartition(3), PATH, shard_tokens=100).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    assert token_blocks.token_output(df.limit(0), PATH).collect() == []
