"""Token ids in binary shards of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id, each partition encodes its texts and cuts them into shards of
whole documents. A shard is one binary value with its own layout (little-endian):

    header       magic "PFB1", block length u32, documents u32, tokens u64, blocks u32
    documents    tokens of each document, u32
    block index  where each block starts within the block area, u64
    blocks       minimum u32, width u8, exceptions u16, ids less the minimum packed at width bits,
                 positions of the exceptions u16, values of the exceptions u32 (again less the minimum)

A block's width is that of a percentile of its values above the minimum; what needs more bits is an exception.
Shards are rows of a Parquet table beside the partition and the place within it, so that Spark's own committer
writes them, any store that Spark reaches can hold them, and a lost executor's shards are written again.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import each, resident, scratch_root

MAGIC, HEADER, BLOCK_HEADER = b"PFB1", struct.Struct("<4sIIQI"), struct.Struct("<IBH")
BLOCK, PERCENTILE, SHARD_TOKENS = 1024, 90, 1_000_000
#: Blocks that are packed or unpacked at a time.
AT_ONCE = 256
ID = attrgetter("id")
SHARDS = "part int, seq int, doc_ids array<long>, n_tokens long, body binary"
DOCUMENTS = "part int, seq int, place int, doc_id long, before long, n_tokens long, ids_crc32 long"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values as rows of bytes, width bits each."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(*values.shape, 4), axis=2, bitorder="little", count=width)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, bitorder="little", count=width * count).reshape(len(packed), count, width)
    full = np.zeros((len(packed), count, 32), dtype=np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=2, bitorder="little").view("<u4").reshape(len(packed), count)


def _encode_blocks(ids: np.ndarray, block: int, percentile: float) -> list[bytes]:
    """The blocks of these ids, the last of which may be short."""
    blocks = -(-len(ids) // block)
    rows = np.zeros((blocks, block), dtype="<u4")
    rows.ravel()[: len(ids)] = ids
    rows[-1, len(ids) - (blocks - 1) * block :] = ids[-1]  # what fills the last block adds nothing to its range
    least = rows.min(axis=1)
    above = rows - least[:, None]
    at = int((block - 1) * percentile / 100)
    widths = np.array([int(k).bit_length() for k in np.partition(above, at, axis=1)[:, at]], dtype=np.int64)
    outlier = above >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    packed: list[bytes] = [b""] * blocks
    kept = np.where(outlier, np.uint32(0), above)
    for w in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == w)
        for i, row in zip(at, _pack(kept[at], int(w)), strict=True):
            packed[i] = row.tobytes()
    bodies = []
    for i in range(blocks):
        where = np.flatnonzero(outlier[i])
        bodies.append(BLOCK_HEADER.pack(int(least[i]), int(widths[i]), len(where)) + packed[i] + where.astype("<u2").tobytes() + above[i][where].astype("<u4").tobytes())
    return bodies


def encode_shard(documents: list[np.ndarray], block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The shard of these documents' ids (unsigned 32-bit), packed some blocks at a time."""
    lengths = np.array([len(d) for d in documents], dtype="<u4")
    ids = np.concatenate([np.zeros(0, "<u4"), *documents]).astype("<u4", copy=False)
    bodies: list[bytes] = []
    for first in range(0, len(ids), AT_ONCE * block):
        bodies += _encode_blocks(ids[first : first + AT_ONCE * block], block, percentile)
    starts = np.cumsum([0, *map(len, bodies)])[:-1].astype("<u8")
    return b"".join([HEADER.pack(MAGIC, block, len(documents), len(ids), len(bodies)), lengths.tobytes(), starts.tobytes(), *bodies])


def decode_blocks(body: bytes, first: int, last: int) -> np.ndarray:
    """The ids of blocks first to last - 1, found through the index without reading those before."""
    magic, block, documents, tokens, blocks = HEADER.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a shard")
    index = HEADER.size + 4 * documents
    area = index + 8 * blocks
    starts = np.frombuffer(body, "<u8", blocks, index)[first:last].astype(np.int64) + area
    heads = [BLOCK_HEADER.unpack_from(body, s) for s in starts.tolist()]
    rows = np.zeros((len(heads), block), dtype="<u4")
    widths = np.array([h[1] for h in heads], dtype=np.int64)
    raw = np.frombuffer(body, np.uint8)
    for w in np.unique(widths[widths > 0]):
        at, size = np.flatnonzero(widths == w), -(-int(w) * block // 8)
        rows[at] = _unpack(raw[(starts[at] + BLOCK_HEADER.size)[:, None] + np.arange(size)], int(w), block)
    for i, (least, width, n) in enumerate(heads):
        if n:
            p = int(starts[i]) + BLOCK_HEADER.size + -(-width * block // 8)
            rows[i][np.frombuffer(body, "<u2", n, p)] = np.frombuffer(body, "<u4", n, p + 2 * n)
        rows[i] += np.uint32(least)
    return rows.ravel()[: max(0, min(tokens, last * block) - first * block)]


def document_sums(body: bytes) -> tuple[np.ndarray, list[int]]:
    """Every document's number of ids and their crc32, decoded some blocks at a time."""
    _, block, documents, tokens, blocks = HEADER.unpack_from(body)
    lengths = np.frombuffer(body, "<u4", documents, HEADER.size).astype(np.int64)
    ends, sums, doc, done = np.cumsum(lengths).tolist(), [0] * documents, 0, 0
    for first in range(0, blocks, AT_ONCE):
        ids = memoryview(np.ascontiguousarray(decode_blocks(body, first, first + AT_ONCE)).view(np.uint8))
        until = done + len(ids) // 4
        while doc < documents:
            stop = min(ends[doc], until)
            sums[doc] = zlib.crc32(ids[4 * (max(done, ends[doc] - int(lengths[doc])) - done) : 4 * (stop - done)], sums[doc])
            if ends[doc] > until:
                break
            doc += 1
        done = until
    return lengths, sums


def decode_shard(body: bytes) -> list[np.ndarray]:
    """Every document's ids."""
    _, _, documents, _, blocks = HEADER.unpack_from(body)
    lengths = np.frombuffer(body, "<u4", documents, HEADER.size).astype(np.int64)
    return np.split(decode_blocks(body, 0, blocks), np.cumsum(lengths)[:-1]) if documents else []


class Encoder:
    """Whole texts to ids as the tokenizers library gives them, with a bounded memory of pieces already encoded.

    The byte-level pre-tokenizer's pieces begin at a space that a non-space follows and nothing non-blank ends in
    a blank, so a text falls apart into independent pieces before each such space that doesn't follow a blank, and
    around a line feed between two non-blanks. Each piece is encoded by the library once. Texts that hold a special
    token's string go to the library whole, and so do all texts if the file's tokenizer is another than a plain
    byte-level BPE.
    """

    #: Unicode white space, and what only Python takes for it: no cuts next to these.
    BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    #: Characters of a text that are taken apart at a time, and of the longest piece that is remembered.
    PART, LONGEST = 1_000_000, 64

    def __init__(self, path: str, pieces: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = self._falls_apart()
        if not self.apart:
            return
        self.pieces, self.spaced, self.bare = pieces, {}, {"": b""}
        bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: bytes_of(chr(c))[0][0] for c in range(256) if chr(c).isalpha()}
        self.space = bytes_of(" ")[0][0]
        self.line_feed = self._ids(["\n"])[0]
        self.marks = dict(zip(",.!?;:", self._ids(list(",.!?;:")), strict=True))
        self.cut = re.compile(f"(?<![{self.BLANKS}]) (?![{self.BLANKS}]|$)")
        self.odd = re.compile(f"[{self.BLANKS.replace(' ', '', 1).replace(chr(10), '', 1)}]")

    def _falls_apart(self) -> bool:
        """Whether the file has the pre-tokenizer and model that the cuts are made for."""
        made = json.loads(self.tokenizer.to_str())
        model, before = made["model"], made["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "ignore_merges"))
        level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        return plain and level and not made["normalizer"] and not made["truncation"] and not made["padding"]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _pieces_ids(self, prefix: str, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Of pieces that are one run of Latin letters to the pre-tokenizer, by the library's model alone."""
        tokenize, first, others = self.tokenizer.model.tokenize, self.space if prefix else "", []
        for p in pieces:
            if p.isalpha() and (p.isascii() or max(p) <= "ÿ"):
                yield p, array("I", map(ID, tokenize(first + (p if p.isascii() else p.translate(self.letters))))).tobytes()
            else:
                others.append(p)
        yield from zip(others, self._ids([prefix + p for p in others]), strict=True)

    def _split(self, text: str) -> list[tuple[str, list[str]]]:
        """Lines, each as its first piece and those after a space."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in ("\n", " ") or text[-1:] in ("\n", " ") or self.odd.search(text):
            lines = [self.cut.split(text)]
        else:
            lines = [line.split(" ") for line in text.split("\n")]
        return [(line[0], line[1:]) for line in lines]

    def _parts(self, text: str) -> Iterator[str]:
        """A text in parts of bounded length, cut before a space; those after the first begin with it."""
        start = 0
        while len(text) - start > self.PART and (at := self.cut.search(text, start + self.PART)):
            yield text[start : at.start()]
            start = at.start()
        yield text[start:]

    def _learn(self, known: dict, prefix: str, found: set[str]) -> set[str]:
        """Encodes pieces that aren't known; returns those to forget again: long ones, and what the memory has no room for."""
        new = found.difference(known)
        # A letter and a mark after it are always two pieces to the pre-tokenizer.
        marked = {p for p in new if p[-1:] in self.marks and p[-2:-1] <= "ÿ" and p[-2:-1].isalpha()}
        stems = (new - marked).union({p[:-1] for p in marked}.difference(known))
        room = self.pieces - len(known)
        known.update(self._pieces_ids(prefix, list(stems)))
        known.update([(p, known[p[:-1]] + self.marks[p[-1]]) for p in marked])
        new |= stems
        return new if len(new) > room else {p for p in new if len(p) > self.LONGEST}

    def encode(self, texts: Iterable[str | None], chars: int = 2_000_000) -> Iterator[np.ndarray]:
        """Each text's ids, null as the empty text; memory is for about so many characters at a time."""
        group, size = [], 0
        for t in texts:
            t = t or ""
            if not self.apart or any(s in t for s in self.special):
                yield from self._encode(group)
                yield np.frombuffer(self._ids([t])[0], "<u4")
                group, size = [], 0
            elif len(t) > 2 * self.PART:
                yield from self._encode(group)
                yield np.concatenate([ids for part in self._parts(t) for ids in self._encode([part])])
                group, size = [], 0
            else:
                group.append(t)
                size += len(t)
                if size >= chars:
                    yield from self._encode(group)
                    group, size = [], 0
        yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        split = [self._split(t) for t in texts]
        forget = (self._learn(self.spaced, " ", set().union(*[rest for lines in split for _, rest in lines])), self._learn(self.bare, "", {first for lines in split for first, _ in lines}))
        spaced, bare = self.spaced.__getitem__, self.bare
        for lines in split:
            yield np.frombuffer(self.line_feed.join([bare[first] + b"".join(map(spaced, rest)) for first, rest in lines]), "<u4")
        for known, pieces in zip((self.spaced, self.bare), forget, strict=True):
            for p in pieces:
                known.pop(p, None)


def _encoder(path: str) -> Encoder:
    return resident(("token blocks", path), lambda: Encoder(path))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of all texts, each with end_id appended, in ascending doc_id order (null ids first, equal ids by text)."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        size, end = 0, np.array([end_id], dtype="<u4")

        def shard() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([encode_shard(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_ids", "n_tokens", "body"])

        for batch in batches:  # only some of a batch's texts are Python objects at a time
            for doc_id, found in zip(each(batch["doc_id"]), encoder.encode(each(batch["text"])), strict=True):
                ids.append(np.concatenate((found, end)))
                names.append(doc_id)
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield shard()
                    ids, names, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, SHARDS).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, doc_id, start, n_tokens, ids_crc32 of every document in the shards at path, as decoded from them.

    start counts the ids of all documents before: those of earlier partitions, then of earlier shards of the
    partition, then of earlier documents of the shard. Only sums by shard and partition are put in order.
    """

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                lengths, sums = document_sums(r.body)
                names = pd.array([None if pd.isna(x) else int(x) for x in r.doc_ids], dtype="Int64")
                yield pd.DataFrame({"part": r.part, "seq": r.seq, "place": range(len(names)), "doc_id": names, "before": np.cumsum(lengths) - lengths, "n_tokens": lengths, "ids_crc32": sums})

    shards = spark.read.schema(SHARDS).parquet(path)
    sums = shards.select("part", "seq", "n_tokens")
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_start"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("seq_start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))
    found = shards.select("part", "seq", "doc_ids", "body").mapInPandas(documents, DOCUMENTS)
    return found.join(starts, ["part", "seq"]).select("part", "seq", "place", "doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes docs' shards to path (a new folder in the shared one if none is given) and reads their documents back.

    Null texts are empty and have the end id alone. Repeated rows are written each time, null ids first. An empty
    table gives an empty table of shards and an empty result. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    path = path or f"{scratch_root(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, end_id, shard_tokens)
    return read_documents(spark, path)
