import itertools
import random
import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_decontaminate import brute as windows
from test_decontaminate import grams
from test_mixing import brute as mixed_sizes
from test_simhash import brute_components
from test_token_blocks import brute as token_rows

from noticeworks.llm import simhash, toxicity


def sets(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) > width else {tuple(w)} - {()}


def brute_first(rows, guaranteed=3, blocks=5, radius=8):
    """Ids that stay of (id, text), comparing all pairs."""

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    def majorities(found):
        hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in sorted(found)], dtype=np.uint64)
        mixed = [simhash._mixed(hashes, k).tolist() for k in range(simhash.PRINTS)]
        return [sum((sum(h >> b & 1 for h in own) * 2 > len(own)) << b for b in range(64)) for own in mixed]

    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]

    def candidates(x):
        same = sum(x >> a & (1 << b - a) - 1 == 0 for a, b in itertools.pairwise(cuts))
        return same >= blocks - guaranteed and x.bit_count() <= radius

    prints = [(d, words(t), majorities(set(words(t))), sets(t)) for d, t in rows]
    pairs = []
    for i, (a, wa, fa, sa) in enumerate(prints):
        for b, wb, fb, sb in prints[i:]:
            if wa == wb or any(candidates(x ^ y) for x, y in zip(fa, fb, strict=True)) and len(sa & sb) / len(sa | sb) >= 0.8:
                pairs.append((a, b))
    least = brute_components(pairs)
    return sorted({least[d] for d, *_ in prints})


def test_stages_equal_brute_force(spark, sf_small):
    documents = spark.read.parquet(f"{sf_small}/documents.parquet")
    names, functions = zip(*corpus_pipeline.STAGES, strict=True)
    assert len(names) == 5

    def step(k, docs):
        out = functions[k](spark, docs, sf_small)
        if k < 4:
            assert out.columns == documents.columns
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema).coalesce(2), rows

    before = documents.collect()
    docs, clean = step(0, documents)
    model = toxicity.fit(documents, spark.read.parquet(f"{sf_small}/labels.parquet"))
    scores = {r.doc_id: r.s for r in documents.select("doc_id", toxicity.score_column(F.col("text"), model).alias("s")).collect()}
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in before if scores[r.doc_id] < 0.3)

    docs, first = step(1, docs)
    assert sorted(r.doc_id for r in first) == brute_first([(r.doc_id, r.text) for r in clean])

    docs, apart = step(2, docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    runs = {g for _, t in items for g in grams(t.lower().split())}
    assert sorted(r.doc_id for r in apart) == sorted(r.doc_id for r in first if not (runs & grams(r.text.lower().split()).keys() and windows(r.text, items)))

    docs, mixed = step(3, docs)
    took = {}
    for r in mixed:
        took[r.doc_id] = took.get(r.doc_id, 0) + len(r.text.split())
    assert took == {d: n for d, _, _, _, n in mixed_sizes([(r.doc_id, r.source, r.text) for r in apart]) if n}

    _, written = step(4, docs)
    assert sorted(map(tuple, written), key=lambda r: r[1]) == token_rows([(r.doc_id, r.text) for r in mixed])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_small).collect())) == sorted(map(tuple, written))


def test_keep_first_edge_rows(spark):
    base = [f"w{i}" for i in range(300)]
    near = [*base[:150], "changed", *base[151:]]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(base).upper()), (7, None), (8, ""), (None, "only here"), (None, " ".join(base)), (2, "x y z"), (2, "x y z"), (2, "another text"), (11, "a " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as row", "3 as n", "4 as kept_id")
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    want = brute_first([(r[0], r[1]) for r in rows if r[0] is not None and r[0] != 2])
    assert sorted((r.doc_id or -1, (r.text or "")[:12]) for r in got.collect() if r.doc_id != 2) == sorted([(-1, "only here"), *((d, dict(rows)[d][:12] if dict(rows)[d] else "") for d in want)])
    assert sorted(r.text for r in got.collect() if r.doc_id == 2) == ["another text", "x y z"]
    assert simhash.keep_first(df.limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [3, 1000])
def test_keep_first_compares_all_pairs_of_a_template(spark, chunk):
    """Near copies of texts that are all near one template, but not similar enough to it."""
    rng, base, rows = random.Random(chunk), [f"w{i}" for i in range(300)], []
    for i in range(60):
        words = base.copy()
        for k in rng.sample(range(300), 10):
            words[k] = f"x{i}.{k}"
        copy = words.copy()
        copy[rng.randrange(300)] = f"y{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk=chunk)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == brute_first(rows)


def test_keep_first_lists_few_pairs_of_a_group(spark, monkeypatch):
    """A group whose texts are about as similar as they must be: pairs are listed by component, not for each two texts."""
    rng, base, rows, listed = random.Random(5), [f"w{i}" for i in range(300)], [], []
    for i in range(160):
        words = base.copy()
        for k in range(rng.choice((3, 4, 5))):
            words[rng.randrange(300)] = f"x{i}.{k}"
        rows.append((i, " ".join(words)))

    def written(df, name, *args, **options):
        out = materialize(df, name, *args, **options)
        listed.extend([out.count()] if name == "crossing" else [])
        return out

    materialize = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", written)
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == brute_first(rows)
    assert 0 < max(listed) <= 8 * len(rows)
