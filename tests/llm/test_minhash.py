import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeworks.llm import minhash, queries


def brute_set(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows):
    sets, up, where = [brute_set(t) for _, t in rows], list(range(len(rows))), {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in where[g]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 85 * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                up[b] = a
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(s), least[root(i)], (d == least[root(i)] and d is not None) or not s) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    expected = brute(rows)
    assert found(queries.op12_minhash_near_dedup(spark, sf_small)) == expected
    assert any(d != c for d, _, c, _ in expected)


@pytest.mark.parametrize("chunk", [3, 128])
def test_groups_around_the_threshold(spark, chunk):
    """Templates whose members lie on both sides of 0.85 of each other, so that hubs alone don't settle them."""
    rng = random.Random(7)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 18)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(words)))
            if rng.random() < 0.3:
                rows.append((len(rows), " ".join(words[:-2]) + "  " + " ".join(words[-2:]).upper()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(minhash.near_duplicates(df, chunk=chunk)) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [(5, None), (3, ""), (4, " \t\r\n\x0b\x0c"), (7, "one"), (8, "One"), (9, "one two"), (10, "É È ä"), (11, "é è ä"), (12, "a b c d e f g h i"), (13, "a b c d e f g h i j"), (14, "b c d e f g h i a b c"), (None, "one"), (None, "alone here now"), (None, None), (20, long), (21, long + " end"), (22, long), (22, long), (22, long), (30, "a a a a a"), (31, "a a a"), (32, "a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("n", F.lit(None).cast("string")).withColumn("component", F.lit(1))
    assert found(minhash.near_duplicates(df)) == brute(rows)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bounds_rule_out_no_similar_pair():
    """Sizes and bitmaps may only rule out pairs that are below the threshold; signatures within the radius share a key."""
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.choice([0.0, 0.05, 0.1, 0.3])], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        bits = [np.bincount((s % np.uint64(minhash.PLACES)).astype(int), minlength=minhash.PLACES) & 1 for s in (a, b)]
        differ = int((bits[0] != bits[1]).sum())
        assert differ <= len(a) + len(b) - 2 * common
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert minhash.may_link(np.array([len(a)]), np.array([len(b)]), np.array([differ]), 85).all()


def test_signatures_within_the_radius_share_a_key(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        sig = rng.integers(0, 1 << 16, minhash.SLOTS).astype("<u2")
        other = sig.copy()
        other[rng.choice(minhash.SLOTS, 2 * minhash.CHUNKS - 1, replace=False)] ^= 1
        rows.append((i, bytearray(sig.tobytes()), bytearray(other.tobytes())))
    df = spark.createDataFrame(rows, "i int, a binary, b binary")
    assert df.filter(~F.arrays_overlap(minhash.chunk_keys(F.col("a")), minhash.chunk_keys(F.col("b")))).count() == 0


def test_first_shared_key_and_likeliest_pairs(spark):
    """A pair comes under the first key that it shares, and a limit leaves each component its likeliest pairs."""
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(200):
        sig = rng.integers(0, 1 << 16, minhash.SLOTS).astype("<u2")
        other = sig.copy()
        other[rng.choice(minhash.SLOTS, int(rng.integers(0, 30)), replace=False)] ^= 1
        pairs.append((sig.tobytes(), other.tobytes()))
    df = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(pairs)], "i int, a binary, b binary")
    rows = df.orderBy("i").select(minhash.chunk_keys(F.col("a")).alias("a"), minhash.chunk_keys(F.col("b")).alias("b")).collect()
    expected = [next((n for n, (x, y) in enumerate(zip(r.a, r.b, strict=True)) if x == y), -1) for r in rows]
    assert minhash.first_shared(*map(list, zip(*pairs, strict=True))).tolist() == expected
    assert all(k & minhash.INDEX == n for r in rows for n, k in enumerate(r.a))
    kept = minhash.likeliest(np.array([5, 1, 3, 2]), np.array([1, 1, 2, 9]), np.array([2, 3, 3, 1]), 1)
    assert kept.tolist() == [False, True, True, True]  # of 1 and 3: the second; of 2: the third; of 9: the last


def test_groups_of_near_copies_list_few_pairs(spark, monkeypatch):
    """Most of a group's pairs are never listed: they lie within a component by the time that all are."""
    rng, listed = random.Random(2), []
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(240):
        own = list(words)
        for _ in range(rng.randrange(2, 7)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    kept = minhash.materialize

    def counted(df, name, *args, **options):
        out = kept(df, name, *args, **options)
        if name == "crossing":
            listed.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(minhash.near_duplicates(df, chunk=32)) == brute(rows)
    assert sum(listed) < 1500
