import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeworks.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Lloyd's rounds over plain integers."""
    kept = [(i, label, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    seeds = sorted((i, c) for i, _, c in kept if i is not None)[:entries]
    books = [[c[p * width : (p + 1) * width] for _, c in seeds] for p in range(parts)]

    def assigned():
        found = []
        for _, _, c in kept:
            cut = [c[p * width : (p + 1) * width] for p in range(parts)]
            found.append([min((sum((a - b) ** 2 for a, b in zip(cut[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)])
        return found

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [c[p * width : (p + 1) * width] for (_, _, c), a in zip(kept, now) if a[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    now, by_label = assigned(), {}
    for (_, label, _), a in zip(kept, now):
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in a)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in a), sum(d for d, _ in a), by_label[label], sha) for (i, label, _), a in zip(kept, now)), key=str)


def found(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    assert found(queries.op11_vector_code_compression(spark, sf_small)) == brute(rows)


def test_ties_nulls_repeats_and_clashing_names(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60) if rng.random() < 0.97 else None, [rng.choice([-0.5, 0.0, 0.0, 0.25, -0.001, 1.0]) for _ in range(8)], rng.choice([None, 1, 1, 2])) for _ in range(300)]
    rows += [rows[5]] * 40 + [(1, None, 1), (2, [0.1] * 7 + [None], 1), (3, [0.1] * 7 + [float("nan")], 2), (0, [float("-inf")] + [0.0] * 7, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("c", F.lit("clash")).withColumn("own", F.lit(None).cast("string")).withColumn("same", F.lit(1)).withColumn("id", F.lit("x"))
    for entries in (1, 5, 256):
        assert found(vector_codes.coded(df, entries=entries)) == brute(rows, entries=entries)


def test_wide_values_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-9e4, 9e4) for _ in range(8)], i % 3) for i in range(120)]
    assert found(vector_codes.coded(spark.createDataFrame(rows, SCHEMA), entries=40)) == brute(rows, entries=40)


def test_empty_table_and_uneven_vectors(spark):
    for rows in ([], [(1, None, 1)], [(None, [0.5] * 4, 1)]):
        df = vector_codes.coded(spark.createDataFrame(rows, SCHEMA))
        assert df.collect() == [] and df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for vectors in ([[0.1] * 8, [0.1] * 4], [[0.1] * 6]):
        with pytest.raises(ValueError):
            vector_codes.coded(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], SCHEMA))


def test_bounds_skip_most_distances(spark, sf):
    """Bounds hold from round to round, and fewer distances than all are computed once entries settle."""
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()])
    x = np.floor(1024 * x).astype(np.int64)[:, :16]
    book = x[:64]
    groups, drift, own, low = vector_codes.grouped(book), np.zeros(64), None, None
    shares = []
    for _ in range(8):
        own, least, low, computed = vector_codes.reassign(x, book, groups, own, low, drift)
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        d[np.arange(len(x)), own] = np.iinfo(np.int64).max
        assert all((low[:, g] <= np.sqrt(d[:, groups == g].min(axis=1))).all() for g in np.unique(groups))
        new = np.array([x[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else book[j] for j in range(64)])
        drift, book = np.sqrt(((new - book) ** 2).sum(axis=1)), new
        shares.append(computed / d.size)
    assert shares[0] == 1 and shares[-1] < 0.6
