import zlib

import numpy as np
from pyspark.sql import functions as F

from noticeworks.llm import quality, queries


def test_weights_minimise_the_pairs_loss():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0.5, 1, (500, 3)), rng.normal(0, 1, (500, 3))
    w = quality.bradley_terry(a, b)

    def loss(v):
        return np.log1p(np.exp(-(a - b) @ v)).mean() + 5e-4 * v @ v

    assert all(loss(w) <= loss(w + e) for e in rng.normal(0, 0.05, (200, 3)))


def test_held_out_accuracy(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op9_bradley_terry_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_edge_rows(spark):
    docs = [(i, "a fine text of many words." if i % 3 else "spam spam spam spam !!! ###") for i in range(60)]
    docs += [(100, None), (101, ""), (None, "x"), (102, "word " * 30_000), (1, "repeated id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as x", "2 as y", "3 as quality")
    labels = spark.createDataFrame([*((i, int(i % 3 > 0)) for i in range(60)), (None, 1), (7, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = quality.score(df, labels).collect()
    assert len(got) == len(docs) and all(r.score is not None for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and 1 < r.doc_id < 60)
    for part in (labels.limit(0), labels.filter("quality = 0"), labels.filter("quality = 1")):
        assert quality.score(df, part).count() == len(docs)
    assert quality.score(df.limit(0), labels).collect() == []
