"""Labelled rows to learn from: some folds only, and a bounded number of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, learn: Column, max_rows: int, max_chars: int | None = None) -> DataFrame:
    """(doc_id, text, y) of the labelled rows whose fold may be learned from.

    At most about max_rows rows and max_chars characters of each class, chosen by a hash of the id, whatever the size
    of the tables. Rows without an id or a label aren't labelled. Labels that are repeated alike count once; ids with
    both labels are left out.
    """
    wanted = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").drop("y2")
    wanted = wanted.withColumn("fold", fold(F.col("doc_id"), folds)).filter(learn)
    counts = {r.y: r.n for r in wanted.groupBy("y").agg(F.count("*").alias("n")).collect() if r.y in (0, 1)}  # two rows
    share = {y: min(1.0, max_rows / n) for y, n in counts.items()}
    chosen = _chosen(wanted, share)
    if max_chars is not None:
        sizes = docs.select("doc_id", F.length("text").alias("chars")).join(F.broadcast(chosen), "doc_id").groupBy("y").agg(F.sum("chars").alias("chars"))
        for r in sizes.collect():  # two rows
            share[r.y] *= min(1.0, max_chars / max(1, r.chars or 0))
        chosen = _chosen(wanted, share)
    # Two classes of about max_rows ids each: a bounded side, so the texts of all documents aren't shuffled.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def _chosen(wanted: DataFrame, share: dict[int, float]) -> DataFrame:
    rate = F.lit(0.0)
    for y, part in share.items():
        rate = F.when(F.col("y") == y, part).otherwise(rate)
    return wanted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20)).select("doc_id", "y")
