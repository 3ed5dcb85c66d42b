"""Mixing sources to target weights with hash-random keys and exact budgets, in DataFrame operations only.

Each document gets a key that is a hash of its id. Within a source, documents are taken in key order until the
source's budget of words is used up, whole epochs first. The prefix sums that find the cut are distributed: keys
are uniform, so equal key ranges make even buckets; bucket sums are aggregated before they are shuffled, a window
over a source's buckets gives the sums before each, and only the bucket that the cut falls into is summed row by
row. What remains per source is one cut point, and each document compares itself with its source's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize, word_count

#: Keys are the first 60 bits of an MD5.
KEY_BITS = 60


def random_key(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, n, source_size, target: one row per source of sizes (source, size).

    Sources in code-point order, null last, get the weights in turn. Together the targets make `share` times all
    sizes, no target is above `most` times its source's size, and what that cuts off goes to the others by weight:
    sources are capped in order of size for their weight until the level of the rest is below the next cap.
    """
    stats = sizes.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighted = stats.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")).withColumn("cap", most * F.col("source_size"))
    # One row per source, so these windows are as long as the list of sources.
    ordered = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = ordered.rowsBetween(W.unboundedPreceding, -1), ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighted.withColumn("level", level)
    free = F.first(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level")), ignorenulls=True).over(all_rows)
    return levels.withColumn("free", free).select("source", "n", "source_size", F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("weight") * F.col("free")).otherwise(F.col("cap").cast("double")).alias("target"))


def source_cuts(sized: DataFrame, targets: DataFrame, bucket_rows: int = 10_000) -> DataFrame:
    """One row per source: epochs taken whole, and the key, id and size at which one more epoch is cut.

    Rows that agree in source, id and size are one unit at the cut and get equal parts of what is left for it.
    """
    budgets = (
        targets.withColumn("budget", F.floor(F.col("target") + 0.5))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n") / bucket_rows))
        .withColumnRenamed("source", "name")
    )
    same = F.col("source").eqNullSafe(F.col("name"))
    placed = sized.join(budgets.select("name", "rest", "buckets"), same).drop("name").withColumn("bucket", F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * F.col("buckets")))
    by_bucket = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)))
    hit = offsets.filter("before <= rest and rest < before + words").select(F.col("source").alias("hit_source"), F.col("bucket").alias("hit_bucket"), "before")
    units = placed.join(hit, F.col("source").eqNullSafe(F.col("hit_source")) & (F.col("bucket") == F.col("hit_bucket"))).groupBy("source", "key", "doc_id", "size", "rest", "before").agg(F.count("*").alias("copies"))
    by_key = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    reached = units.withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(by_key), F.lit(0)))
    cut = reached.filter("at <= rest and rest < at + size * copies").select(F.col("source").alias("cut_source"), F.struct("key", "doc_id", "size").alias("cut"), F.expr("(rest - at) div copies").alias("part"))
    return budgets.select("name", "source_size", "target", "epochs").join(cut, F.col("name").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")


def taken_words(key: Column, doc_id: Column, size: Column) -> Column:
    """What the mix takes of a row that is joined with its source's cut."""
    here, cut = F.struct(key.alias("key"), doc_id.alias("doc_id"), size.alias("size")), F.col("cut")
    more = F.when(cut.isNull(), 0).when(here < cut, size).when(here == cut, F.col("part")).otherwise(0)
    return (F.col("epochs") * size + more).cast("long")


def mix_sizes(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, bucket_rows: int = 10_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, source, text).

    Null and empty texts have size 0 and are taken 0 times. Null sources are one source, the last. Repeated rows
    are taken alike. An empty table gives an empty result. Other columns of docs are not read.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id")).alias("key")), "sizes")
    cuts = source_cuts(sized, materialize(source_targets(sized, weights, share), "targets"), bucket_rows)
    joined = sized.join(materialize(cuts, "cuts"), F.col("source").eqNullSafe(F.col("name")))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken_words(F.col("key"), F.col("doc_id"), F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, bucket_rows: int = 10_000) -> DataFrame:
    """The mix itself: docs' columns, one row per copy taken; a source's last copy is cut after its budget's last word.

    n_chars, if docs has it, is that of the copy. Rows without words have nothing to take and don't appear.
    """
    columns = docs.columns
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id")).alias("key")), "sizes")
    cuts = materialize(source_cuts(sized, materialize(source_targets(sized, weights, share), "targets"), bucket_rows), "cuts")
    plan = cuts.select("name", F.struct("epochs", "cut", "part").alias("mix_plan"))
    row = docs.select(F.struct(*columns).alias("row"), word_count(F.col("text")).alias("size"), random_key(F.col("doc_id")).alias("key"))
    joined = row.join(plan, F.col("row.source").eqNullSafe(F.col("name"))).select("row", "size", "key", "mix_plan.*")
    took = joined.withColumn("taken", taken_words(F.col("key"), F.col("row.doc_id"), F.col("size"))).filter("taken > 0")
    copies = took.withColumn("words", F.explode(F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), i -> least(size, taken - (i - 1) * size))")))
    # The first so many words with what stands between them.
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(f"({SPACE}*{WORD})"), 1), 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(head)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return copies.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in columns])
