"""Order within documents: pages, running numbers, continuation lines, marker slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 20) -> DataFrame:
    """One page: a top-k of all pages up to it, so nothing is sorted whole."""
    return df.orderBy(*order).limit(number * size).offset((number - 1) * size)


def clamped_page(df: DataFrame, order: Sequence[Column], number: int, size: int = 20) -> tuple[DataFrame, int, int]:
    """The page, its number held to those there are, and how many those are: one at least, which is empty if df is."""
    pages = max(1, -(-df.count() // size))
    held = min(max(1, number), pages)
    return page(df, order, held, size), held, pages


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Each row's place in the order over all, from 1, without one task that sorts them all.

    Rows are dealt to ranges of the order and sorted and written there; only the numbers of rows of the ranges meet. Of rows that are
    equal in the order any comes first, and they are one range. An empty table gives an empty result.
    """
    ranges = 4 * df.sparkSession.sparkContext.defaultParallelism
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The id's upper bits are the range's number, the lower 33 count its rows.
    held = written(ordered.withColumn("the row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("the row", 33).alias("the range")
    sizes = held.groupBy(part).agg(F.count("*").alias("n"))
    before = W.partitionBy(F.lit(0)).orderBy("the range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("the range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("the start"))
    at = (F.col("the start") + F.col("the row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")
    return held.select("*", part).join(F.broadcast(starts), "the range").select(*[F.col(f"`{c}`") for c in df.columns], at.alias(name))


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], explicit: Column, name: str = "seq") -> DataFrame:
    """A number that is written restarts the count; rows without one count on from it, or from 0."""
    w = W.partitionBy(*keys).orderBy(*order)
    run, given = "the run of numbers", "the number given"
    marked = df.withColumn(run, F.count(explicit).over(w)).withColumn(given, explicit)
    since = W.partitionBy(*keys, F.col(f"`{run}`")).orderBy(*order)
    n = F.coalesce(F.first(given).over(since), F.lit(0)) + F.row_number().over(since) - F.when(F.col(run) > 0, 1).otherwise(0)
    return marked.withColumn(name, n.cast("long")).drop(run, given)


def merge_continuations(df: DataFrame, keys: Sequence[str], order: str, starts: Column, value: str, glue: str = "\n") -> DataFrame:
    """keys, first, n, merged: each row that starts with those that follow until the next one.

    A null `starts` doesn't start. Rows before the first one that starts are one row together; of equal orders the value decides.
    """
    w = W.partitionBy(*keys).orderBy(order)
    row = "the row begun"
    grouped = df.withColumn(row, F.coalesce(F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w), F.lit(0))).groupBy(*keys, row)
    lines = F.array_sort(F.collect_list(F.struct(order, value)))
    return grouped.agg(F.min(order).alias("first"), F.count("*").alias("n"), F.array_join(F.transform(lines, lambda x: x[value]), glue).alias("merged")).drop(row)


def labelled_slices(c: Column, labels: Sequence[str]) -> Column:
    """array<struct<label, value>>: what stands between each label and the next, in the order of the text."""
    places = F.array(*[F.struct(F.instr(c, x).alias("at"), F.lit(x).alias("label")) for x in labels])
    found = F.array_sort(F.filter(places, lambda p: p["at"] > 0))

    def slice_(p: Column, i: Column) -> Column:
        start = p["at"] + F.length(p["label"])
        end = F.coalesce(F.get(found, i + 1)["at"], F.length(c) + 1)
        return F.struct(p["label"].alias("label"), F.trim(F.substring(c, start, F.greatest(end - start, F.lit(0)))).alias("value"))

    return F.transform(found, slice_)
