"""Posting snapshots: an old one and a change make a new one, by joins and unions that any table format can store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, titles
from ..functions.text import trim, with_once
from ..sources.shared import written
from .dedupe import pick_last


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of new replace the columns `update` of old rows with their keys, or are added.

    Of the rows of new with one key the last in `order` wins; of equal ones any. What isn't updated stays as it was.
    Null keys match nothing, so a new row with one is added, once for each key. Empty tables are allowed on either side.
    """
    last = pick_last(new, keys, order)
    was, now = F.struct(*old.columns).alias("was"), F.struct(*last.columns).alias("now")
    both = old.select(*keys, was).join(last.select(*keys, now), list(keys), "full")
    return both.select(*[_column(c, c in update).alias(c) for c in old.columns])


def _column(name: str, updated: bool) -> Column:
    was, now = F.col("was"), F.col("now")
    if updated:
        return F.when(now.isNotNull(), now[name]).otherwise(was[name])
    return F.when(was.isNotNull(), was[name]).otherwise(now[name])


def upsert_postings(old: DataFrame, new: DataFrame, keys: Sequence[str], title: str, raw: str, update: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The columns of old, and outcome (kept, updated or created), after the readable rows of new were taken in, in their order.

    A row of new is skipped if its cleaned title or its text is empty or garbled. It updates the old row of its keys and title; else
    the only old row of its keys if that has a title that is none, which this replaces; else it's added. Of rows of new with the
    same keys and title the last one's values count. Only one row replaces a title; what isn't in `update` stays as it was,
    and is null in added rows unless new has it. Null keys match nothing; such rows are added. What comes again with the same
    keys, title and text is cleaned once; what is readable is written to the shared folder, since several steps read it.
    """
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    came = new.groupBy(*dict.fromkeys([*keys, title, raw])).agg(F.min(at).alias("the first"), F.max(at).alias("the last"), F.max_by(F.struct(*new.columns), at).alias("the row"))
    clean = with_once(came, **{"the title": titles.clean_title(F.col(title))})
    good = clean.filter((F.col("the title") != "") & ~rules.is_garbled(F.col("the title")) & (trim(F.col(raw)) != "") & ~rules.is_garbled(F.col(raw)))
    group = [*keys, "the title"]
    fresh = written(good.groupBy(*group).agg(F.min("the first").alias("first"), F.max_by("the row", "the last").alias("now")), "readable")
    was = F.struct(*old.columns).alias("was")
    exact = fresh.join(old.select(*keys, F.col(title).alias("the title"), F.lit(True).alias("the same")).distinct(), group, "left")
    alone = old.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(title).alias("only")).filter("rows = 1")
    alone = alone.filter(titles.is_bad_title(F.col("only"))).select(*keys, "only")
    firsts = exact.filter("`the same` is null").groupBy(*keys).agg(F.min_by("the title", "first").alias("the title"))
    replacing = firsts.join(alone, list(keys)).select(*group, "only")
    placed = exact.join(replacing, group, "left").withColumn("target", F.when(F.col("the same"), F.col("the title")).otherwise(F.col("only")))
    changes = placed.filter("target is not null").select(*keys, F.col("target").alias(title), F.col("the title").alias("to"), "now")
    # A row that is both named and replaced takes the replacing one's values, which come later.
    changes = changes.groupBy(*keys, title).agg(F.max_by(F.struct("to", "now"), F.col("to") != F.col(title)).alias("c"))
    joined = old.select(*keys, title, was).join(changes, [*keys, title], "left")
    value = lambda c: F.when(F.col("c").isNotNull(), F.col("c.to") if c == title else F.col(f"c.now.{c}")).otherwise(F.col(f"was.{c}")) if c in (title, *update) else F.col(f"was.{c}")
    kept = joined.select(*[value(c).alias(c) for c in old.columns], F.when(F.col("c").isNull(), "kept").otherwise("updated").alias("outcome"))
    there = set(new.columns)
    fill = lambda c: F.col("the title") if c == title else F.col(f"now.{c}") if c in there else F.lit(None).cast(old.schema[c].dataType)
    added = placed.filter("target is null").select(*[fill(c).alias(c) for c in old.columns], F.lit("created").alias("outcome"))
    return kept.union(added)


def upsert_merging(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str], config: str, order: Sequence[Column]) -> DataFrame:
    """As upsert, and the map column `config` keeps its keys that the new one doesn't have."""
    last = pick_last(new, keys, order).select(*old.columns)
    overlaid = old.select(*keys, F.col(config).alias("the old map")).join(last, list(keys), "right")
    kept = F.map_filter(F.coalesce("the old map", F.create_map().cast(old.schema[config].dataType)), lambda k, _: ~F.map_contains_key(F.col(config), k))
    laid = overlaid.withColumn(config, F.coalesce(F.map_concat(kept, F.col(config)), F.col(config), F.col("the old map"))).select(*old.columns)
    return upsert(old, laid, keys, [*update, config], [F.lit(0)])


def patch(df: DataFrame, changes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df with each named column set where its condition holds; an unknown condition changes nothing."""
    return df.withColumns({c: F.when(F.coalesce(when, F.lit(False)), value).otherwise(F.col(c)) for c, (when, value) in changes.items()})


def everything():
    """The window over all rows; for tables that are limited already."""
    return W.partitionBy(F.lit(0))


def soft_delete(df: DataFrame, condition: Column, at: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False)) & ~F.col("is_deleted")
    return df.withColumns({"is_deleted": F.col("is_deleted") | hit, "deleted_at": F.when(hit, at).otherwise(F.col("deleted_at"))})


def restore(df: DataFrame, condition: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({"is_deleted": F.col("is_deleted") & ~hit, "deleted_at": F.when(hit, F.lit(None)).otherwise(F.col("deleted_at"))})


def purge(df: DataFrame, now: Column, keep_days: int = 7) -> DataFrame:
    """Without rows that were deleted longer ago than that."""
    gone = F.col("is_deleted") & (F.col("deleted_at") < F.timestamp_add("DAY", F.lit(-keep_days), now))
    return df.filter(~F.coalesce(gone, F.lit(False)))


def janitor(df: DataFrame, now: Column, grace_days: Mapping[str, int], kind: str, seen: Observation, keep_days: int = 7) -> DataFrame:
    """The snapshot after one run: rows past their deadline and their kind's grace are deleted softly, and rows deleted more than
    `keep_days` ago are left out. Kinds without a grace only lose what was deleted; a null deadline is never past.

    `seen` has, once the result has been written, late_KIND and gone_KIND for each kind of grace_days and gone_ and the name of any other
    kind together as gone_raw: how many rows that one pass deleted and left out.
    """
    grace = F.lit(None).cast("int")
    for name, days in grace_days.items():
        grace = F.when(F.col(kind) == name, days).otherwise(grace)
    late = F.coalesce(~F.col("is_deleted") & (F.timestamp_add("DAY", grace, F.col("deadline")) < now), F.lit(False))
    gone = F.coalesce(F.col("is_deleted") & (F.col("deleted_at") < F.timestamp_add("DAY", F.lit(-keep_days), now)), F.lit(False))
    marked = df.withColumns({"the row is late": late, "the row is gone": gone})
    other = ~F.coalesce(F.col(kind).isin(*grace_days), F.lit(False))
    counts = [F.count_if(F.col(f"the row is {w}") & (F.col(kind) == name)).alias(f"{w}_{name}") for w in ("late", "gone") for name in grace_days]
    watched = marked.observe(seen, *counts, F.count_if(F.col("the row is gone") & other).alias("gone_raw"))
    left = watched.filter(~F.col("the row is gone"))
    return left.withColumns({"is_deleted": F.col("is_deleted") | F.col("the row is late"), "deleted_at": F.when(F.col("the row is late"), now).otherwise(F.col("deleted_at"))}).select(*df.columns)


def without(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def after_cursor(df: DataFrame, cursors: DataFrame, key: str, published: str, last: str, overlap_hours: int = 48) -> DataFrame:
    """Rows published since their source's cursor less the overlap; rows without a date, or a cursor, stay."""
    own = cursors.select(F.col(key), F.col(last).alias("the source's cursor"))
    joined = df.join(own, key, "left")
    fresh = F.col(published) >= F.timestamp_add("HOUR", F.lit(-overlap_hours), F.col("the source's cursor"))
    return joined.filter(F.coalesce(fresh, F.lit(True))).select(*df.columns)
