"""Facts of many rows to one, and of several sources to one, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roll_up(rows: DataFrame, keys: Sequence[str], order: Sequence[str], firsts: Sequence[str], total: str, union: str) -> DataFrame:
    """Per key: number of rows, sum of positive `total` (null for none), first non-empty of `firsts`, union of arrays in order."""
    at = F.struct(*order)
    picked = [F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), at)).alias(c) for c in firsts]
    lists = F.array_sort(F.collect_list(F.struct(*order, union)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.nullif(F.sum(F.when(F.col(total) > 0, F.col(total))), F.lit(0)).alias(total), *picked, F.array_distinct(F.flatten(F.transform(lists, lambda x: x[union]))).alias(union))


def prefer(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def first_candidates(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Of array columns by priority, the first that has elements, and its name."""
    name, rows = F.lit(None).cast("string"), F.lit(None)
    for c in reversed(candidates):
        has = F.size(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))) > 0
        name, rows = F.when(has, c).otherwise(name), F.when(has, F.col(c)).otherwise(rows)
    return df.withColumns({"origin": name, "rows": rows})
