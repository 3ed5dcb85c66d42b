"""One row per key, and one item per thing within an array."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bind
from ..sources.shared import written


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first in the order, by a partial aggregate: a hot key meets as one row per task.

    Null keys are one key; nulls come first in the order; of rows that are equal in it any one stays, so end it with
    something unique. An empty table gives an empty result.
    """
    return _best(df, keys, order, F.min_by)


def pick_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """As pick, but the row that comes last."""
    return _best(df, keys, order, F.max_by)


def _best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], by) -> DataFrame:
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*keys).agg(by(F.struct(*df.columns), rank).alias("the row")).select("the row.*")


def pick_text(df: DataFrame, text: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each value of a long text column, by a 256-bit digest of it, so that no text is shuffled as a key."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(F.sha2(text, 256).alias("digest of the text")).agg(F.min_by(F.struct(*df.columns), rank).alias("the row")).select("the row.*")


def per_text(rows: DataFrame, column: str, hold: bool = False, **made: Callable[[Column], Column]) -> DataFrame:
    """rows with these columns, which are made of the text in `column` alone: once for each distinct text, however often it comes.

    The texts are dealt evenly and what is made of them is written once. Null is a text. Where all texts differ this costs a shuffle
    of them and a join; it pays for rules that take longer than that. rows is read twice: `hold` writes it first, if it is dear to make.
    """
    text = "the distinct text"
    rows = written(rows, "held") if hold else rows
    texts = rows.select(F.col(f"`{column}`").alias(text)).distinct().repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, text)
    known = written(texts.select(text, F.struct(*[use(F.col(text)).alias(n) for n, use in made.items()]).alias("the made")), "texts")
    return rows.join(known, F.col(f"`{column}`").eqNullSafe(F.col(text))).select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col("the made")[n].alias(n) for n in made])


def alike(rows: DataFrame, columns: Sequence[str], name: str, hold: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows with a digest of these columns in their place, and each distinct content once: its digest and the columns.

    What is made of the columns alone is made of the contents and joined by the digest, `name`: once, however often they come. The
    contents are dealt evenly and written. Where all differ this costs two shuffles of them and a join by the digest; it pays for what
    takes longer than that. None of the columns is null, and of their texts only the last may hold line ends. rows is read twice: see
    per_text for `hold`.
    """
    rows = written(rows, "held") if hold else rows
    digest = F.sha2(F.concat_ws("\n", *columns), 256).alias(name)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    contents = rows.select(*columns).distinct().select(digest, *columns).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, name)
    return rows.select(*kept, digest), written(contents, "contents")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each group before the shuffle. Null keys are one key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place within the key", rank).filter(F.col("place within the key") <= n).drop("place within the key")


def undominated(items: Column, most: int = 8) -> Column:
    """Items that aren't part of another, each once, in order, at most so many; null for null."""

    def whole(once: Column) -> Column:
        return F.slice(F.filter(once, lambda x: ~F.exists(once, lambda y: (x != y) & F.contains(y, x))), 1, most)

    return bind(F.array_distinct(items), whole)
