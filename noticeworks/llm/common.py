"""What several corpus operators share: scratch tables, words and label folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


T = TypeVar("T")
#: Rows up to which a side that has been counted may be broadcast.
FEW = 100_000


def scratch_root(spark: SparkSession) -> str:
    """The folder that all machines share; where the session names none, a local one if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="noticeworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all machines share."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is materialized within and not kept is deleted at the end: nothing that is evaluated later may read it.

    What is kept lasts until the one around this ends, if there is one.
    """
    made: list[str] = []
    token = _PASSING.set((*_PASSING.get(), made))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in made:
            remove(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Writes df to the shared folder, with options of the writer, and reads it back.

    Cuts the lineage at the cost of one computation, and outlives the executors that wrote it; see passing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    around = _PASSING.get()[:-1] if keep else _PASSING.get()
    if around:
        around[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left joined with a written table: broadcast if it has few rows, else merged."""
    return left.join(F.broadcast(right) if right.limit(FEW + 1).count() <= FEW else right.hint("merge"), on, how)


def spread_join(many: DataFrame, one: DataFrame, key: str, per: int = 1_000, keys: int = 10_000) -> DataFrame:
    """many joined with one, which has a row for each key and in `n` how many rows of many there are with it.

    The rows of a key with more than `per` are dealt to parts by a hash, and that row of one is repeated for each part,
    so that no task gets all of them. This is done for the `keys` most frequent ones, a bounded broadcast; any other has
    less than 1 in `keys` of the rows. Both sides are read twice and should be written.
    """
    hot = F.broadcast(one.filter(F.col("n") > per).orderBy(F.desc("n"), key).limit(keys).select(key, F.ceil(F.col("n") / per).cast("int").alias("_parts")))
    dealt = many.join(hot, key, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*many.columns), F.col("_parts")).cast("int")))
    spread = one.drop("n").join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_parts").join(spread.drop("_parts").hint("merge"), [key, "_part"]).drop("_part")


def few_join(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """spread_join, but without moving the rows of many where one, written, has few rows."""
    if one.limit(FEW + 1).count() <= FEW:
        return many.join(F.broadcast(one.drop("n")), key)
    return spread_join(many, one, key)


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], per: int = 2_000, keys: int = 10_000) -> DataFrame:
    """left joined with right, where either may have many rows of a key: those of left are dealt to parts of about `per`
    rows by a hash, and those of right repeated for each part. As in spread_join, the `keys` most frequent keys are."""
    hot = left.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > per).orderBy(F.desc("_n"), *on).limit(keys)
    hot = F.broadcast(hot.select(*on, F.ceil(F.col("_n") / per).cast("int").alias("_parts")))
    dealt = left.join(hot, on, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int")))
    spread = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_parts").join(spread.drop("_parts").hint("merge"), [*on, "_part"]).drop("_part")


def each(values: pa.Array, at_once: int = 256) -> Iterator:
    """The values one by one; only some of a batch are Python objects at a time."""
    for i in range(0, len(values), at_once):
        yield from values.slice(i, at_once).to_pylist()


_RESIDENT: dict = {}


def resident(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one thing at a time, as Spark hands workers from operator to operator."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        pa.default_memory_pool().release_unused()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds: which rows may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
