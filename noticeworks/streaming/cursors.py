"""State by source that a stream of crawl results carries on: cursors as a versioned table, breakers as keyed state.

The cursor table has one version for each micro-batch, a folder of its own in the shared folder. Batch n reads the newest
version below n and overwrites version n and the rows it accepted, so a batch that is repeated after a failure gives the
same version and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import new_folder

VERSION = "source string, cursor timestamp, status string"
BREAKER = "source string, seen long, made long, failed long, skipped long, in_a_row int, tripped boolean, reason string, tripped_at timestamp"


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    done = [n for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in done)


def cursors(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """source, cursor and status of the newest version, or of the newest one below a batch's number; empty if there is none."""
    found = [v for v in _versions(spark, root) if below is None or v < below]
    return spark.read.schema(VERSION).parquet(f"{root}/version={found[-1]}") if found else spark.createDataFrame([], VERSION)


def advance(batch: DataFrame, number: int, root: str, full: bool = False) -> None:
    """Takes one batch of items into the cursor table at root and writes what it accepted.

    batch: source, item, published (null is taken), at, changed and failed. Items published before their source's cursor are
    left out, unless `full`. A source's cursor becomes the time of its newest accepted item if any of these has changed
    anything, or always if `full`; its status is error if items failed and none changed anything, else active. Sources of
    which nothing was accepted stay as they are. Rows without a source belong to the source named by the empty text.
    """
    spark = batch.sparkSession
    known = cursors(spark, root, number)
    named = batch.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    joined = named.join(known.select("source", F.col("cursor").alias("_cursor")), "source", "left")
    taken = joined if full else joined.filter(F.col("published").isNull() | F.col("_cursor").isNull() | (F.col("published") >= F.col("_cursor")))
    taken.drop("_cursor").write.mode("overwrite").parquet(f"{root}/accepted/batch={number}")
    taken = spark.read.parquet(f"{root}/accepted/batch={number}")
    seen = taken.groupBy("source").agg(F.max("at").alias("_at"), F.bool_or("changed").alias("_changed"), F.bool_or("failed").alias("_failed"))
    moves = F.lit(True) if full else F.coalesce(F.col("_changed"), F.lit(False))
    status = F.when(F.col("_failed") & ~F.coalesce(F.col("_changed"), F.lit(False)), "error").otherwise("active")
    new = known.join(seen, "source", "full").select("source", F.when(F.col("_at").isNotNull() & moves, F.col("_at")).otherwise(F.col("cursor")).alias("cursor"), F.when(F.col("_at").isNotNull(), status).otherwise(F.col("status")).alias("status"))
    new.write.mode("overwrite").parquet(f"{root}/version={number}")


def run_cursors(stream: DataFrame, root: str, full: bool = False) -> None:
    """Runs a stream over what there is now into the cursor table at root, from where an earlier run of it ended."""
    write = lambda batch, number: advance(batch, number, root, full)
    job = stream.writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(write).start()
    try:
        job.awaitTermination()
    finally:
        job.stop()


def breakers(stream: DataFrame, source: str, order: Sequence[str], status: str, most_failures: int = 3, fatal: Sequence[int] = (403,)) -> DataFrame:
    """The state of each source's breaker after each batch that has rows of it, as an update stream; see BREAKER.

    stream: requests with their HTTP status (null for one that got no answer). A status of 400 or more, or none, is a
    failure, others reset the count. A fatal status trips the breaker at once, and so do `most_failures` failures in a row;
    requests after that are skipped. order: a time and further columns that order the rows of one batch; batches are taken
    as they come. Only these columns of one source's rows of one batch are in a task's memory at once.
    """
    time, kept = order[0], [*order, status]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(list(order), kind="stable")
        seen, made, failed, skipped, run, tripped, reason, tripped_at = state.get if state.exists else (0, 0, 0, 0, 0, False, None, None)
        for at, code in zip(rows[time], rows[status], strict=True):
            seen += 1
            if tripped:
                skipped += 1
                continue
            made += 1
            bad = pd.isna(code) or code >= 400
            run, failed = (run + 1, failed + 1) if bad else (0, failed)
            if bad and (not pd.isna(code) and int(code) in fatal or run >= most_failures):
                tripped, tripped_at = True, at.to_pydatetime()
                reason = f"HTTP {int(code)}" if not pd.isna(code) and int(code) in fatal else f"{most_failures} failures in a row"
        state.update((seen, made, failed, skipped, run, tripped, reason, tripped_at))
        yield pd.DataFrame([[key[0], seen, made, failed, skipped, run, tripped, reason, tripped_at]], columns=[c.split()[0] for c in BREAKER.split(", ")])

    named = stream.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), *kept)
    held = BREAKER.replace("source string, ", "")
    return named.groupBy("source").applyInPandasWithState(step, BREAKER, held, "update", GroupStateTimeout.NoTimeout)


def run_breakers(stream: DataFrame, root: str) -> DataFrame:
    """Runs a stream of breakers over what there is now, from where an earlier run at root ended; the newest state of each source."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/states/batch={number}")

    job = stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(write).start()
    try:
        job.awaitTermination()
    finally:
        job.stop()
    states = stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/states/batch=*")
    newest = F.max_by(F.struct(*states.columns), "seen").alias("s")
    return states.groupBy("source").agg(newest).select("s.*")


def in_parts(rows: DataFrame, part: str, parts: int, name: str, then: Callable[[str], object] | None = None) -> str:
    """Writes rows to a folder of the shared one, part after part; `then` is called with the folder after each, so that a stream
    of its files takes a whole part, of any number of files, as its next batch."""
    root = new_folder(rows.sparkSession, name)
    for i in range(parts):
        rows.filter(F.col(part) == i).drop(part).write.parquet(f"{root}/part={i}")
        if then:
            then(root)
    return root
