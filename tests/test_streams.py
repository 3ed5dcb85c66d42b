import datetime as dt

from pyspark.sql import functions as F

from noticeworks.sources.shared import new_folder
from noticeworks.streaming import cursors

ITEMS = "source string, item long, published timestamp, at timestamp, changed boolean, failed boolean"
DAY = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def batch(spark, *rows):
    return spark.createDataFrame([(s, i, day(p), day(a), c, f) for s, i, p, a, c, f in rows], ITEMS)


def state(spark, root):
    return {r.source: (r.cursor and (r.cursor - DAY).days, r.status) for r in cursors.cursors(spark, root).collect()}


def test_a_repeated_batch_adds_nothing(spark):
    root = new_folder(spark, "cursors")
    assert state(spark, root) == {}
    first = batch(spark, ("a", 1, 0, 1, True, False), ("a", 2, None, 2, False, True), ("b", 3, 0, 1, False, True), (None, 4, 0, 1, True, False))
    second = batch(spark, ("a", 5, 1, 3, True, False), ("a", 6, 2, 4, False, False), ("b", 7, 0, 3, False, False))
    cursors.advance(first, 0, root)
    assert state(spark, root) == {"a": (2, "active"), "b": (None, "error"), "": (1, "active")}
    cursors.advance(second, 1, root)
    once = state(spark, root), sorted(r.item for r in spark.read.parquet(f"{root}/accepted/batch=*").collect())
    cursors.advance(second, 1, root)
    assert (state(spark, root), sorted(r.item for r in spark.read.parquet(f"{root}/accepted/batch=*").collect())) == once
    assert once == ({"a": (2, "active"), "b": (None, "active"), "": (1, "active")}, [1, 2, 3, 4, 6, 7])


def test_full_mode_takes_everything_and_always_moves(spark):
    root = new_folder(spark, "cursors")
    cursors.advance(batch(spark, ("a", 1, 0, 5, True, False)), 0, root)
    cursors.advance(batch(spark, ("a", 2, 0, 9, False, True)), 1, root, full=True)
    assert state(spark, root) == {"a": (9, "error")}
    cursors.advance(batch(spark).limit(0), 2, root)
    assert state(spark, root) == {"a": (9, "error")}


def test_breakers_go_on_after_a_restart(spark):
    rows = [("a", i, day(i), c, i // 3) for i, c in enumerate([200, 500, None, 500, 200, 200])] + [("b", 10, day(0), 403, 0), ("b", 11, day(4), 200, 1), ("c", 20, day(0), 500, 0), ("c", 21, day(1), 200, 0), ("c", 22, day(3), 500, 1), (None, 30, day(0), 200, 1)]
    asked = spark.createDataFrame(rows, "source string, item long, at timestamp, code int, part int")
    folder, root = new_folder(spark, "asked"), new_folder(spark, "breakers")
    run = lambda: {r.source: r for r in cursors.run_breakers(cursors.breakers(spark.readStream.schema(asked.drop("part").schema).parquet(f"{folder}/part=*"), "source", ["at", "item"], "code"), root).collect()}
    asked.filter("part = 0").drop("part").write.parquet(f"{folder}/part=0")
    first = run()
    assert (first["a"].in_a_row, first["a"].tripped, first["b"].reason, first["c"].in_a_row) == (2, False, "HTTP 403", 0)
    asked.filter("part = 1").drop("part").write.parquet(f"{folder}/part=1")
    got = run()
    assert (got["a"].seen, got["a"].made, got["a"].failed, got["a"].skipped, got["a"].reason, got["a"].tripped_at) == (6, 4, 3, 2, "3 failures in a row", day(3))
    assert (got["b"].made, got["b"].skipped, got["c"].failed, got["c"].in_a_row, got["c"].tripped) == (1, 1, 2, 1, False)
    assert (got[""].made, got[""].failed) == (1, 0)


def test_parts_are_taken_in_order(spark):
    df = spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("part"))
    folder = cursors.in_parts(df, "part", 4, "parts")
    assert [sorted(r.id for r in spark.read.parquet(f"{folder}/part={i}").collect())[0] for i in range(4)] == [0, 1, 2, 3]


def test_parts_of_many_files_are_one_batch_each(spark):
    """each part was written by one task, and a batch was one file."""
    asked = spark.range(400).select((F.col("id") % 7).cast("string").alias("source"), F.col("id").alias("item"), F.timestamp_seconds("id").alias("at"), F.when(F.col("id") % 5 == 0, 500).otherwise(200).alias("code"), (F.col("id") / 100).cast("int").alias("part")).repartition(4)
    root, files = new_folder(spark, "breakers"), []

    def run(folder):
        stream = spark.readStream.schema(asked.drop("part").schema).parquet(f"{folder}/part=*")
        files.append(len(spark.read.parquet(f"{folder}/part={len(files)}").inputFiles()))
        states.append(cursors.run_breakers(cursors.breakers(stream, "source", ["at", "item"], "code"), root))

    states = []
    cursors.in_parts(asked, "part", 4, "asked", run)
    assert min(files) > 1
    assert [sum(r.seen for r in s.collect()) for s in states][-1] == 400
    assert len({f.rpartition("/")[0] for f in spark.read.parquet(f"{root}/states/batch=*").inputFiles()}) == 4
