"""Generated rows are dealt by key before anything is made of them."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.plans.discovery import LINKS
from noticeworks.plans.tables import SHEETS


def test_small_files_are_dealt_and_windows_by_key_need_no_shuffle(spark, sf_small):
    rows = SHEETS.rows(spark, sf_small)
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    lines = rows.select("id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    numbered = lines.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("line_no")))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rows_are_dealt_by_a_key_that_is_an_expression(spark, sf_small):
    rows = LINKS.rows(spark, sf_small)
    assert rows.count() == spark.read.parquet(f"{sf_small}/lineitem.parquet").count()
