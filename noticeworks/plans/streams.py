"""Cursors and breakers that a stream of the events carries on from part to part; with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import new_folder
from ..streaming import cursors
from .catalog import query, t

PARTS = 4
CRAWLED = """SELECT (user_id % 60)::VARCHAR AS source, event_id AS item, CASE WHEN event_id % 11 > 0 THEN ts - INTERVAL 1 DAY * (event_id % 7) END AS published, ts AS made_at,
  event_type IN ('purchase', 'signup') AND user_id % 9 > 0 AS changed, event_type = 'error' AS failed, least((day(ts) - 1) // 8, 3) AS part FROM events"""


def _crawled(spark, sf_dir):
    """Events as crawled items; each has a part that follows their time."""
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    published = F.when(F.col("event_id") % 11 > 0, F.col("ts") - F.make_dt_interval((F.col("event_id") % 7).cast("int")))
    return e.select((F.col("user_id") % 60).cast("string").alias("source"), F.col("event_id").alias("item"), published.alias("published"), F.col("ts").alias("at"), (F.col("event_type").isin("purchase", "signup") & (F.col("user_id") % 9 > 0)).alias("changed"), (F.col("event_type") == "error").alias("failed"), F.least(F.expr("(day(ts) - 1) div 8"), F.lit(3)).cast("int").alias("part"))


def _part_sql(i: int) -> str:
    return f"""
taken{i} AS MATERIALIZED (SELECT e.* FROM crawled e LEFT JOIN cursor{i} c USING (source) WHERE part = {i} AND (published IS NULL OR c.cursor IS NULL OR published >= c.cursor)),
seen{i} AS (SELECT source, max(made_at) AS newest, bool_or(changed) AS changed, bool_or(failed) AS failed, count(*) AS n FROM taken{i} GROUP BY source),
cursor{i + 1} AS MATERIALIZED (
  SELECT source, CASE WHEN s.newest IS NOT NULL AND s.changed THEN s.newest ELSE c.cursor END AS cursor, CASE WHEN s.newest IS NULL THEN c.status WHEN s.failed AND NOT s.changed THEN 'error' ELSE 'active' END AS status,
         coalesce(c.accepted, 0) + coalesce(s.n, 0) AS accepted FROM cursor{i} c FULL JOIN seen{i} s USING (source))"""


@query(f"""
WITH crawled AS MATERIALIZED ({CRAWLED}),
cursor0 AS (SELECT ''::VARCHAR AS source, NULL::TIMESTAMP AS cursor, NULL::VARCHAR AS status, 0 AS accepted WHERE false),{','.join(map(_part_sql, range(PARTS)))}
SELECT source, cursor, status, accepted FROM cursor{PARTS}""")
def stream_cursors(spark, sf_dir):
    """Each source's cursor after a stream of four parts, which lets only newer items through."""
    crawled = _crawled(spark, sf_dir)
    schema, root = crawled.drop("part").schema, new_folder(spark, "cursors")
    cursors.in_parts(crawled, "part", PARTS, "crawled", lambda folder: cursors.run_cursors(spark.readStream.schema(schema).parquet(f"{folder}/part=*"), root))
    accepted = spark.read.schema(schema).parquet(f"{root}/accepted/batch=*").groupBy("source").agg(F.count("*").alias("accepted"))
    return cursors.cursors(spark, root).join(accepted, "source", "left").select("source", "cursor", "status", F.coalesce("accepted", F.lit(0)).alias("accepted"))


ASKED = "SELECT user_id::VARCHAR AS source, event_id AS item, ts AS made_at, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 13 = 0 THEN 403 WHEN event_id % 5 > 0 THEN 500 END ELSE 200 END AS code FROM events"


@query(f"""
WITH asked AS ({ASKED}),
runs AS (SELECT *, row_number() OVER w AS i, count(*) FILTER (code < 400) OVER w AS good FROM asked WINDOW w AS (PARTITION BY source ORDER BY made_at, item)),
streaks AS (SELECT *, CASE WHEN code < 400 THEN 0 ELSE row_number() OVER (PARTITION BY source, good ORDER BY i) - (good > 0)::INT END AS streak FROM runs),
trips AS (SELECT source, min(i) FILTER (code = 403 OR streak >= 3) AS trip FROM streaks GROUP BY source)
SELECT source, count(*) AS seen, count(*) FILTER (trip IS NULL OR i <= trip) AS made, count(*) FILTER ((trip IS NULL OR i <= trip) AND coalesce(code >= 400, true)) AS failed,
  count(*) FILTER (i > trip) AS skipped, arg_max(streak, i) FILTER (trip IS NULL OR i <= trip)::INT AS in_a_row, any_value(trip) IS NOT NULL AS tripped,
  CASE WHEN any_value(trip) IS NULL THEN NULL WHEN bool_or(i = trip AND code = 403) THEN 'HTTP 403' ELSE '3 failures in a row' END AS reason, any_value(made_at) FILTER (i = trip) AS tripped_at
FROM streaks JOIN trips USING (source) GROUP BY source""")
def stream_breakers(spark, sf_dir):
    """T4: each source's breaker after a stream of four parts: a 403 trips it at once, three failures in a row do, then nothing is asked."""
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    code = F.when(F.col("event_type") != "error", 200).when(F.col("event_id") % 13 == 0, 403).when(F.col("event_id") % 5 > 0, 500)
    asked = e.select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("item"), F.col("ts").alias("at"), code.alias("code"), F.least(F.expr("(day(ts) - 1) div 8"), F.lit(3)).cast("int").alias("part"))
    schema, root, states = asked.drop("part").schema, new_folder(spark, "breakers"), []

    def run(folder: str) -> None:
        stream = spark.readStream.schema(schema).parquet(f"{folder}/part=*")
        states.append(cursors.run_breakers(cursors.breakers(stream, "source", ["at", "item"], "code"), root))

    cursors.in_parts(asked, "part", PARTS, "asked", run)
    return states[-1]
