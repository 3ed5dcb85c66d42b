"""Rows of the administration's lists, profiles, health of crawls and pages of the home list; with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import majors, profiles, titles
from ..functions.text import with_once
from ..operators import sequences, snapshots
from . import sqlrules as S
from . import tables as T
from .board import SHOWN
from .catalog import query, t
from .generated import POSTINGS, Made


def _rows(spark, sf_dir, deleted: bool):
    c = F.col
    return POSTINGS.rows(spark, sf_dir).filter(c("deleted") if deleted else ~c("deleted"))


def _listed(rows):
    c = F.col
    owner = F.coalesce(F.nullif("organization", F.lit("")), "source")
    title = titles.card_title(c("title"), c("announcement"), c("raw_text"), F.coalesce(c("source"), F.lit("")) != "")
    return with_once(rows, owner=titles.organization(owner, c("source")), card_title=title)


SUBJECTS = f"CASE WHEN mv IN ('', '—', '详见官网原文') THEN '无要求' WHEN regexp_matches(mv, '{L.ANY_MAJOR}') THEN '不限专业' WHEN len({T._names('mv')}) > 0 THEN array_to_string(list_filter(list_transform(range(len({T._names('mv')})), lambda i: CASE WHEN list_position({T._names('mv')}, ({T._names('mv')})[i + 1]) = i + 1 THEN ({T._names('mv')})[i + 1] END), lambda n: n IS NOT NULL), '、') WHEN {T._is_name(T._strip('mv'))} THEN {T._strip('mv')} ELSE '无要求' END"


@query(f"""
WITH {SHOWN}, e AS (SELECT *, {S.trim('major')} AS mv FROM shown)
SELECT id, card_title AS title, source, owner AS organization, province, deadline, published, coalesce(slots, try_cast(positions AS INT), 0) AS slots, {SUBJECTS} AS majors, row_number() OVER (ORDER BY id DESC) AS place FROM e""")
def admin_rows(spark, sf_dir):
    """Live postings as the administration lists them, newest first."""
    c = F.col
    rows = _listed(sequences.numbered(_rows(spark, sf_dir, False), [F.desc("id")]))
    slots = F.coalesce(c("slots"), c("positions").try_cast("int"), F.lit(0))
    return rows.select("id", c("card_title").alias("title"), "source", c("owner").alias("organization"), "province", "deadline", "published", slots.alias("slots"), majors.label(c("major")).alias("majors"), "place")


@query(f"""WITH {SHOWN.replace('WHERE NOT deleted', 'WHERE deleted')} SELECT id, card_title AS title, source, coalesce(deadline, '') AS deadline FROM shown""")
def trash_rows(spark, sf_dir):
    """Deleted postings as the trash lists them."""
    return _listed(_rows(spark, sf_dir, True)).select("id", F.col("card_title").alias("title"), "source", F.coalesce("deadline", F.lit("")).alias("deadline"))


ASKED = Made("orders", "o_orderkey", match=([None, None, "1", "0"],), age=([None, "35", " 40岁", "x", "", "-3"],), major=([None, "", " 法学 "],), member=([None, None, "1", "true", "0"],), politics=([None, "", "党员", "中共党员", "非党员", "群众", "预备党员 "],))
NUMBER = f"try_cast(nullif(regexp_extract({S.trim('age')}, '^([+-]?[0-9]{{1,9}})', 1), '') AS INT)"


@query(f"""
WITH a AS (SELECT *, {S.trim('politics')} AS said, coalesce({NUMBER}, 28) AS n FROM {ASKED.sql} AS q),
b AS (SELECT *, CASE WHEN member IS NOT NULL THEN member IN ('1', 'true') ELSE contains(said, '党员') AND NOT regexp_matches(said, '非党员|群众') END AS is_member,
  coalesce(match, age, major, member, politics) IS NOT NULL AND match IS DISTINCT FROM '0' AS given, coalesce(member IN ('1', 'true'), false) OR contains(coalesce(politics, ''), '党员') AS kept_member FROM a)
SELECT id, CASE WHEN given THEN n END AS age, CASE WHEN given THEN {S.trim('major')} END AS major, CASE WHEN given THEN is_member END AS member, CASE WHEN given THEN coalesce(nullif(said, ''), CASE WHEN is_member THEN '党员' ELSE '群众' END) END AS politics,
  n || ' 岁 · ' || CASE WHEN kept_member THEN '党员' ELSE '群众' END || ' · ' || coalesce(nullif({S.trim('major')}, ''), '辅导员') AS label FROM b""")
def applicant_profiles(spark, sf_dir):
    """Profiles as requests give them and as they are stored, and their labels."""
    c = F.col
    asked = profiles.requested(c("match"), c("age"), c("major"), c("member"), c("politics"))
    stored = profiles.stored(c("age"), c("major"), F.coalesce(c("member").isin("1", "true"), F.lit(False)), c("politics"))
    rows = with_once(ASKED.rows(spark, sf_dir), r=asked, s=stored)
    return rows.select("id", "r.age", "r.major", "r.member", "r.politics", profiles.label(c("s.age"), c("s.member"), c("s.major")).alias("label"))


@query("""
WITH known AS (SELECT c_custkey % 200 AS school, 'HEALTHY' AS status, 0::BIGINT AS successes, NULL::VARCHAR AS message FROM customer GROUP BY 1),
ran AS (SELECT user_id % 230 AS school, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS errors, max(ts) AS last_run FROM events GROUP BY 1),
new AS (SELECT school, CASE WHEN successes = 0 THEN 'BROKEN' WHEN errors > successes THEN 'DEGRADED' ELSE 'HEALTHY' END AS status, successes, CASE WHEN errors > 0 THEN errors || ' errors' END AS message, last_run FROM ran),
both_sides AS (SELECT coalesce(k.school, n.school) AS school, coalesce(n.status, k.status) AS status, CASE WHEN n.school IS NULL THEN k.successes ELSE n.successes END AS successes, CASE WHEN n.school IS NULL THEN k.message ELSE n.message END AS message, last_run FROM known k FULL JOIN new n ON k.school = n.school)
SELECT *, row_number() OVER (ORDER BY status, school) AS place FROM both_sides""")
def crawl_health(spark, sf_dir):
    """The last run of each school taken into its health, broken ones first."""
    known = t(spark, sf_dir, "customer").select((F.col("c_custkey") % 200).alias("school")).distinct().select("school", F.lit("HEALTHY").alias("status"), F.lit(0).cast("long").alias("successes"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("timestamp").alias("last_run"))
    good = F.col("event_type") != "error"
    ran = t(spark, sf_dir, "events").groupBy((F.col("user_id") % 230).alias("school")).agg(F.count_if(good).alias("successes"), F.count_if(~good).alias("errors"), F.max(F.col("ts").cast("timestamp")).alias("last_run"))
    status = F.when(F.col("successes") == 0, "BROKEN").when(F.col("errors") > F.col("successes"), "DEGRADED").otherwise("HEALTHY")
    new = ran.select("school", status.alias("status"), "successes", F.when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" errors"))).alias("message"), "last_run")
    merged = snapshots.upsert(known, new, ["school"], ["status", "successes", "message", "last_run"], [F.col("last_run")])
    # One row a school.
    return merged.withColumn("place", F.row_number().over(snapshots.everything().orderBy("status", "school")).cast("long"))


PAGE = 20
ASKED_PAGES = {"low": -3, "second": 2, "past": 10**6}
LIVE = f"SELECT id, published FROM {POSTINGS.sql} AS p WHERE NOT deleted AND status = 'PERFECT'"


@query(f"""
WITH live AS ({LIVE}), sized AS (SELECT greatest(1, ceil(count(*) / {PAGE}.0))::BIGINT AS pages FROM live),
asked AS (SELECT name, least(greatest(number, 1), pages) AS page, pages FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in ASKED_PAGES.items())}) AS a(name, number), sized),
placed AS (SELECT id, row_number() OVER (ORDER BY published DESC NULLS LAST, id) AS place FROM live)
SELECT name, page, pages, id, place - (page - 1) * {PAGE} AS place FROM asked JOIN placed ON place > (page - 1) * {PAGE} AND place <= page * {PAGE}""")
def home_pages(spark, sf_dir):
    """Pages of the home list, the number asked for held to those there are."""
    live = POSTINGS.rows(spark, sf_dir).filter("NOT deleted AND status = 'PERFECT'").select("id", "published")
    order = [F.desc_nulls_last("published"), F.col("id")]
    out = None
    for name, number in ASKED_PAGES.items():
        rows, page, pages = sequences.clamped_page(live, order, number, PAGE)
        place = F.row_number().over(snapshots.everything().orderBy(*order)).cast("long")
        part = rows.select(F.lit(name).alias("name"), F.lit(page).cast("long").alias("page"), F.lit(pages).cast("long").alias("pages"), "id", place.alias("place"))
        out = part if out is None else out.union(part)
    return out
