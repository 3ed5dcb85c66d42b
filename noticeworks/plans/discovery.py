"""Discovery over links that the order lines make, the janitor's five counters, and order by Chinese collation; with equal SQL."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import dates, institutions
from ..operators import discovery, snapshots
from ..sources.shared import new_folder
from . import sqlrules as S
from .catalog import NOW, now, query, t
from .generated import POSTINGS, PROVINCES, Made
from .links import HOST, RULES

SITES = ["rsc.hnu.edu.cn", "rst.hunan.gov.cn", "www.moe.gov.cn", "hr.corp.com", "zp.xxx.edu.cn", "WWW.hunnu.edu.cn"]
NODES = 1200
TITLES = ["人才引进", "湖南某学院招聘公告", "中南大学招聘信息", "中南大学林业招聘", "湖南大学科技招聘", "通知", "湘潭大学 人才 招聘", "某医院人事处", "English", ""]


def _url(n: str) -> str:
    """The address of a numbered page, in words of both engines."""
    site = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SITES))
    return f"('https://' || CASE {n} % {len(SITES)} {site} END || CASE {n} % 4 WHEN 0 THEN '/zpxx/index.htm?p=' WHEN 1 THEN '/rsxx/' WHEN 2 THEN '/news/' ELSE '/zp/list#' END || CAST({n} AS STRING))"


FROM, TO = f"(l_orderkey % {NODES})", f"((l_partkey * 7 + l_linenumber * 31) % {NODES})"
LINKS = Made("lineitem", "(l_orderkey * 10 + l_linenumber)", page=(_url(FROM),), url=(_url(TO),), title=(TITLES,))
SEEDS = [0, 13, 601]
FOLLOW = "招聘|zp|rsxx|rsgz|gsgg|sydwzp"
BUT = [(n, b) for n, _, b in institutions.KNOWN if b]


def _known(what: int) -> str:
    v = S.collapse("title")
    named = " ".join(f"WHEN contains({f'''replace({v}, '{k[0]}{k[2]}', '')''' if k[2] else v}, '{k[0]}') THEN '{k[what]}'" for k in institutions.KNOWN)
    return f"CASE {named} END"


def _name_sql() -> str:
    v = S.collapse("title")
    first = f"coalesce(nullif(regexp_extract({v}, '{institutions.NAMES[0]}', 1), ''), nullif(regexp_extract({v}, '{institutions.NAMES[1]}', 1), ''))"
    hosts = " ".join(f"WHEN contains(h, '{d}') THEN '{n}'" for d, n in institutions.HOSTS.items())
    return f"CASE WHEN length({first}) >= 4 THEN {first} {hosts} WHEN contains(h, '.edu.cn') THEN split_part(h, '.', 1) || '.edu.cn' ELSE coalesce(nullif(left({v}, 40), ''), h) END"


LOCAL = "(" + " OR ".join(f"contains(h, '{d}')" for d in institutions.HOSTS) + ")"
KEY = r"lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '(?i)/index\.html?$', ''), '^([a-zA-Z]+://[^/]+/.*)/$', '\1'))"


@query(rf"""
WITH RECURSIVE links AS MATERIALIZED (SELECT page, url, title, {HOST.format('url')} AS h, {HOST.format('page')} AS ph FROM {LINKS.sql.replace('STRING', 'VARCHAR')} AS l),
steps AS (SELECT DISTINCT page, url FROM links WHERE h = ph AND regexp_matches(lower(url || ' ' || title), '{FOLLOW}')),
walk(url, depth) AS (SELECT u, 0 FROM (VALUES {', '.join(f"({_url(str(n)).replace('STRING', 'VARCHAR')})" for n in SEEDS)}) AS s(u) UNION SELECT l.url, w.depth + 1 FROM walk w JOIN steps l ON l.page = w.url WHERE w.depth < 3),
visited AS (SELECT url AS page, min(depth) AS depth FROM walk GROUP BY url),
seen AS (SELECT l.*, depth, lower(l.url) AS u FROM links l JOIN visited USING (page)),
scored AS (SELECT *, {RULES} + CASE WHEN regexp_matches(title, '招聘|招贤|引才|人才|人事') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(u, 'index\.html?(?:\?|#|$)') AND regexp_matches(u, 'zpxx|zp|rsxx|招聘') THEN 1 ELSE 0 END AS score FROM seen),
own AS (SELECT url, title, score, depth, {_name_sql()} AS name FROM scored WHERE score >= 4 AND ((ends_with(h, '.edu.cn') AND (contains(title, '湖南') OR contains(h, 'hn') OR {LOCAL})) OR (contains(h, 'hunan.gov.cn') AND regexp_matches(title, '招聘|招贤|人事')) OR contains(title, '湖南')) AND NOT regexp_matches(h, '(?:^|\.)moe\.gov\.cn$')),
guessed AS (SELECT {_known(1)} AS url, title, 7 AS score, depth, {_known(0)} AS name FROM seen WHERE regexp_matches(title, '招聘|引才|人才') AND {_known(0)} IS NOT NULL),
best AS (SELECT *, {KEY} AS key FROM (SELECT * FROM own UNION ALL SELECT * FROM guessed) QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY score DESC, depth, url, title) = 1)
SELECT key, url, title, score, depth, name, CASE WHEN regexp_matches(name, '大学|学院|学校') AND contains(lower(url), '.edu.cn') THEN '高校' WHEN regexp_matches(name, '医院|中心|研究所') THEN '事业单位'
  WHEN regexp_matches(name || ' ' || url, 'rst\.hunan\.gov|人社|人事') THEN '事业单位' WHEN contains(url, 'jyt.') THEN '其他' ELSE '事业单位' END AS kind FROM best""")
def discovered_sources(spark, sf_dir):
    """Sources found within three links of seed pages, each by its best link."""
    links = LINKS.rows(spark, sf_dir)
    seeds = spark.range(1).selectExpr(f"explode(array({', '.join(_url(str(n)) for n in SEEDS)})) AS url")
    host = discovery.urls.host
    follow = (host(F.col("url")) == host(F.col("page"))) & F.lower(F.concat_ws(" ", "url", "title")).rlike(FOLLOW)
    visited = discovery.walk(links, seeds, follow, 3)
    return discovery.candidates(links, visited, institutions.is_local(F.col("title"), F.col("url")))


STATES = {"jobs": ("orders", "o_orderkey", "o_orderdate", "o_orderstatus = 'F'"), "postings": ("lineitem", "l_orderkey * 10 + l_linenumber", "l_shipdate", "l_returnflag = 'R'"), "raw": ("events", "event_id", "ts", "event_type = 'error'")}
ROWS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {key} AS id, CAST({at} AS TIMESTAMP) AS deadline, {gone} AS is_deleted, CASE WHEN {gone} THEN CAST({at} AS TIMESTAMP) END AS deleted_at FROM {table}" for k, (table, key, at, gone) in STATES.items())
LATE = f"NOT is_deleted AND kind <> 'raw' AND deadline + INTERVAL 1 DAY * CASE kind WHEN 'postings' THEN 5 ELSE 0 END < TIMESTAMP '{NOW}'"
OLD = f"is_deleted AND deleted_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY"


@query(f"""
WITH r AS ({ROWS})
SELECT count(*) FILTER ({LATE}) AS soft_deleted, count(*) FILTER ({LATE} AND kind = 'postings') AS postings_archived, count(*) FILTER ({OLD} AND kind = 'jobs') AS evaporated_jobs,
  count(*) FILTER ({OLD} AND kind = 'postings') AS evaporated_postings, count(*) FILTER ({OLD} AND kind = 'raw') AS evaporated_raw, count(*) FILTER (NOT coalesce({OLD}, false)) AS kept, count(*) FILTER (({LATE}) OR (is_deleted AND NOT ({OLD}))) AS in_trash FROM r""")
def janitor_run(spark, sf_dir):
    """One pass that rewrites the snapshot counts what it does; what is left is read from the new one."""
    rows = None
    for kind, (table, key, at, gone) in STATES.items():
        part = t(spark, sf_dir, table).selectExpr(f"'{kind}' AS kind", f"{key} AS id", f"CAST({at} AS TIMESTAMP) AS deadline", f"{gone} AS is_deleted", f"CASE WHEN {gone} THEN CAST({at} AS TIMESTAMP) END AS deleted_at")
        rows = part if rows is None else rows.union(part)
    seen = Observation("janitor")
    new = snapshots.janitor(rows, now(), {"jobs": 0, "postings": 5}, "kind", seen)
    path = new_folder(spark, "snapshot")
    new.write.parquet(path)
    counted = seen.get
    left = spark.read.schema(new.schema).parquet(path).agg(F.count("*").alias("kept"), F.count_if("is_deleted").alias("in_trash"))
    names = {"soft_deleted": ("late_jobs", "late_postings"), "postings_archived": ("late_postings",), "evaporated_jobs": ("gone_jobs",), "evaporated_postings": ("gone_postings",), "evaporated_raw": ("gone_raw",)}
    return left.select(*[F.lit(sum(counted.get(c) or 0 for c in cs)).cast("long").alias(n) for n, cs in names.items()], "kept", "in_trash")


@query(f"""
WITH p AS (SELECT province, count(*) AS n FROM {POSTINGS.sql} AS p WHERE coalesce(province, '') <> '' GROUP BY province)
SELECT province, n, row_number() OVER (ORDER BY province COLLATE zh) AS place FROM p""")
def provinces_in_order(spark, sf_dir):
    """Provinces by Chinese collation, with their postings."""
    counted = POSTINGS.rows(spark, sf_dir).filter("coalesce(province, '') <> ''").groupBy("province").agg(F.count("*").alias("n"))
    # The provinces are few: one row each.
    place = F.row_number().over(snapshots.everything().orderBy(F.collate("province", "zh")))
    return counted.select("province", "n", place.cast("long").alias("place"))
