"""Rules of titles, deadlines, subjects, places and addresses over generated rows; with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, majors, rules, urls
from ..functions import lexicon as L
from ..operators import matching, merging
from . import sqlrules as S
from . import tables as T
from .catalog import query
from .generated import POSTINGS, Made
from .links import LINKS
from .subjects import CELLS

CORE = " OR ".join(f"contains(v, '{w}')" for w in L.CORE_WORDS)


@query(f"""
WITH a AS (SELECT id, {S.collapse('title')} AS v FROM {POSTINGS.sql} AS p)
SELECT id, {S.menu('v')} AS menu, {CORE} AS core, {S.other_notice('v')} AS other, length(v) >= 6 AND ({CORE}) AND NOT {S.other_notice('v')} AS admitted, length(v) >= 6 AND NOT {S.other_notice('v')} AS admitted_anyway FROM a""")
def title_admission(spark, sf_dir):
    """Which titles are admitted, with and without a word for posts."""
    c = F.col("title")
    return POSTINGS.rows(spark, sf_dir).select("id", rules.is_navigation(c).alias("menu"), rules.has_core_word(c).alias("core"), rules.is_other_notice(c).alias("other"), rules.is_admitted(c).alias("admitted"), rules.is_admitted(c, False).alias("admitted_anyway"))


WRITTEN = Made("orders", "o_orderkey", deadline=(["", "", "截止", " "], ["2026-05-10", "2026-2-31", "2026年5月9日", "另行通知", "长期", "2026-05-05", "2025年13月1日", "2026-05-15", "2026-05-04", "no date", "2026-0-1", "2024-2-29", None], ["", "", " 前", "　17时", "（详见公告）"]))
AT = "2026-05-10 12:00:00"


@query(f"""
WITH p AS (SELECT id, {S.trim('deadline')} AS v FROM {WRITTEN.sql} AS w),
q AS (SELECT id, v, v = '' OR regexp_matches(v, '{L.NO_DEADLINE}') AS placeholder, regexp_matches(v, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') AS iso FROM p),
s AS (SELECT *, CASE WHEN iso THEN regexp_extract(v, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') ELSE replace(replace(replace(regexp_extract(v, '[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日'), '年', '-'), '月', '-'), '日', '') END AS ymd FROM q),
e AS (SELECT id, placeholder, CASE WHEN NOT placeholder THEN try_cast(split_part(ymd, '-', 1) AS INT) END AS y, try_cast(split_part(ymd, '-', 2) AS INT) AS m, try_cast(split_part(ymd, '-', 3) AS INT) AS d FROM s),
f AS (SELECT id, placeholder, (make_date(y, 1, 1) + to_months(m - 1) + to_days(d - 1))::TIMESTAMP + INTERVAL 86399 SECOND AS ends FROM e)
SELECT id, placeholder, ends, coalesce(ends + INTERVAL 5 DAY < TIMESTAMP '{AT}', false) AS expired, coalesce(ends < TIMESTAMP '{AT}', true) AS archivable, coalesce(ends >= TIMESTAMP '{AT}', false) AS visible,
  coalesce(NOT (ends + INTERVAL 7 DAY < TIMESTAMP '{AT}') AND ends >= TIMESTAMP '{AT}', false) AS public, ceil(date_diff('second', TIMESTAMP '{AT}', ends) / 86400.0)::INT AS days FROM f""")
def written_deadlines(spark, sf_dir):
    """Deadlines as written, and what follows from them."""
    at, c = F.lit(AT).cast("timestamp"), F.col("deadline")
    end = dates.deadline_end(c)
    public = ~dates.is_expired(end, at, 7) & dates.is_visible(end, at)
    return WRITTEN.rows(spark, sf_dir).select("id", dates.is_placeholder(c).alias("placeholder"), end.alias("ends"), dates.is_expired(end, at, 5).alias("expired"), dates.is_archivable_text(c, at).alias("archivable"), dates.is_visible(end, at).alias("visible"), public.alias("public"), dates.days_left(end, at).alias("days"))


LISTED = Made("orders", "o_orderkey", cell=(["", "", "（1）", "(2) ", "A01", "0812", "1、"], ["教育学 0402", "专业不限", "会计学、财务管理，会计学", "计算机科学与技术0812/软件工程", "不限", "无", "详见", "B12临床医学", "法", "IT法", "X", "35周岁以下", "获得职称者优先", "—", "详见官网原文", "数学；2、物理", ""], ["", "（3）　心理学", " 【0703】化学", "|数学", "同上", "、" + "文" * 30]))
NAMES = f"list_filter(list_transform(range(len({T._names('v')})), lambda i: CASE WHEN list_position({T._names('v')}, ({T._names('v')})[i + 1]) = i + 1 THEN ({T._names('v')})[i + 1] END), lambda n: n IS NOT NULL)"


@query(f"""
WITH a AS (SELECT id, {S.trim('cell')} AS v FROM {LISTED.sql} AS l),
b AS (SELECT *, CASE WHEN v = '' OR regexp_matches(v, '{L.ANY_MAJOR}') THEN [] ELSE {NAMES} END AS names, {T._strip('v')} AS rest, {T._is_major('v')} AS is_cell FROM a)
SELECT id, array_to_string(names, '|') AS names, CASE WHEN v IN ('', '—', '详见官网原文') THEN '无要求' WHEN regexp_matches(v, '{L.ANY_MAJOR}') THEN '不限专业' WHEN len(names) > 0 THEN array_to_string(names, '、') WHEN {T._is_name('rest')} THEN rest ELSE '无要求' END AS label, is_cell FROM b""")
def subject_cells(spark, sf_dir):
    """Subjects of cells without marks and codes, their label, and whether a cell holds any."""
    c = F.col("cell")
    return LISTED.rows(spark, sf_dir).select("id", F.array_join(majors.names(c), "|").alias("names"), majors.label(c).alias("label"), majors.is_major_cell(c).alias("is_cell"))


def _limit(v: str, patterns) -> str:
    numbers = [f"try_cast(nullif(regexp_extract({v}, '{p}', 1), '') AS INT)" for p in patterns]
    return f"coalesce({', '.join(f'CASE WHEN {n} BETWEEN 1 AND 199 THEN {n} END' for n in numbers)})"


@query(f"""
WITH a AS (SELECT id, source, {S.trim('raw_text')} AS v FROM {POSTINGS.sql} AS p),
b AS (SELECT *, coalesce(28 > {_limit('v', L.TEXT_AGE_LIMITS)}, false) OR {' OR '.join(f"contains(v, '{w}')" for w in L.TEXT_PARTY_WORDS)} AS against FROM a)
SELECT source, count(*) AS n, count(*) FILTER (v <> '' AND against) AS conflict, count(*) FILTER (v <> '' AND NOT against AND contains(v, '教师')) AS perfect, count(*) FILTER (v = '' OR NOT against AND NOT contains(v, '教师')) AS normal FROM b GROUP BY source""")
def text_match_tally(spark, sf_dir):
    """The matcher of bare texts, counted by status and source."""
    status = matching.text_status(F.lit(28), F.lit(False), F.lit("教师"), F.col("raw_text"))
    rows = POSTINGS.rows(spark, sf_dir).select("source", status.alias("status"))
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return rows.groupBy("source").agg(F.count("*").alias("n"), count("CONFLICT"), count("PERFECT"), count("NORMAL"))


WANTED = (("湖南省", "全部"), ("全部", "长沙市"), ("广西壮族自治区", "桂 林"), ("全部", "全部"))


def _token(v: str) -> str:
    return f"regexp_replace(regexp_replace({S.trim(v)}, '{L.REGION_ENDINGS}', '', 'g'), '{S.BLANKS}+', '', 'g')"


def _fits(own: str, wanted: str) -> str:
    if wanted == "全部":
        return "true"
    w = _token(f"'{wanted}'")
    return f"(starts_with({own}, {w}) OR starts_with({w}, {own}) OR contains(whole, {w}))"


@query(f"""
WITH a AS (SELECT id, {S.trim("concat_ws('·', province, city)")} AS raw FROM {POSTINGS.sql} AS p),
b AS (SELECT id, {_token("split_part(raw, '·', 1)")} AS p, {_token("CASE WHEN contains(raw, '·') THEN split_part(raw, '·', 2) ELSE '' END")} AS c, {_token('raw')} AS whole FROM a)
SELECT id, {', '.join(f"{_fits('p', p)} AND {_fits('c', c)} AS fits{i}" for i, (p, c) in enumerate(WANTED))} FROM b""")
def region_matches(spark, sf_dir):
    """Provinces and cities against places; empty parts fit anything."""
    place = F.concat_ws("·", "province", "city")
    return POSTINGS.rows(spark, sf_dir).select("id", *[rules.region_matches(place, F.lit(p), F.lit(c)).alias(f"fits{i}") for i, (p, c) in enumerate(WANTED)])


READ = Made("orders", "o_orderkey", page=(["", "a|b", None],), prose=(["", "c", "d|e|f", None],), sheet=(["", "g", None],), text=(["h", "", None],))
ORDER = ("page", "prose", "sheet", "text")


@query(f"""
SELECT id, CASE {' '.join(f"WHEN coalesce({c}, '') <> '' THEN '{c}'" for c in ORDER)} END AS origin, coalesce({', '.join(f"nullif({c}, '')" for c in ORDER)}, '') AS rows_text FROM {READ.sql} AS r""")
def reading_cascade(spark, sf_dir):
    """Of several readings of a notice, the first that found rows."""
    parts = READ.rows(spark, sf_dir).select("id", *[F.filter(F.split(c, r"\|"), lambda x: x != "").alias(c) for c in ORDER])
    return merging.first_candidates(parts, ORDER).select("id", "origin", F.coalesce(F.array_join("rows", "|"), F.lit("")).alias("rows_text"))


@query(rf"SELECT id, nullif(lower(regexp_extract(url, '(?i)\.(xlsx|xls|pdf|docx)(?:\?|#|$)', 1)), '') AS kind FROM {LINKS.sql} AS l WHERE NOT starts_with(lower(url), 'javascript:')")
def attachment_links(spark, sf_dir):
    """kinds of attachments by their addresses, scripts left out."""
    rows = LINKS.rows(spark, sf_dir).filter(~F.lower("url").startswith("javascript:"))
    return rows.select("id", urls.attachment_kind(F.col("url")).alias("kind"))


NORMAL = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '[?#].*$', ''), '(?i)/index\.html?$', ''), '^([a-zA-Z]+://[^/]+/.*)/$', '\1'))"
KNOWN = Made("customer", "c_custkey", address=(["https://", "http://", "HTTP://"], ["rsc.hnu.edu.cn", "WWW.school.edu.cn", "hr.corp.com"], ["", "/list.htm", "/rsxx/", "/rsxx/index.html", "/INDEX.HTML?x=1", "/info/1012/3456.htm#top", "/column/5/"]))


@query(f"""
WITH known AS (SELECT {NORMAL.format('address')} AS key, min(id) AS source, count(*) AS n FROM {KNOWN.sql} AS k GROUP BY 1)
SELECT l.id, {NORMAL.format('url')} AS key, k.source, k.n, CASE WHEN k.source IS NULL THEN 'new' ELSE 'existing' END AS status FROM {LINKS.sql} AS l LEFT JOIN known k ON k.key = {NORMAL.format('url')}""")
def candidate_status(spark, sf_dir):
    """Links that are sources already, by their address in normal form, and new ones."""
    known = KNOWN.rows(spark, sf_dir).groupBy(urls.normal(F.col("address")).alias("key")).agg(F.min("id").alias("source"), F.count("*").alias("n"))
    rows = LINKS.rows(spark, sf_dir).select("id", urls.normal(F.col("url")).alias("key"))
    return rows.join(known, "key", "left").select("id", "key", "source", "n", F.when(F.col("source").isNull(), "new").otherwise("existing").alias("status"))
