"""Postings against a profile, and what their cards show; with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import regions, rules
from ..functions.text import with_once
from ..operators import matching
from . import sqlrules as S
from .catalog import query
from .generated import POSTINGS, Made

PROFILE = {"age": 32, "major": "法学", "party": False}
#: Test input: part of a dictionary, in its order.
REGIONS = {"北京": ("东城", "海淀"), "广西": ("南宁", "桂林"), "湖南": ("长沙", "株洲", "湘潭"), "新疆": ("乌鲁木齐",)}


def _limit(v: str) -> str:
    return ", ".join(f"CASE WHEN try_cast(nullif(regexp_extract({v}, '{p}', 1), '') AS INT) BETWEEN 1 AND 199 THEN regexp_extract({v}, '{p}', 1)::INT END" for p in L.AGE_LIMITS)


MATCHED = f"""a AS (SELECT *, concat_ws(chr(10), title, raw_text, party, notes) AS job FROM {POSTINGS.sql} AS p WHERE NOT deleted),
b AS (SELECT *, coalesce({_limit("coalesce(age_limit, '')")}, {_limit('job')}) AS age_most, ({' OR '.join(f"contains(job, '{w}')" for w in L.PARTY_WORDS)}) AS wants_party,
  (major LIKE '%法学%' OR (coalesce(major, '') <> '' AND contains('法学', major)) OR contains(job, '法学') OR {' OR '.join(f"contains(concat_ws(chr(10), job, major), '{w}')" for w in L.ANY_MAJOR_WORDS)}) AS fits FROM a),
matched AS (SELECT *, CASE WHEN coalesce(32 > age_most, false) OR wants_party THEN 'CONFLICT' WHEN coalesce(fits, false) THEN 'PERFECT' ELSE 'NORMAL' END AS matched_status,
  CASE WHEN coalesce(32 > age_most, false) THEN 'over age by ' || (32 - age_most) || CASE WHEN wants_party THEN '|party membership' ELSE '' END WHEN wants_party THEN 'party membership' ELSE '' END AS reasons FROM b)"""


def _matched(spark, sf_dir):
    c = F.col
    rows = POSTINGS.rows(spark, sf_dir).filter(~c("deleted"))
    job = F.concat_ws("\n", "title", "raw_text", "party", "notes")
    majors = F.array_compact(F.array(c("major")))
    return with_once(rows, match=matching.status(F.lit(PROFILE["age"]), F.lit(PROFILE["party"]), F.lit(PROFILE["major"]), F.coalesce("age_limit", F.lit("")), job, majors))


@query(f"""
WITH {MATCHED} SELECT id, matched_status AS status, reasons, published FROM matched
ORDER BY CASE matched_status WHEN 'PERFECT' THEN 0 WHEN 'NORMAL' THEN 1 ELSE 2 END, published DESC NULLS LAST, id LIMIT 2000""")
def match_ranked_feed(spark, sf_dir):
    """Live postings against a profile, the best first and newest first among equals."""
    c = F.col
    rows = _matched(spark, sf_dir).select("id", c("match.status").alias("status"), F.array_join("match.reasons", "|").alias("reasons"), "published")
    return rows.orderBy(matching.rank(c("status")), F.desc_nulls_last("published"), "id").limit(2000)


@query(f"WITH {MATCHED} SELECT id, CASE WHEN status IN ('PERFECT', 'NORMAL', 'CONFLICT') THEN status ELSE matched_status END AS status, status IS NOT NULL AS from_server FROM matched")
def server_or_local_status(spark, sf_dir):
    """The stored status where it is one of the three, else that of the local match."""
    c = F.col
    stored = F.coalesce(c("status").isin(*matching.RANK), F.lit(False))
    return _matched(spark, sf_dir).select("id", F.when(stored, c("status")).otherwise(c("match.status")).alias("status"), stored.alias("from_server"))


NAMES = "[" + ", ".join(f"'{p}'" for p in REGIONS) + "]"


def _province(v: str) -> str:
    raw = f"regexp_replace({S.collapse(v)}, '{regions.PROVINCE_END}', '')"
    return f"CASE WHEN {raw} = '' THEN '' ELSE coalesce(list_filter({NAMES}, lambda n: starts_with({raw}, n) OR starts_with(n, {raw}))[1], {raw}) END"


def _cities(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} = '{name}' THEN [{', '.join(repr(c) for c in own)}]" for name, own in REGIONS.items()) + " ELSE []::VARCHAR[] END"


def _city(v: str, p: str) -> str:
    """Of a place without its ending and a province in normal form."""
    return f"""CASE WHEN {v} = '' OR regexp_matches({v}, '{regions.NO_CITY}') THEN '' ELSE coalesce(list_filter({_cities(p)}, lambda n: starts_with({v}, n) OR starts_with(n, {v}))[1],
      CASE WHEN {p} IN ('北京', '天津', '上海', '重庆') AND ({v} = {p} OR starts_with({p}, {v})) THEN {p} END, CASE WHEN length({v}) BETWEEN 2 AND 8 THEN {v} END, '') END"""


def _bare(v: str) -> str:
    return f"regexp_replace({S.collapse(v)}, '{regions.CITY_END}', '')"


@query(f"""
WITH a AS (SELECT id, city, coalesce(raw_text, '') AS t, {_province("coalesce(nullif(province, ''), source_province)")} AS hint, {_province(f"regexp_extract(coalesce(raw_text, ''), '{regions.ADMINISTRATIVE}', 1)")} AS named,
  {_bare('city')} AS own, {_bare(f"regexp_extract(coalesce(raw_text, ''), '{regions.ADMINISTRATIVE}', 2)")} AS adm, {_bare(f"regexp_extract(coalesce(raw_text, ''), '{regions.WORKPLACE}', 1)")} AS work FROM {POSTINGS.sql} AS p),
b AS (SELECT *, CASE WHEN named <> '' THEN named ELSE hint END AS p1 FROM a),
c AS (SELECT *, coalesce(nullif({_city('adm', 'p1')}, ''), nullif({_city('work', 'p1')}, ''), CASE WHEN p1 <> '' THEN list_filter({_cities('p1')}, lambda n: contains(t, n))[1] END, '') AS found,
  CASE WHEN p1 <> '' THEN p1 ELSE coalesce(list_filter({NAMES}, lambda n: contains(t, n))[1], '') END AS p2 FROM b),
d AS (SELECT *, CASE WHEN hint <> '' THEN hint ELSE p2 END AS p3, {_bare('found')} AS f FROM c),
e AS (SELECT *, coalesce(nullif({_city('own', 'p3')}, ''), nullif({_city('f', 'p3')}, ''), '') AS c3 FROM d)
SELECT id, CASE WHEN p3 <> '' AND c3 <> '' AND p3 <> c3 THEN p3 || ' · ' || c3 WHEN p3 <> '' THEN p3 ELSE c3 END AS place, p2 AS text_province, found AS text_city FROM e""")
def region_display(spark, sf_dir):
    """The place that a card shows, and the one that its text names."""
    c = F.col
    place = regions.shown(c("province"), c("city"), c("source_province"), F.lit(None).cast("string"), c("raw_text"), REGIONS)
    hint = F.coalesce(F.nullif("province", F.lit("")), "source_province")
    named = regions.inferred(c("raw_text"), hint, REGIONS)
    return with_once(POSTINGS.rows(spark, sf_dir), place=place, named=named).select("id", F.col("place"), c("named.province").alias("text_province"), c("named.city").alias("text_city"))


LEVELS = (("博士", "博士"), ("硕士", "硕士"), ("本科", "本科"), ("大专", "大专"))
CELL = S.trim("major")


@query(f"""
SELECT id, coalesce(contains(education, '本科'), false) AS for_bachelors, coalesce(regexp_matches({CELL}, '{L.ANY_MAJOR}'), false) AS any_major,
  regexp_matches({CELL}, '^[A-Z][0-9]{{1,3}}$') OR regexp_matches({CELL}, '^[0-9]{{2,4}}$') AS is_code,
  CASE WHEN slots > 0 THEN slots || ' 人' WHEN regexp_matches(coalesce(positions, ''), '^[0-9]+$') THEN positions || ' 人' WHEN coalesce(positions, '') IN ('', '—', '不限', '无') THEN '—' ELSE positions END AS slots_label,
  CASE WHEN {S.trim('age_limit')} IN ('', '—', '不限', '无') THEN '—' ELSE {S.trim('age_limit')} END AS age, CASE WHEN {S.trim('party')} IN ('', '—', '不限', '无') THEN '—' ELSE {S.trim('party')} END AS party
FROM {POSTINGS.sql} AS p""")
def card_fields(spark, sf_dir):
    """P2, P4, P8 in part, F24, F29, F30: labels of a card's fields and the filters over them."""
    c = F.col
    cell = rules.cell(c("major"))
    return POSTINGS.rows(spark, sf_dir).select("id", rules.fits_education(c("education"), "本科").alias("for_bachelors"), rules.any_major(c("major")).alias("any_major"), rules.is_post_code(cell).alias("is_code"), rules.slots_label(c("slots"), c("positions")).alias("slots_label"), rules.shown_field(c("age_limit")).alias("age"), rules.shown_field(c("party")).alias("party"))


EDUCATION = Made(
    "orders",
    "o_orderkey",
    cell=(["", "学历：", "学历要求: ", "学位要求：", "专业要求法学，", "学校坐落于长沙，", "某学院岗位 "], ["", "全日制", "不限，", "—"], ["本科及以上", "硕士研究生", "研究生（学历）", "博士研究生及以上", "大专以上", "大学专科", "高中", "学士学位", "无要求", "无", "详见公告", "本科或大专学历的毕业生均可参加报名考试与面试", ""], ["", "；学位：硕士", "，经验不限"]),
    status=(["PERFECT", "CONFLICT", "NORMAL", "active", "inactive", "error", "paused", "", None],),
    reason=(["", " ", "年龄超限3岁", "限党员", "政治面貌", "专业不符", "其他"],),
)


def _level(v: str) -> str:
    """The label of a text that is collapsed already."""
    phrases = f"regexp_extract_all({v}, '{L.EDUCATION_PHRASE}')"
    longest = f"coalesce(list_filter({phrases}, lambda x: length(x) = list_max(list_transform({phrases}, lambda y: length(y))))[1], {v})"
    cases = " ".join(f"WHEN regexp_matches({longest}, '{p}'){' AND NOT contains(' + longest + ', ' + repr('专科') + ')' if n.startswith('本科') else ''} THEN '{n}'" for n, p in L.EDUCATION)
    return f"CASE WHEN {v} = '' OR regexp_matches({v}, '(?i){L.NO_EDUCATION}') THEN '' WHEN regexp_matches({v}, '{L.ANY_EDUCATION}') THEN '无要求' {cases} ELSE '' END"


@query(f"""
WITH a AS (SELECT *, {S.collapse('cell')} AS v FROM {EDUCATION.sql} AS e),
b AS (SELECT *, {S.collapse(f"regexp_extract(v, '{L.EDUCATION_LABELS[0]}', 1)")} AS l1, {S.collapse(f"regexp_extract(v, '{L.EDUCATION_LABELS[1]}', 1)")} AS l2 FROM a),
c AS (SELECT *, CASE WHEN v = '' OR regexp_matches(v, '(?i){L.NO_EDUCATION}') THEN '' WHEN regexp_matches(v, '{L.ANY_EDUCATION}') THEN '无要求' ELSE coalesce(nullif({_level('l1')}, ''), nullif({_level('l2')}, ''), {_level('v')}) END AS level FROM b)
SELECT id, level, v <> '' AND length(v) <= 48 AND NOT regexp_matches(v, '{L.SCHOOL_PROSE}') AND NOT (regexp_matches(v, '{L.NO_EDUCATION_CELL}') AND length(v) > 16) AND level <> '' AS is_cell FROM c""")
def education_cells(spark, sf_dir):
    """The level that a cell asks for, and whether it is such a cell at all."""
    c = F.col("cell")
    return EDUCATION.rows(spark, sf_dir).select("id", rules.normal_education(c).alias("level"), rules.is_education_cell(c).alias("is_cell"))


@query(f"""
SELECT id, CASE status WHEN 'PERFECT' THEN '[ 🔥 完美匹配 ]' WHEN 'CONFLICT' THEN CASE WHEN contains(reason, '年龄') THEN '[ ❌ 年龄超限 ]' WHEN regexp_matches(reason, '政治|党员|面貌') THEN '[ ❌ 政治面貌不符 ]'
    WHEN contains(reason, '专业') THEN '[ ❌ 专业不符 ]' ELSE '[ ❌ 条件冲突 ]' END ELSE '[ · 无冲突 ]' END AS match_label,
  CASE status WHEN 'active' THEN '正常' WHEN 'inactive' THEN '停用' WHEN 'error' THEN '异常' ELSE coalesce(nullif(status, ''), '—') END AS source_label FROM {EDUCATION.sql} AS e""")
def status_labels(spark, sf_dir):
    """What cards and lists call a status."""
    c = F.col
    return EDUCATION.rows(spark, sf_dir).select("id", rules.match_label(c("status"), F.array(F.lit(" "), c("reason"))).alias("match_label"), rules.source_label(c("status")).alias("source_label"))
