"""Institutions' prose as posts; with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, prose
from ..functions.text import with_once
from . import sqlrules as S
from .catalog import query
from .generated import Made

NOTICES = Made(
    "orders",
    "o_orderkey",
    text=(
        ["", "因工作需要，某学院面向全校公开招聘管理人员3名。", "面向校内招聘实验员 12 名。", "校外招聘教师5名。"],
        ["", "一、招聘岗位及人数 行政秘书2名、实验员 1 名。", "招聘岗位 教务科员10名；报名表3名；辅导员1000名。", "一、招聘岗位及岗位职责 岗位名称 职数 岗位职责 教学秘书 2 名 科研助理 3 名 ", "招聘岗位及人数 岗位名称 职数 实验师 0 名 管理员 4 名 ", "一、招聘岗位\n行政秘书2名\n"],
        ["", "二、任职基本条件 （一）学校编制内在岗教职工，本科及以上；（二）符合学校跨部门流动条件。", "应聘条件 本校在编人员", "三、岗位职责 负责日常工作 秘书 2 名 "],
        ["", "四、报名方式 见附件", "联系电话 0731 招聘人员9名", "报名时间 3月1日"],
    ),
)
N = "(?s:.*?)"
BLOB = f"regexp_replace(text, '{S.BLANKS}+', ' ', 'g')"
COND, DUTY = prose.CONDITIONS, prose.DUTIES


def _sum(v: str, p: str) -> str:
    return f"list_sum(list_filter(list_transform(regexp_extract_all({v}, '{p}', 1), lambda n: try_cast(n AS INT)), lambda n: n BETWEEN 1 AND 999))::INT"


SECTIONS = f"""a AS (SELECT id, text, {BLOB} AS blob FROM {NOTICES.sql} AS n),
b AS (SELECT *, {S.trim(f"regexp_extract(blob, '{prose.POSTS[0]}({N})(?:{prose.POSTS[1]})', 1)")} AS posts, {S.trim(f"regexp_extract(blob, '({DUTY[0]}{N})(?:{DUTY[1]})', 1)")} AS duties,
  {S.trim(f"regexp_extract(blob, '({COND[0]}{N})(?:{COND[1]})', 1)")} AS conditions FROM a),
c AS (SELECT *, coalesce(nullif(concat_ws(' ', nullif(posts, ''), nullif(duties, '')), ''), text) AS tab, coalesce(nullif(conditions, ''), text) AS q FROM b),
d AS (SELECT *, regexp_matches(tab, '{prose.TABLE}') AS is_table, regexp_replace(tab, '(?s){prose.TABLE_HEAD}', '') AS body FROM c)"""


@query(f"""
WITH {SECTIONS}
SELECT id, posts, conditions, coalesce(CASE WHEN is_table THEN {_sum('body', prose.TABLE_COUNT)} END, {_sum('posts', '([0-9]+)\\s*名')},
    (SELECT n FROM (SELECT try_cast(coalesce(nullif(regexp_extract(text, '{prose.LEADS[0]}', 1), ''), nullif(regexp_extract(text, '{prose.LEADS[1]}', 1), '')) AS INT) AS n) WHERE n BETWEEN 1 AND 999), 0)::INT AS headcount,
  concat_ws('；', {', '.join(f"CASE WHEN regexp_matches({'text' if n == '面向校内教职工' else 'q'}, '{p}') THEN '{n}' END" for n, p in prose.SCOPES)}) AS scope FROM d""")
def prose_facts(spark, sf_dir):
    """Sections, headcount and admitted people of prose notices."""
    c, blob = F.col("text"), F.col("blob")
    flat = with_once(NOTICES.rows(spark, sf_dir), blob=prose.flat(c))
    cut = with_once(flat, posts=prose.posts_section(blob), duties=prose.duties_section(blob), conditions=prose.conditions_section(blob))
    headcount = prose.headcount(c, F.col("posts"), F.col("duties"))
    return cut.select("id", "posts", "conditions", F.coalesce(headcount, F.lit(0)).alias("headcount"), F.array_join(prose.scopes(c, F.col("conditions")), "；").alias("scope"))


def _jobs(v: str, p: str) -> str:
    return f"list_zip(regexp_extract_all({v}, '{p}', 1), regexp_extract_all({v}, '{p}', 2))"


@query(f"""
WITH {SECTIONS},
raw AS (
  SELECT id, 1 AS way, unnest({_jobs('body', prose.TABLE_ROW)}) AS j, generate_subscripts({_jobs('body', prose.TABLE_ROW)}, 1) AS i FROM d WHERE is_table AND regexp_matches(text, '{fields.INTERNAL}') UNION ALL
  SELECT id, 2, unnest({_jobs('tab', prose.PAIR)}), generate_subscripts({_jobs('tab', prose.PAIR)}, 1) FROM d WHERE regexp_matches(text, '{fields.INTERNAL}') UNION ALL
  SELECT id, 3, [(regexp_extract(text, '{prose.OPEN_POST}', 1), regexp_extract(text, '{prose.OPEN_POST}', 2))][1], 1 FROM d WHERE regexp_matches(text, '{fields.INTERNAL}') AND regexp_matches(text, '{prose.OPEN_POST}')),
cut AS (SELECT id, way, i, {S.trim('j[1]')} AS t, CASE WHEN try_cast(j[2] AS INT) BETWEEN 1 AND 999 THEN j[2]::INT ELSE 1 END AS slots FROM raw WHERE NOT regexp_matches(j[1], '^[一二三四五六七八九十]+$')),
shown AS (SELECT id, way, i, {S.cut('t')} AS title, slots FROM cut),
good AS (SELECT * FROM shown WHERE ({S.bad_reason('title')}) IS NULL AND NOT regexp_matches(title, '{prose.NO_POST}')),
best AS (SELECT *, min(way) OVER (PARTITION BY id) AS used FROM good),
once AS (SELECT id, title, slots, min(i) AS i FROM best WHERE way = used GROUP BY ALL)
SELECT id, title, slots, row_number() OVER (PARTITION BY id ORDER BY i) AS place FROM once""")
def prose_jobs(spark, sf_dir):
    """The posts of internal notices, each once, in order."""
    rows = NOTICES.rows(spark, sf_dir).select("id", F.posexplode(prose.jobs(F.col("text"))).alias("place", "job"))
    return rows.select("id", "job.title", "job.slots", (F.col("place") + 1).cast("long").alias("place"))
