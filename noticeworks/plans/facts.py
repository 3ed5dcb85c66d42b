"""Cleaned texts, and facts of texts and tables merged field by field, over generated readings; with equal SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions import lexicon as L
from ..operators import facts
from . import sqlrules as S
from .cards import _level
from .catalog import query
from .fields import PLACE, _count, _days
from .fields import fields as X
from .generated import Made

EDU = ["", None, "本科及以上", "硕士", "高中", "学历：大专", "详见公告"]
DAYS = ["", None, "2026-03-09", "2026年3月9日", "暂未公布", "3月9日", "2026年3月1日至2026年3月12日"]
COUNTS = ["", None, "3", "12名", "若干", "待定", "2026年"]
READINGS = Made(
    "orders",
    "o_orderkey",
    m_age=(["", None, "35周岁以下", "<b>40</b>周岁以下"],), a_age=(["", "30周岁以下", None],), b_age=(["", "45周岁"],),
    m_party=(["", None, "中共党员"],), a_party=(["", "不限"],),
    m_education=(EDU,), a_education=(EDU,), b_education=(["", "博士", "高中"],),
    m_gender=(["", None, "不限"],), a_gender=(["", "限女性"],),
    m_fresh=([None, None, True, False],), a_fresh=([None, True, False],),
    m_majors=(["", "", "法学|会计学", "法学"],), a_majors=(["", "会计学|数学", "法学|　"],), b_majors=(["", "数学|物理"],),
    m_notes=(["", None, "须能出差", "见附件\n---"],), a_notes=(["", "须能出差", "需夜班"],),
    m_deadline=(DAYS,), a_deadline=(DAYS,), b_deadline=(["", "2026/4/1"],),
    m_positions=(COUNTS,), a_positions=(COUNTS,),
    a_sum=([None, None, None, 0, 7],), b_sum=([None, None, 9],), a_slots=(["", "", "3|待定|4名", "若干|", "0"],), b_slots=(["", "2|2"],),
    m_silent=([None, False, False, False, True],),
)
KINDS = {"m": ("main", 0), "a": ("table", 1), "b": ("table", 2)}


def _readings(spark, sf_dir):
    """The rows of the generated texts and tables in long form."""
    wide = READINGS.rows(spark, sf_dir)
    names = {"table_sum": "sum", "job_slots": "slots", "no_recruitment": "silent"}

    def reading(prefix):
        kind, rank = KINDS[prefix]
        cells = []
        for f, t in facts.FACTS.items():
            name = f"{prefix}_{names.get(f, f)}"
            cell = F.col(name) if name in wide.columns else F.lit(None)
            cells.append((F.filter(F.split(cell, r"\|"), lambda x: x != "") if t.startswith("array") and name in wide.columns else cell).cast(t).alias(f))
        return wide.select("id", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), *cells)

    return reduce(lambda a, b: a.union(b), map(reading, KINDS))


def _edu(v: str) -> str:
    """The label of a stated education; labelled parts before the whole."""
    c, l1, l2 = S.collapse(v), S.collapse(f"regexp_extract({S.collapse(v)}, '{L.EDUCATION_LABELS[0]}', 1)"), S.collapse(f"regexp_extract({S.collapse(v)}, '{L.EDUCATION_LABELS[1]}', 1)")
    return f"nullif(CASE WHEN {c} = '' OR regexp_matches({c}, '{PLACE}') THEN '' WHEN regexp_matches({c}, '{L.ANY_EDUCATION}') THEN '无要求' ELSE coalesce(nullif({_level(l1)}, ''), nullif({_level(l2)}, ''), {_level(c)}) END, '')"


def _day(v: str) -> str:
    c = S.collapse(v)
    return f"CASE WHEN {c} <> '' AND NOT regexp_matches({c}, '{PLACE}') THEN {_days(c, (*X.RANGES, *X.SINGLE_DAYS))} END"


def _list(v: str) -> str:
    return f"list_filter(string_split(coalesce({v}, ''), '|'), lambda x: x <> '')"


def _first(*pairs: str) -> str:
    return f"coalesce({', '.join(pairs)})"


def _origin(*pairs: tuple[str, str]) -> str:
    return f"CASE {' '.join(f'WHEN {c} IS NOT NULL THEN {o!r}' for c, o in pairs)} END"


def _slot_sum(v: str) -> str:
    return f"list_sum(list_filter(list_transform({_list(v)}, lambda x: try_cast({_count(S.collapse('x'))} AS INT)), lambda n: n > 0))"


def _once(v: str) -> str:
    return f"list_filter(list_transform(range(len({v})), lambda i: CASE WHEN list_position({v}, ({v})[i + 1]) = i + 1 THEN ({v})[i + 1] END), lambda x: x IS NOT NULL)"


MERGED = f"""wide AS (
  SELECT id, coalesce(m_silent, false) AS silent, CASE WHEN NOT silent THEN nullif(m_age, '') END AS ma, nullif(a_age, '') AS aa, nullif(b_age, '') AS ba, CASE WHEN NOT silent THEN nullif(m_party, '') END AS mp, nullif(a_party, '') AS ap,
    CASE WHEN NOT silent THEN nullif(m_gender, '') END AS mg, nullif(a_gender, '') AS ag, CASE WHEN NOT silent THEN m_fresh END AS mf, a_fresh AS af, CASE WHEN NOT silent THEN nullif(m_education, '') END AS me, coalesce(nullif(a_education, ''), nullif(b_education, '')) AS te,
    CASE WHEN NOT silent THEN {_list('m_majors')} ELSE [] END AS mm, {_list('a_majors')} || {_list('b_majors')} AS tm, CASE WHEN NOT silent THEN nullif(m_notes, '') END AS mn, nullif(a_notes, '') AS an,
    CASE WHEN NOT silent THEN {_day('m_deadline')} END AS md, CASE WHEN NOT silent THEN coalesce({_day('a_deadline')}, {_day('b_deadline')}) END AS td, CASE WHEN NOT silent THEN {_count(S.collapse('m_positions'))} END AS mc, {_count(S.collapse('a_positions'))} AS tc,
    CASE WHEN a_sum > 0 THEN a_sum WHEN b_sum > 0 THEN b_sum END AS sums, CASE WHEN {_slot_sum('a_slots')} > 0 THEN {_slot_sum('a_slots')} WHEN {_slot_sum('b_slots')} > 0 THEN {_slot_sum('b_slots')} END AS counted,
    a_sum IS NOT NULL OR b_sum IS NOT NULL OR len(list_filter({_list('a_slots')} || {_list('b_slots')}, lambda x: ({_count(S.collapse('x'))}) IS NOT NULL)) > 0 AS tabled FROM {READINGS.sql} AS r),
labelled AS (SELECT *, {_edu("me")} AS mel, {_edu("te")} AS tel, {_once('(mm || tm)')} AS majors, CASE WHEN NOT silent THEN coalesce(sums::BIGINT::VARCHAR, counted::BIGINT::VARCHAR, tc, mc) END AS positions, coalesce(md, td) AS deadline FROM wide),
merged AS (
  SELECT id, coalesce(ma, aa, ba) AS age, coalesce(mp, ap) AS party, coalesce(mg, ag) AS gender, coalesce(mf, af) AS fresh,
    CASE WHEN silent THEN te WHEN me IS NOT NULL THEN coalesce(mel, te) ELSE coalesce(tel, te) END AS education, majors, nullif(concat_ws(chr(10), mn, CASE WHEN an IS DISTINCT FROM mn THEN an END), '') AS notes, deadline, positions,
    CASE WHEN deadline IS NULL THEN NULL WHEN md IS NOT NULL THEN 'main' ELSE 'table-fallback' END AS deadline_source, CASE WHEN try_cast(positions AS INT) IS NOT NULL AND tabled THEN 'table' WHEN positions IS NOT NULL THEN 'main-fallback' END AS positions_source,
    {_origin(('ma', 'main'), ('coalesce(aa, ba)', 'table'))} AS age_from, CASE WHEN silent THEN {_origin(('te', 'table'))} WHEN mel IS NOT NULL THEN 'main' ELSE {_origin(('te', 'table'))} END AS education_from,
    nullif(concat_ws('+', CASE WHEN len(mm) > 0 THEN 'main' END, CASE WHEN len(tm) > 0 THEN 'table' END), '') AS majors_from, CASE WHEN positions IS NOT NULL THEN CASE WHEN coalesce(sums::VARCHAR, counted::VARCHAR, tc) IS NOT NULL THEN 'table' ELSE 'main' END END AS positions_from FROM labelled)"""


@query(f"WITH {MERGED} SELECT * REPLACE (array_to_string(majors, '|') AS majors) FROM merged")
def merged_facts(spark, sf_dir):
    """Each field of a notice out of its text and two tables, and where it comes from."""
    merged = facts.merge_facts(_readings(spark, sf_dir), ["id"])
    origin = lambda f: F.try_element_at("origins", F.lit(f)).alias(f"{f}_from")
    return merged.select("id", "age", "party", "gender", "fresh", "education", F.array_join("majors", "|").alias("majors"), "notes", "deadline", "positions", "deadline_source", "positions_source", *map(origin, ("age", "education", "majors", "positions")))


def _clean(v: str) -> str:
    """clean_text, its patterns one after the other."""
    out = f"regexp_replace(coalesce({v}, ''), '[\\x{{FEFF}}\\x{{0001}}-\\x{{0008}}\\x{{000B}}\\x{{000C}}\\x{{000E}}-\\x{{001F}}\\x{{007F}}]', '', 'g')"
    for p in cleaning.SHEET_MARKS:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    out = f"regexp_replace(replace(regexp_replace({out}, '<[^>]+>', ' ', 'g'), '　', ' '), '[ \\t]{{2,}}', ' ', 'g')"
    return S.trim(f"array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda line: {S.trim('line')}), lambda line: line <> '' AND NOT regexp_matches(line, '^[-—–]{{2,}}$')), chr(10))")


@query(f"""
WITH {MERGED}, cleaned AS (
  SELECT id, nullif({_clean('age')}, '') AS age, nullif({_clean('notes')}, '') AS notes, {_edu('education')} AS education, {_once(f"list_filter(list_transform(majors, lambda m: {_clean('m')}), lambda m: m <> '')")} AS majors, party, gender, fresh, deadline, positions FROM merged)
SELECT id, age, notes, education, nullif(array_to_string(majors, '|'), '') AS majors,
  coalesce(age, party, gender, education, notes, deadline, positions) IS NOT NULL OR fresh IS NOT NULL OR len(majors) > 0 AS useful FROM cleaned""")
def cleaned_facts(spark, sf_dir):
    """Merged fields made readable, and whether any is of use."""
    cleaned = facts.clean_facts(facts.merge_facts(_readings(spark, sf_dir), ["id"]))
    return cleaned.select("id", "age", "notes", "education", F.array_join("majors", "|").alias("majors"), facts.is_useful(cleaned).alias("useful"))


SCRAPS = Made(
    "orders",
    "o_orderkey",
    body=(
        ["", "--- 工作表: Sheet1 ---\n", "---- 发现附件透视文本:岗位表 ----\n", "工作表:Sheet2", "Sheet3\n", "—— \n", "\x01\x7f"],
        ["某县公开招聘公告\n", "  招聘岗位  2 个\t\t名额\n", "<p class=\"a\">报名时间：3月1日</p>\n", ".nav-a { color: red }\n", "var a1 = document.x(1);公告\n", "　　缩进的正文　末尾　\n", "---\n", "a"],
        ["", "\n\n\n", "--- 工作表: 岗位 计划\n", "序号\t岗位\n", "正文" * 20 + "\n", "正文" * 60 + "\n"],
        ["", "结束 ---\n", "--\n最后一行", "—–—", " "],
    ),
    useful=([True, False],),
)


@query(f"""
WITH a AS (SELECT id, useful, {_clean('body')} AS v, {_clean(S.cut(S.trim('body')))} AS t FROM {SCRAPS.sql} AS s)
SELECT id, v AS cleaned, CASE WHEN length(t) < 2 OR {S.garbled('t')} OR regexp_matches(t, '{cleaning.NO_TITLE}') THEN '' ELSE left(t, 120) END AS title, length(v) >= 80 AND (useful OR length(v) >= 200) AS good FROM a""")
def cleaned_texts(spark, sf_dir):
    """Texts without marks, rules and tags, their titles, and whether they are read well."""
    c = F.col("body")
    return SCRAPS.rows(spark, sf_dir).select("id", cleaning.clean_text(c).alias("cleaned"), cleaning.clean_title(c).alias("title"), cleaning.is_good_reading(c, F.col("useful")).alias("good"))
