"""Search for subjects over generated postings; with equal SQL, which compares each term with each text."""

from __future__ import annotations

from ..operators import subjects
from . import sqlrules as S
from .catalog import query
from .generated import Made

CELLS = Made(
    "orders",
    "o_orderkey",
    major=(["", "", "（1）"], ["计算机科学与技术", "软件工程、网络安全", "法学", "会计学 审计学", "临床医学", "信 息 管理", "教育学/心理学", "不限专业", "电子", "IT 技术", "中国语言文学", "工", "政", ""], ["", "、数学", "，物联网工程", " 汉语"]),
    title=(["", "某大学", "人民医院"], ["教师", "护理岗", "管理人员", "Data Engineer", "辅导员", "", None]),
)
WANTED = Made("part", "p_partkey", keyword=(["", "", " "], ["计算机", "法学", "护理", "软件", "it 技术", "data", "心理 会计", "中国语言文学专业", "工", "天文", "政", " ", "Engineer", "大数据技术与应用"], ["", "", "　经济"]))
FAMILIES = ", ".join(f"('{f}', '{w}')" for f, words in subjects.FAMILIES.items() for w in dict.fromkeys(words.split()))


def _compact(v: str) -> str:
    return f"lower(regexp_replace({v}, '{S.BLANKS}+', '', 'g'))"


@query(f"""
WITH families(family, w) AS (VALUES {FAMILIES}),
tokens AS (SELECT keyword, {_compact('t')} AS t FROM (SELECT keyword, unnest(string_split_regex({S.trim('keyword')}, '{S.BLANKS}+')) AS t FROM (SELECT DISTINCT keyword FROM {WANTED.sql} AS w)) WHERE t <> ''),
related AS (SELECT DISTINCT keyword, family FROM tokens JOIN families ON contains(t, w) OR contains(w, t)),
terms AS (SELECT keyword, t AS term FROM tokens UNION SELECT keyword, w FROM related JOIN families USING (family)),
texts AS (SELECT id, whole, {_compact('whole')} AS f FROM (SELECT id, concat_ws(' ', nullif(major, ''), nullif(title, '')) AS whole FROM {CELLS.sql} AS c)),
parts AS (SELECT whole, {_compact('p')} AS p FROM (SELECT whole, unnest(string_split_regex(whole, '(?:[、,，;；/|｜]|{S.BLANKS})+')) AS p FROM (SELECT DISTINCT whole FROM texts)) WHERE p <> ''
          UNION SELECT DISTINCT whole, f FROM texts WHERE f <> ''),
found AS (SELECT DISTINCT keyword, whole FROM parts JOIN terms ON contains(term, p)
          UNION SELECT keyword, whole FROM (SELECT DISTINCT whole, f FROM texts WHERE f <> '') JOIN terms ON contains(f, term))
SELECT keyword, id FROM found JOIN texts USING (whole)""")
def subject_search(spark, sf_dir):
    """Postings that fit a keyword or another one of its family, by substrings and an index of letter pairs."""
    terms = subjects.expanded(WANTED.rows(spark, sf_dir), subjects.family_table(spark))
    return subjects.search(CELLS.rows(spark, sf_dir), terms, "id", ["major", "title"])
