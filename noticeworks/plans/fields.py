"""Fields that are read out of notices' texts; with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, qualifications
from ..functions import lexicon as L
from ..operators import dedupe
from . import sqlrules as S
from .catalog import query
from .generated import Made

TEXTS = Made(
    "orders",
    "o_orderkey",
    dates=(["", "报名时间：", "网上报名时间 ", "报名截止：", "截止时间:", "发布于"], ["2026年3月1日至2026年3月9日", "2026年12月30日8时至1月5日17时", "2026年2月28日 - 3月2日", "2026-03-01　至 2026-03-09", "2026-03-01至2026-03-09", "2026.3.1 ~ 2026/3/9", "2026年3月5日", "2026/3/7", "即日起至2026年4月1日", "即日起到2026-4-2", "另行通知", "待定", "3月9日", ""], ["", "。逾期不候", "；附件"]),
    people=(["", "招聘计划 12 名", "计划招录:若干", "拟招聘3名", "名额 1200", "名额：5", "岗位 7 个", "招聘若干人员", "合计 30 人", "共2026年", "招聘人数：待定", "拟招 8人", "招聘计划　12 名", "名额： 5"],),
    cell=(["3", "12名", "约 5 人", "0", "若干", "2026年", "—", "暂无", "1000", "3-5", "", None],),
    demands=(["", "中共党员优先", "限党员", "不限是否党员", "党员不限", "群众"], ["", "，男性", "，限女性", "，性别不限", "，性别要求：男\n", "，性别要求:  "], ["", "，限应届毕业生", "，不限应届", "，社会人员", "，须为应届"], ["", "\n其他要求：能适应夜班工作", "\n备注: 见附件说明", "\n备注：略", "\n备注：　须能适应夜班"]),
    quals=(["", "具有教师资格证", "须持有会计从业资格证书", "持C1驾驶证", "中级及以上职称", "职称", "副高级以上专业技术职称", "主治医师资格"], ["", "，英语六级及以上", "、大学英语四级", "；CET-6", "，普通话水平二级甲等及以上", "、cet4"], ["", "；3年以上工作经验", "，学历证书", "，身份证明", "；法律职业资格证书、一级建造师", "|讲师职称", "/副教授以上"], ["", "；面向全校教职工", "，本校在编人员", "；学校编制内在岗职工"]),
    file=(["报名表.docx", "岗位表.xlsx", "zpbmb.pdf", "附件1 应聘登记表", "计划.xls"], ["", " 推荐材料"]),
)
PLACE = f"(?i){L.NO_EDUCATION}"


def _day(v: str, p: str, g: tuple[int, int, int]) -> str:
    y, m, d = (f"regexp_extract({v}, '{p}', {i})" for i in g)
    return f"CASE WHEN regexp_matches({v}, '{p}') THEN {y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') END"


def _days(v: str, shapes) -> str:
    return f"coalesce({', '.join(_day(v, p, g) for p, g in shapes)})"


LABEL = S.collapse(f"regexp_extract(dates, '{fields.DEADLINE_LABEL}', 1)")


@query(f"""
WITH a AS (SELECT *, {S.collapse('dates')} AS v, {LABEL} AS label FROM {TEXTS.sql} AS t)
SELECT id, {_days('v', fields.RANGES)} AS range_end, CASE WHEN v <> '' AND NOT regexp_matches(v, '{PLACE}') THEN {_days('v', (*fields.RANGES, *fields.SINGLE_DAYS))} END AS stated,
  coalesce({_days('dates', [(p, (1, 2, 3)) for p in fields.SIGN_UP])}, CASE WHEN label <> '' AND NOT regexp_matches(label, '{PLACE}') THEN {_days('label', (*fields.RANGES, *fields.SINGLE_DAYS))} END,
    {_days('dates', [(fields.RANGES[3][0], (1, 2, 3))])}, {_days('v', fields.RANGES)}) AS deadline FROM a""")
def deadline_strings(spark, sf_dir):
    """Ends of ranges, single days and the closing day that a text states."""
    c = F.col("dates")
    return TEXTS.rows(spark, sf_dir).select("id", fields.range_end(c).alias("range_end"), fields.deadline_text(c).alias("stated"), fields.deadline_in(c).alias("deadline"))


def _count(v: str) -> str:
    n = f"try_cast(coalesce(nullif(regexp_extract({v}, '^([0-9]{{1,3}})$', 1), ''), nullif(regexp_extract({v}, '([0-9]{{1,3}})(?:\\s*(?:名|人|个))?$', 1), '')) AS INT)"
    return f"CASE WHEN {v} = '' OR regexp_matches({v}, '{PLACE}') THEN NULL WHEN contains({v}, '若干') THEN '若干' WHEN NOT regexp_matches({v}, '[年月日]') AND {n} BETWEEN 1 AND 999 THEN {n}::VARCHAR END"


STATED = [f"try_cast(nullif(regexp_extract(people, '{p}', 1), '') AS INT)" for p in fields.COUNTS]


@query(f"""
WITH a AS (SELECT *, {S.collapse('cell')} AS c, {', '.join(f"regexp_extract(people, '{p}', 1) AS l{i}" for i, p in enumerate(fields.LABELLED_COUNTS))} FROM {TEXTS.sql} AS t)
SELECT id, {_count('c')} AS cell_count, coalesce({', '.join(f'CASE WHEN {n} BETWEEN 1 AND 999 THEN ({n})::VARCHAR END' for n in STATED)}, {', '.join(_count(f'l{i}') for i in range(len(fields.LABELLED_COUNTS)))},
  try_cast(nullif(regexp_extract(people, '{fields.INLINE_COUNT}', 1), '') AS INT)::VARCHAR, CASE WHEN regexp_matches(people, '{fields.SEVERAL}') THEN '若干' END) AS stated FROM a""")
def headcounts(spark, sf_dir):
    """Headcounts of cells and of texts."""
    return TEXTS.rows(spark, sf_dir).select("id", fields.headcount(F.col("cell")).alias("cell_count"), fields.headcount_in(F.col("people")).alias("stated"))


GENDER = S.collapse(f"regexp_extract(demands, '{fields.GENDER_LABEL}', 1)")


@query(f"""
SELECT id, CASE WHEN {' OR '.join(f"contains(demands, '{w}')" for w in L.PARTY_WORDS)} THEN '中共党员' WHEN regexp_matches(demands, '{fields.NO_PARTY}') THEN '不限' END AS party,
  coalesce(nullif({GENDER}, ''), CASE {' '.join(f"WHEN regexp_matches(demands, '{p}') THEN '{n}'" for n, p in fields.GENDERS)} END) AS gender,
  CASE WHEN regexp_matches(demands, '{fields.FRESH}') THEN true WHEN regexp_matches(demands, '{fields.NOT_FRESH}') THEN false END AS fresh,
  coalesce({', '.join(f"nullif({S.collapse(f'''regexp_extract(demands, '{p}', 1)''')}, '')" for p in fields.NOTES)}) AS notes,
  regexp_matches(file || ' ' || demands, '{fields.FORM_FILE}') AS is_form, regexp_matches(quals, '{fields.INTERNAL}') AS internal FROM {TEXTS.sql} AS t""")
def people_demands(spark, sf_dir):
    """Membership, gender, fresh graduates and notes that a text states, forms, internal notices."""
    c, d = F.col, F.col("demands")
    return TEXTS.rows(spark, sf_dir).select("id", fields.party(d).alias("party"), fields.gender(d).alias("gender"), fields.fresh_graduates(d).alias("fresh"), fields.notes(d).alias("notes"), fields.is_form_file(c("file"), d).alias("is_form"), fields.is_internal(c("quals")).alias("internal"))


Q = qualifications
NAMES = "[" + ", ".join(f"'{n}'" for n in Q.CATALOG) + "]"
FRAGMENT = S.trim("x")
for _ in range(4):
    FRAGMENT = S.trim(f"regexp_replace({FRAGMENT}, '{Q.LEAD}', '')")
FRAGMENT = S.trim(f"regexp_replace({FRAGMENT}, '[，,；;。].*$', '')")
NAMED = "CASE " + " ".join(f"WHEN contains(x, '{n}') THEN '{n}'" for n in sorted(Q.CATALOG, key=len, reverse=True)) + " ELSE x END"
RANKED = f"(contains(x, '职称') AND regexp_matches(x, '{Q.RANKS}'))"
IS_ITEM = f"""(length(x) BETWEEN 3 AND 32 AND NOT regexp_matches(x, '{Q.FRAGMENT}') AND NOT regexp_matches(x, '^(?:及|或)?以上(?:职称|学历|学位)?$|^及以上(?:职称)?$') AND (NOT contains(x, '职称') OR {RANKED})
  AND NOT regexp_matches(x, '{Q.BLOCKED}') AND NOT regexp_matches(x, '{Q.BLOCKED_ENDS}') AND NOT regexp_matches(x, '{Q.NO_CERTIFICATE}') AND NOT starts_with(x, '证')
  AND NOT (ends_with(x, '证') AND NOT regexp_matches(x, '(?:资格证|执业证)$') AND NOT ({' OR '.join(f"contains(x, '{n}')" for n in Q.CATALOG)}))
  AND ({' OR '.join(f"contains(x, '{n}')" for n in Q.CATALOG)} OR {' OR '.join(f"contains('{n}', x)" for n in Q.CATALOG)} OR (contains(x, '普通话') AND contains(x, '级'))
    OR (regexp_matches(x, '(?i)英语|CET') AND regexp_matches(x, '[四五六八]')) OR regexp_matches(x, '[0-9]+\\s*年(?:以上)?(?:相关)?(?:工作|从教|从业|基层)?经验') OR {RANKED}
    OR regexp_matches(x, '[一-龥]{{2,12}}(?:执业)?(?:资格)?证书$|[一-龥]{{2,8}}(?:资格|执业)证$')))"""


def _raw(v: str) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({v}, '{'(?i)' if p.startswith('(?:CET') else ''}{p}')" for p in Q.PATTERNS) + "])"


@query(f"""
WITH a AS (SELECT id, quals AS blob, list_filter(list_transform(string_split_regex(quals, '[；;\\n\\r|｜/、,，]+'), lambda x: {S.trim('x')}), lambda x: length(x) >= 2) AS clauses FROM {TEXTS.sql} AS t),
parts AS (SELECT id, 0 AS k, blob AS part FROM a UNION ALL SELECT id, i, clauses[i] FROM (SELECT id, clauses, unnest(range(1, len(clauses) + 1)) AS i FROM a)),
raw AS (SELECT *, {_raw('part')} AS hits, list_filter({NAMES}, lambda n: contains(part, n)) AS listed FROM parts),
named AS (SELECT *, list_transform(list_filter(list_transform(list_transform(hits, lambda x: {FRAGMENT}), lambda x: {NAMED}), lambda x: {IS_ITEM}),
    lambda x: CASE WHEN regexp_matches(x, '(?i)普通话|英语|CET') THEN regexp_replace(x, '(?:及)?以上$', '') ELSE x END) AS items FROM raw),
scoped AS (SELECT *, CASE WHEN k = 0 THEN list_filter(flatten([{', '.join(f"regexp_extract_all(part, '{p}')" for p in Q.SCOPE)}]), lambda x: length(x) BETWEEN 4 AND 32) ELSE []::VARCHAR[] END AS scope FROM named),
every AS (SELECT id, k, i, list_concat(list_concat(listed, items), scope)[i] AS item FROM (SELECT *, unnest(range(1, len(listed) + len(items) + len(scope) + 1)) AS i FROM scoped)),
firsts AS (SELECT id, item, min(k * 1000 + i) AS pos FROM every GROUP BY id, item),
kept AS (SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM firsts g WHERE g.id = f.id AND g.item <> f.item AND contains(g.item, f.item))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM kept)
SELECT a.id, coalesce(string_agg(item, '、' ORDER BY pos) FILTER (r <= 8), '') AS items FROM a LEFT JOIN ranked USING (id) GROUP BY a.id""")
def qualification_items(spark, sf_dir):
    """Certificates, ranks, levels and scope that a notice demands, at most eight."""
    rows = TEXTS.rows(spark, sf_dir).select("id", "quals")
    return dedupe.per_text(rows, "quals", items=lambda v: F.array_join(qualifications.items(v), "、")).select("id", "items")
