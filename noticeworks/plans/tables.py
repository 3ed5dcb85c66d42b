"""Wrapped lines to table rows, composite headers, broken rows and jobs, over generated sheets; with equal SQL.

The SQL walks each sheet line by line and row by row with the open row, the number and the longest row as its state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import majors as M
from ..operators import requirements as R
from ..operators import tables as T
from ..operators.dedupe import alike
from ..sources.shared import written
from . import sqlrules as S
from .catalog import query
from .generated import Made

TITLES = ["", "某县2026年公开招聘公告\n", "附件1 透视表\n", "--- 工作表\n序号\t说明\n", "岗位计划\t计划数\n"]
HEADERS = [
    "序号\t招聘单位\t岗位名称\t岗位代码\t计划数\t学历\t专业要求\t年龄要求\t其他要求\n",
    "序号\t单位\t单位\t岗位\t代码\t人数\t学历\t专业\t年龄\t面试方式\t比例\t其他要求\n",
    "序号\t单位\t所属部门\t岗位\n名称\t代码\t计划数\t学历学位\t专业要求\t年龄\t备注\n",
    "序号\t主管部门\t招聘单位\t岗位\n\t\t\t名称\t岗位代码\n计划数\t学历\t专业要求\t年龄\t其他要求\n",
    "序号\t单位\t单位\t岗位名称\t岗位代码\t计划数\n学历要求\t专业\t年龄\t面试\t比例\t其他条件\n",
    "编号\t内容\n",
]
ROWS = [
    "1\t湖南学院\t湖南学院\t教师\tA01\t2\t硕士研究生\t（1）教育学 0402 （2）心理学\t35周岁以下\t面试\t1:3\t限高校毕业生\n",
    "湖南学院\t湖南学院\t辅导员\tA02\t1\t本科\t法学、会计学\t40周岁及以下\t面试\t1:2\t\n",
    "3\t湖南学院\t实验员\tB3\t3\t大专以上\t专业不限\t35周岁以下\t实操\t1:3\t职称优先\n",
    "7 湖南学院\t湖南学院\t教务员\t12\t若干\t博士\t计算机类\t年龄在45周岁 面试\t1:3\t无\n",
    "湖南学院\t湖南学院\t校医\tC04\t1\t本科及以上\t临床医学 （1）内科学\t40周岁以下 直接考核\t\t应届\n",
    "9\t第二中学\t第二中学\t教师\t岗位\t1\t本科\t数学\t35周岁\t面试\t1:3\t\n",
    "5\t市医院\t人事处\t护士\t301\t4人\t大专\t护理学\t不超过30周岁\t\t资格证\n",
    "\t市医院\t岗位\tX1\t1\t高中\t\t\t\n",
    "6\t湖南学院\t硕士岗\tD01\n（2）应用心理学\t教育学\t35周岁以下\t限高校\t1:3\n",
    "8\t湖南学院\t湖南学院\t会计\tE05\t\"2\"\t学士\t\n会计学、\n审计学\n",
    "2 市图书馆\t管理员\t77\t1\t无要求\t\"图书馆学\"\t35周岁以下 实操\n\t户籍不限\t咨询电话1\n",
    "合计\t\t\t\t12\n",
    "小计\t湖南学院\t湖南学院\t1\t2\t3\n",
    "序号\t岗位名称\t学历\n",
    "备注：以上岗位\n",
    "",
    "",
]
ENDS = ["", "", "注：\n9\t不\t算\t教师\n", "结构化岗位表\n1\t不\t算\n", "报名时间另行通知\n"]
SHEETS = Made("orders", "o_orderkey", body=(TITLES, HEADERS, ROWS, ROWS, ROWS, ROWS, ENDS))
TAB, MARK = "chr(9)", "chr(1)"


def _sheets(spark, sf_dir, group="o_orderkey"):
    """group, id and table, a digest, of each sheet; and the lines of each distinct table. Some of their blanks are wide ones.

    What is made of a sheet depends on its lines alone, so it's made for each distinct table and joined to the sheets. The lines of a
    sheet whose key comes several times are as many times there.
    """
    body = F.when(F.col("id") % 3 == 0, F.replace("body", F.lit(" "), F.lit("\u3000"))).when(F.col("id") % 3 == 1, F.replace("body", F.lit(" "), F.lit("\u00a0"))).otherwise(F.col("body"))
    sheets, tables = alike(SHEETS.once(spark, sf_dir, group).withColumn("body", body), ["copies", "body"], "table")
    lines = tables.select("table", "copies", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    return sheets, lines.select("table", "line_no", F.explode(F.array_repeat("line", F.col("copies").cast("int"))).alias("line"))


def _of_each(sheets, made):
    """Rows that were made of tables, for each sheet."""
    return sheets.select("id", "table").join(written(made, "made"), "table")


# --- the SQL's parts ---------------------------------------------------------------------------------------------

B = S.BLANKS
CJK = "[一-龥]"


def _clean(v: str) -> str:
    return S.trim(f"""regexp_replace(regexp_replace({v}, '^"|"$', '', 'g'), '{B}+', ' ', 'g')""")


def _cells(v: str) -> str:
    return f"list_transform(string_split({v}, {TAB}), lambda raw: {_clean('raw')})"


def _spaced(v: str) -> str:
    return f"regexp_replace({v}, '^([0-9]{{1,3}}){B}+({CJK})', '\\1' || {TAB} || '\\2')"


def _any(v: str, p: str) -> str:
    return f"regexp_matches({v}, '{p}')"


def _count(row: str) -> str:
    return f"len(list_filter({row}, lambda f: f <> ''))"


def _at(row: str, i: str) -> str:
    return f"CASE WHEN {i} >= 0 THEN coalesce(({row})[({i}) + 1], '') ELSE '' END"


def _lead(row: str) -> str:
    head = f"coalesce(({row})[1], '')"
    return f"CASE WHEN {_any(head, '^[0-9]{1,3} .+$')} THEN [regexp_extract({head}, '^([0-9]+) ', 1), regexp_extract({head}, '^[0-9]+ (.+)$', 1)] || ({row})[2:] ELSE {row} END"


def _strip(v: str) -> str:
    out = f"regexp_replace(regexp_replace({S.collapse(v)}, '{M.LIST_MARK}', ' ', 'g'), '{M.CATALOG_NUMBER}', ' ', 'g')"
    out = f"regexp_replace({out}, '\\b{M.CODE}\\b', ' ', 'g')"
    for p in M.LEADING_CODES:
        out = f"regexp_replace({out}, '{p}', '\\1')"
    return S.collapse(out)


def _is_name(v: str) -> str:
    return f"(length({v}) BETWEEN 2 AND 24 AND NOT {_any(v, '^[A-Z][0-9]{1,3}$|^[0-9]+$')} AND {_any(v, CJK)} AND NOT {_any(v, M.NO_NAME)})"


def _names(v: str) -> str:
    marked = f"list_filter(string_split(regexp_replace({v}, '({M.LIST_MARK})', {MARK} || '\\1', 'g'), {MARK}), lambda s: s <> '')"
    chunks = f"(CASE WHEN len({marked}) > 1 THEN {marked} ELSE string_split_regex({v}, '{M.SEPARATORS}') END)"
    return f"list_filter(flatten(list_transform({chunks}, lambda chunk: regexp_extract_all({_strip('chunk')}, '{M.NAME}'))), lambda n: {_is_name('n')})"


def _is_major(v: str) -> str:
    return f"""CASE WHEN {v} = '' THEN false WHEN {_any(v, L.ANY_MAJOR)} THEN true WHEN {_any(v, M.NO_MAJOR_CELL)} THEN false WHEN {_any(v, M.LIST_MARK)} THEN length({v}) <= 4000
      WHEN length({v}) > 200 OR ({_any(v, M.NUMBERED_PROSE[0])} AND {_any(v, M.NUMBERED_PROSE[1])}) THEN false ELSE len({_names(v)}) > 0 OR (length({v}) <= 24 AND {_is_name(_strip(v))}) END"""


def _level(v: str) -> str:
    return f"CASE WHEN {_any(v, '不限|无要求')} THEN '无要求' WHEN {_any(v, '博士')} THEN '博士研究生及以上' WHEN {_any(v, '硕士|研究生')} THEN '硕士研究生及以上' WHEN {_any(v, '本科|学士')} THEN '本科及以上' WHEN {_any(v, '大专|专科')} THEN '大专及以上' ELSE '' END"


HEADER_LINE = f"contains(v, {TAB}) AND ((contains(v, '序号') AND contains(v, '岗位')) OR (contains(v, '计划数') AND contains(v, '专业要求')) OR {_any('v', '岗位代码|笔试科目')})"


def _step() -> str:
    """One piece of a wrapped line: a flag and the cells in, the same out."""
    c = f"string_split(acc[2:], {TAB})"
    empty, late = f"coalesce(nullif(list_position({c}, ''), 0), 0)", f"coalesce(nullif(list_position(({c})[6:], ''), 0) + 5, 0)"

    def put(at: str) -> str:
        return f"(CASE WHEN {at} > 0 THEN array_to_string(({c})[1 : {at} - 1] || [piece] || ({c})[{at} + 1 :], {TAB}) ELSE acc[2:] || {TAB} || piece END)"

    mark = "^[（(]\\s*[0-9]{1,2}\\s*[)）]"
    return f"""CASE WHEN piece = '' THEN acc WHEN acc[1] = 't' OR {_any('piece', T.CONTINUED_TAIL)} THEN 't' || {put(late)}
      WHEN {_any('piece', mark)} THEN 'f' || array_to_string(({c})[1 : -2] || [{S.trim(f"({c})[-1] || ' ' || piece")}], {TAB}) ELSE 'f' || {put(empty)} END"""


LINES = f"""raw AS (
  SELECT id, unnest(string_split(CASE id % 3 WHEN 0 THEN replace(body, ' ', chr(12288)) WHEN 1 THEN replace(body, ' ', chr(160)) ELSE body END, chr(10))) AS line,
         generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM {SHEETS.sql} AS s),
trimmed AS (SELECT id, line_no, {_spaced(S.trim('line'))} AS v FROM raw),
used AS (
  SELECT * FROM trimmed WHERE v <> '' AND NOT starts_with(v, '---') AND NOT (contains(v, '附件') AND contains(v, '透视'))
  QUALIFY NOT bool_or({_any('v', '^注[:：]?$|^结构化岗位表')}) OVER (PARTITION BY id ORDER BY line_no)),
kinds AS MATERIALIZED (
  SELECT id, line_no, v, row_number() OVER (PARTITION BY id ORDER BY line_no) AS k, length(v) - length(replace(v, {TAB}, '')) AS tabs, {HEADER_LINE} AS header FROM used),
marked AS MATERIALIZED (
  SELECT *, NOT header AND ((regexp_matches(v, '^[0-9]+' || {TAB}) AND tabs >= 1) OR (regexp_matches(v, '^[0-9]+{B}+[^\\s\\x{{00a0}}\\x{{3000}}]') AND tabs >= 2)) AS fresh,
         NOT header AND tabs >= 2 AND NOT {_any('v', '^[（(]' + B + '*[0-9]{1,2}' + B + '*[)）]')} AND {_count(_cells('v'))} >= 4 AS alone FROM kinds),
walk(id, k, began, pending, flushed, flushed_at, pushed) AS (
  SELECT DISTINCT id, 0::BIGINT, 0::BIGINT, NULL::VARCHAR[], NULL::VARCHAR[], 0::BIGINT, NULL::VARCHAR[] FROM marked
  UNION ALL
  SELECT w.id, m.k, CASE WHEN starts THEN m.line_no ELSE w.began END,
         CASE WHEN m.header THEN NULL WHEN starts THEN {_lead('cells')} WHEN w.pending IS NULL THEN NULL
              WHEN tabs > 0 THEN string_split((list_reduce(['f' || array_to_string(w.pending, {TAB})] || cells, lambda acc, piece: {_step()}))[2:], {TAB})
              ELSE w.pending[1 : -2] || [{S.trim("w.pending[-1] || ' ' || m.v")}] END,
         CASE WHEN m.header OR starts THEN w.pending END, w.began,
         CASE WHEN m.header OR (w.pending IS NULL AND NOT starts AND tabs > 0 AND {_any('m.v', '计划数|专业要求')}) THEN cells END
  FROM walk w JOIN (SELECT *, {_cells('v')} AS cells FROM marked) m ON m.id = w.id AND m.k = w.k + 1,
       LATERAL (SELECT m.fresh OR (m.alone AND w.pending IS NOT NULL) AS starts)),
lasts AS (SELECT id, max(k) AS k FROM walk GROUP BY id),
sheet_rows AS MATERIALIZED (
  SELECT id, flushed_at AS row_no, flushed AS cells FROM walk WHERE flushed IS NOT NULL
  UNION ALL SELECT w.id, m.line_no, w.pushed FROM walk w JOIN marked m USING (id, k) WHERE w.pushed IS NOT NULL
  UNION ALL SELECT id, began, pending FROM walk JOIN lasts USING (id, k) WHERE pending IS NOT NULL)"""


@query(f"WITH RECURSIVE {LINES} SELECT id, row_no::INT AS row_no, array_to_string(cells, '|') AS cells FROM sheet_rows")
def sheet_rows(spark, sf_dir):
    """Lines of sheets to rows, with cells that wrap over several lines."""
    sheets, lines = _sheets(spark, sf_dir)
    rows = T.collect_rows(lines, ["table"]).select("table", F.col("row_no").cast("int").alias("row_no"), F.array_join("cells", "|").alias("cells"))
    return _of_each(sheets, rows).drop("table")


def _place(flags: str) -> str:
    return f"coalesce(nullif(list_position({flags}, true), 0) - 1, -1)"


def _place_of(headers: str, patterns, but: str | None) -> str:
    found = [_place(f"list_transform({headers}, lambda h: {_any('h', p)}{f' AND NOT {_any("h", but)}' if but else ''})") for p in patterns]
    out = "-1"
    for f in reversed(found):
        out = f"CASE WHEN {f} >= 0 THEN {f} ELSE {out} END"
    return f"({out})"


def _sub(flag: str, fits: str) -> str:
    i = _place(f"list_transform(tail, lambda h: {flag})")
    return f"CASE WHEN {i} >= 0 THEN list_filter(list_transform(range(greatest(1, len(main)), greatest(len(sample), 1)), lambda i: CASE WHEN i - {i} >= 1 AND {fits} THEN i - {i} END), lambda p: p IS NOT NULL)[1] END"


DATA_START = f"(regexp_matches(coalesce(cells[1], ''), '^[0-9]{{1,3}}$|^[0-9]{{1,3}} {CJK}') OR (regexp_matches(coalesce(cells[1], ''), '^[0-9]+$') AND len(cells) > 1))"
RULE = " OR ".join(f"({_any('joined', a)} AND {_any('joined', b)})" for a, b in T.HEADER_RULES)
PLACES = ", ".join(f"'{n}': {_place_of('headers', *how) if n != 'major' else _place_of('headers', how[0], how[1])}" for n, how in T.COLUMNS.items())
MOST_MIDDLES = 7


def _over(k: int) -> str:
    """The k-th middle row of a header laid over what the earlier ones made."""
    label = "coalesce(CASE WHEN i >= o THEN middle[i - o + 1] END, '')"
    return f"""
over{k} AS (
  SELECT * EXCLUDE (middle, name, o, e), CASE WHEN middle IS NULL THEN e ELSE list_transform(range(greatest(len(e), o + coalesce(list_max(list_transform(range(len(middle)), lambda i: CASE WHEN middle[i + 1] <> '' THEN i + 1 ELSE -o END)), -o))),
      lambda i: coalesce(e[i + 1], '') || CASE WHEN contains(coalesce(e[i + 1], ''), {label}) THEN '' ELSE {label} END) END AS e
  FROM (SELECT *, greatest(CASE WHEN name >= 0 AND post >= 0 THEN post - name ELSE len(main) - 1 END, 0) AS o
  FROM (SELECT *, middles[{k}] AS middle, {_place(f"list_transform(middles[{k}], lambda h: {_any('h', '名称')} AND NOT {_any('h', '单位|岗位代码|部门')})")} AS name FROM over{k - 1}))),"""


OVERS = "".join(map(_over, range(1, MOST_MIDDLES + 1)))
LAYOUT = f"""flags AS MATERIALIZED (
  SELECT *, {RULE} AS rule, NOT {DATA_START} AND {_any('joined', T.HEADER_ROW)} AS head, {DATA_START} OR {_count('cells')} >= 4 AS opening
  FROM (SELECT *, array_to_string(cells, {TAB}) AS joined FROM sheet_rows)),
starts_at AS (SELECT id, min(row_no) AS a FROM flags WHERE rule GROUP BY id),
ends_at AS (SELECT id, a, min(row_no) FILTER (row_no > a AND NOT head) AS z FROM flags JOIN starts_at USING (id) GROUP BY ALL),
data_at AS (SELECT id, a, z, min(row_no) FILTER (row_no >= z AND opening) AS d FROM flags JOIN ends_at USING (id) GROUP BY ALL),
blocks AS MATERIALIZED (
  SELECT id, d, block, block[1] AS main, block[-1] AS tail, CASE WHEN len(block) = 2 THEN block[2:] ELSE block[2:-2] END AS middles, sample FROM (
    SELECT id, d, list(cells ORDER BY row_no) FILTER (z IS NULL OR row_no < z) AS block, any_value(cells) FILTER (row_no = d) AS sample
    FROM flags JOIN data_at USING (id) WHERE row_no >= a GROUP BY id, d)),
placed AS (
  SELECT *, CASE WHEN sample IS NULL THEN len(main) ELSE coalesce({_sub(_any('h', '学历|学位'), _level('sample[i + 1]') + " <> ''")}, {_sub(_any('h', T.SUB_SLOTS), _any('sample[i + 1]', T.SUB_SLOTS_CELL))},
         {_sub(_any('h', T.SUB_MAJOR) + ' AND NOT ' + _any('h', T.SUB_NO_MAJOR), _any('sample[i + 1]', T.SUB_MAJOR_CELL))}, greatest(len(main), len(sample) - len(tail))) END AS s,
         {_place(f"list_transform(main, lambda h: {_any('h', '岗位')} AND NOT {_any('h', '代码|类别|等级|计划')})")} AS post FROM blocks),
over0 AS (
  SELECT *, list_transform(range(greatest(len(main), s + len(tail))), lambda i: coalesce(nullif(CASE WHEN i >= s THEN tail[i - s + 1] END, ''), main[i + 1], '')) AS e FROM placed),{OVERS}
layouts AS MATERIALIZED (SELECT id, d, e AS headers FROM over{MOST_MIDDLES}),
mapped AS MATERIALIZED (
  SELECT id, d, headers, {{{PLACES}}} AS m, {_place_of('headers', [T.LOOSE_MAJOR], T.NO_LOOSE_MAJOR)} AS loose FROM layouts),
columns AS MATERIALIZED (
  SELECT id, d, headers, struct_update(m, major := CASE WHEN m.major >= 0 THEN m.major ELSE loose END) AS m FROM mapped)"""


@query(f"WITH RECURSIVE {LINES}, {LAYOUT} SELECT id, d::INT AS data_start, array_to_string(headers, '|') AS headers, {', '.join(f'm.{n}::INT AS {n}' for n in T.COLUMNS)} FROM columns")
def sheet_headers(spark, sf_dir):
    """Headers of one to three rows folded into one, and the columns that they name."""
    sheets, lines = _sheets(spark, sf_dir)
    layouts = T.header_layout(T.collect_rows(lines, ["table"]), ["table"])
    return _of_each(sheets, layouts).select("id", F.col("data_start").cast("int").alias("data_start"), F.array_join("headers", "|").alias("headers"), "columns.*")


CODE = f"""(CASE WHEN {_at('r', 'm.post_code')} <> '' THEN {_at('r', 'm.post_code')} WHEN m.post_name >= 0 AND regexp_matches(coalesce(r[m.post_name + 2], ''), '^[0-9]{{2,4}}$') THEN r[m.post_name + 2] ELSE '' END)"""
MEND = f"""data AS MATERIALIZED (
  SELECT id, row_no, {_lead('cells')} AS lead, headers, m, row_number() OVER (PARTITION BY id ORDER BY row_no) AS k FROM sheet_rows JOIN columns USING (id) WHERE row_no >= d),
mend(id, k, row_no, ref, seq, cells) AS (
  SELECT DISTINCT id, 0::BIGINT, 0::BIGINT, NULL::VARCHAR[], 0::BIGINT, NULL::VARCHAR[] FROM data
  UNION ALL
  SELECT id, k, row_no, CASE WHEN cells IS NOT NULL AND (ref IS NULL OR len(cells) > len(ref)) THEN cells ELSE ref END, CASE WHEN cells IS NOT NULL THEN n ELSE seq END, cells
  FROM (SELECT *, CASE WHEN job THEN CASE WHEN given THEN r WHEN r[1] <> '' AND m.seq = 0 AND {_any('r[1]', CJK + '{2,}')} THEN [n::VARCHAR] || r ELSE [n::VARCHAR] || r[2:] END END AS cells
  FROM (SELECT *, CASE WHEN given THEN r[1]::BIGINT ELSE seq + 1 END AS n,
      CASE WHEN len(r) = 0 OR {_any("array_to_string(r, ' ')", T.NO_ROW)} OR {_any("coalesce(nullif(r[1], ''), r[2], '')", T.NO_FIRST_CELL)} THEN false
           WHEN code <> '' AND ({_any('code', T.NO_POST_CODE)} OR NOT {_any('code', T.POST_CODE)}) THEN false
           WHEN length(post) >= 2 AND post <> '岗位' THEN NOT {_any('post', T.NO_POST_NAME)} AND NOT {_any('post', T.PROSE_POST_NAME)}
           WHEN {_is_major('major')} THEN true
           ELSE (length(unit) >= 3 AND (education <> '' OR major <> '' OR post <> '')) OR {_count('r')} >= 5 END AS job
  FROM (SELECT *, {CODE} AS code, {_at('r', 'm.post_name')} AS post, {_at('r', 'm.major')} AS major, {_at('r', 'm.education')} AS education,
      coalesce(nullif({_at('r', 'm.unit')}, ''), {_at('r', 'm.dept')}) AS unit, {_any("coalesce(r[1], '')", '^[0-9]+$')} AS given
  FROM (SELECT *, split[1 : coalesce(list_max(list_transform(range(len(split)), lambda i: CASE WHEN split[i + 1] <> '' THEN i + 1 ELSE 0 END)), 0)] AS r
  FROM (SELECT *, CASE WHEN ref IS NOT NULL AND m.age >= 0 AND m.age < len(padded) AND contains(age, '周岁') AND {_any('age', T.INTERVIEW)}
      THEN padded[1 : m.age] || [trim(regexp_extract(age, '{T.INTERVIEW}', 1))] || CASE WHEN regexp_matches(coalesce(padded[m.age + 2], ''), '^1:[0-9]+$') OR coalesce(padded[m.age + 2], '') = '' THEN [regexp_extract(age, '{T.INTERVIEW}', 2)] ELSE [] END || padded[m.age + 2 :]
      ELSE padded END AS split
  FROM (SELECT *, {_at('padded', 'm.age')} AS age
  FROM (SELECT d.id, d.k, d.row_no, d.m, w.ref, w.seq, CASE WHEN w.ref IS NOT NULL AND len(d.lead) < len(w.ref) AND coalesce(w.ref[2], '') <> '' AND w.ref[2] = w.ref[3] AND d.lead[2] = w.ref[2] AND coalesce(d.lead[3], '') <> w.ref[2]
      THEN d.lead[1:2] || [w.ref[2]] || d.lead[3:] ELSE d.lead END AS padded
  FROM mend w JOIN data d ON d.id = w.id AND d.k = w.k + 1)))))))),
mended AS MATERIALIZED (
  SELECT w.id, w.row_no, w.cells AS r, d.m, d.headers FROM mend w JOIN data d USING (id, k) WHERE w.cells IS NOT NULL)"""


@query(f"WITH RECURSIVE {LINES}, {LAYOUT}, {MEND} SELECT id, row_no::INT AS row_no, array_to_string(r, '|') AS cells FROM mended")
def sheet_rows_mended(spark, sf_dir):
    """Rows aligned by the longest one so far, with running numbers; what can't be a job is left out."""
    sheets, lines = _sheets(spark, sf_dir)
    rows = T.mended_rows(T.collect_rows(lines, ["table"]), ["table"]).select("table", F.col("row_no").cast("int").alias("row_no"), F.array_join("cells", "|").alias("cells"))
    return _of_each(sheets, rows).drop("table")


def _other_at(d: int) -> str:
    v = f"r[m.other + {d + 1}]"
    return f"CASE WHEN m.other + {d} >= 0 AND m.other + {d} < len(r) AND NOT {_any(v, '^1:[0-9]+$|^(?:实操|面试)$')} AND NOT ({_any(v, T.NO_OTHER)} AND NOT {_any(v, T.NO_OTHER_UNLESS)}) THEN {v} ELSE '' END"


LIKELY = f"{_any('x', T.OTHER_SIGNAL)} AND length(x) <= 120"
AGE_CASES = " ".join(f"WHEN {_any('a', p)} THEN regexp_extract(a, '{p}', 1) || '周岁以下'" for p in T.AGE_CELLS)
JOBS = f"""picked AS (
  SELECT id, row_no, r, m, headers, {CODE} AS code, coalesce(nullif({_at('r', 'm.unit')}, ''), {_at('r', 'm.supervisor')}) AS unit, {_at('r', 'm.dept')} AS dept,
         coalesce(nullif({_at('r', 'm.post_name')}, ''), '岗位') AS post, {_at('r', 'm.major')} AS direct, {_at('r', 'm.age')} AS age_cell, {_at('r', 'm.education')} AS edu, {_at('r', 'm.slots')} AS slots_cell,
         [{', '.join(_other_at(d) for d in range(-2, 3))}] AS near FROM mended),
found AS (
  SELECT *, CASE WHEN {_is_major('direct')} OR (m.major >= 0 AND ({_any('direct', M.LIST_MARK)} OR direct = '')) THEN direct ELSE
      coalesce(list_filter(list_transform(range(len(r)), lambda i: {{'points': CASE WHEN i <> m.post_code AND NOT ({_any('r[i + 1]', T.OWNER_CELL)} AND NOT {_any('r[i + 1]', M.LIST_MARK)}) AND {_is_major('r[i + 1]')}
        THEN 1 + 5 * {_any('r[i + 1]', '不限专业|专业不限')}::INT + 3 * {_any('r[i + 1]', M.LIST_MARK)}::INT + 2 * {_any('r[i + 1]', CJK + '{2,}')}::INT ELSE 0 END, 'minus': -i, 'v': r[i + 1]}}).list_sort('DESC'), lambda b: b.points > 0)[1].v, direct) END AS major_cell,
      trim(regexp_replace(age_cell, '\\s*(?:实操|面试|直接考核)\\s*$', '')) AS a FROM picked),
named AS (
  SELECT id, row_no, r, headers, CASE WHEN code <> '' THEN code ELSE 'job-' || r[1] END AS job_id, CASE WHEN code <> '' THEN post || ' · ' || code ELSE post END AS title,
         CASE WHEN unit <> '' AND dept <> '' THEN unit || ' · ' || dept ELSE unit || dept END AS owner,
         coalesce(try_cast(regexp_extract(slots_cell, '^[+]?(-?[0-9]+)', 1) AS INT), 0) AS slots,
         CASE WHEN {_level('edu')} <> '' AND length(edu) <= 16 THEN {_level('edu')} ELSE '' END AS education,
         CASE WHEN major_cell = '—' OR NOT ({_is_major('major_cell')}) THEN '无要求' WHEN {_any('major_cell', L.ANY_MAJOR)} THEN '不限专业' WHEN len({_names('major_cell')}) > 0
              THEN array_to_string(list_filter(list_transform(range(len({_names('major_cell')})), lambda i: CASE WHEN list_position({_names('major_cell')}, ({_names('major_cell')})[i + 1]) = i + 1 THEN ({_names('major_cell')})[i + 1] END), lambda n: n IS NOT NULL), '、')
              WHEN {_is_name(_strip('major_cell'))} THEN {_strip('major_cell')} ELSE '无要求' END AS major,
         CASE {AGE_CASES} WHEN {_any('a', '周岁|岁以下')} AND length(a) <= 40 THEN a ELSE age_cell END AS age,
         CASE WHEN near[3] <> '' AND {_any('near[3]', T.OTHER_SIGNAL)} AND length(near[3]) <= 120 THEN near[3] ELSE coalesce(list_filter(near, lambda x: {LIKELY})[1], near[3]) END AS other FROM found)"""


@query(f"""
WITH RECURSIVE {LINES}, {LAYOUT}, {MEND}, {JOBS}
SELECT id, row_no::INT AS row_no, job_id, title, CASE WHEN {S.garbled(S.cut('owner'))} THEN '' ELSE left({S.cut('owner')}, 60) END AS organization, slots, CASE WHEN slots > 0 THEN slots || ' 人' ELSE '详见附件' END AS slots_label,
  coalesce(nullif(education, ''), '—') AS education, major, coalesce(nullif(age, ''), '—') AS age, other, concat_ws(' ', nullif(title, ''), nullif(major, ''), nullif(age, ''), nullif(education, ''), nullif(other, '')) AS text FROM named""")
def sheet_jobs(spark, sf_dir):
    """Rows of sheets as jobs with their fields."""
    sheets, lines = _sheets(spark, sf_dir)
    jobs = T.jobs(T.mended_rows(T.collect_rows(lines, ["table"]), ["table"]))
    made = jobs.select("table", F.col("row_no").cast("int").alias("row_no"), F.col("id").alias("job_id"), "title", "organization", "slots", "slots_label", "education", "major", "age", "other", "text")
    return _of_each(sheets, made).drop("table")


SHEETS_EACH = 3
ONCE = f"""shown AS (
  SELECT id // {SHEETS_EACH} AS doc, id AS sheet, row_no, job_id, title, CASE WHEN {S.garbled(S.cut('owner'))} THEN '' ELSE left({S.cut('owner')}, 60) END AS organization, slots, nullif(education, '') AS education, major, nullif(age, '') AS age, other,
         len(list_distinct(list_filter(list_transform(range(len(headers)), lambda i: CASE WHEN headers[i + 1] <> '' AND coalesce(r[i + 1], '') <> '' THEN headers[i + 1] END), lambda h: h IS NOT NULL))) AS n_columns FROM named),
keyed AS (SELECT *, CASE WHEN job_id <> 'job-' || row_no AND NOT regexp_matches(job_id, '^[0-9]+$') THEN 'code:' || job_id ELSE sheet || '|' || title || '|' || organization || '|' || row_no END AS key FROM shown),
ranked AS (SELECT *, min((sheet, row_no)) OVER (PARTITION BY doc, key) AS place, row_number() OVER (PARTITION BY doc, key ORDER BY length(major) + n_columns DESC, sheet, row_no) AS k FROM keyed),
each_once AS MATERIALIZED (SELECT * FROM ranked WHERE k = 1)"""


def _jobs_once(spark, sf_dir):
    """doc and sheets, a digest, of each notice; and the jobs of each distinct list of sheets, once each.

    Of a sheet only its place among those of its notice counts here.
    """
    sheets, lines = _sheets(spark, sf_dir, f"o_orderkey div {SHEETS_EACH}")
    jobs = written(T.jobs(R.with_columns_count(T.mended_rows(T.collect_rows(lines, ["table"]), ["table"]))), "jobs")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("id", "table"))), lambda x: x["table"])
    docs, lists = alike(sheets.groupBy(F.col("group").alias("doc")).agg(in_order.alias("tables")), ["tables"], "sheets", hold=True)
    each = lists.select("sheets", F.posexplode("tables").alias("sheet", "table")).join(jobs, "table").drop("table")
    return docs, R.once_each(each, ["sheets"], "sheet", "row_no")


@query(f"""
WITH RECURSIVE {LINES}, {LAYOUT}, {MEND}, {JOBS}, {ONCE},
lists AS (SELECT doc, place, CASE WHEN {_is_major('major')} THEN CASE WHEN major = '不限专业' THEN [major] ELSE {_names('major')} END ELSE [] END AS names, title || chr(9) || organization || chr(9) || major || chr(9) || coalesce(education, '') || chr(9) || coalesce(age, '') || chr(9) || slots || chr(9) || other AS line, slots, age, education, nullif(other, '') AS other FROM each_once),
flat AS (SELECT doc, flatten(list(names ORDER BY place)) AS names, count(*) AS n_jobs, nullif(sum(slots), 0)::BIGINT AS positions, first(age ORDER BY place) FILTER (age IS NOT NULL) AS age, first(education ORDER BY place) FILTER (education IS NOT NULL) AS education, first(other ORDER BY place) FILTER (other IS NOT NULL) AS notes,
  string_agg(line, chr(10) ORDER BY place) AS lines FROM lists GROUP BY doc)
SELECT doc, n_jobs, array_to_string(list_filter(list_transform(range(len(names)), lambda i: CASE WHEN list_position(names, names[i + 1]) = i + 1 THEN names[i + 1] END), lambda n: n IS NOT NULL), '|') AS majors, positions, age, education, notes, '{chr(9).join(R.HEAD)}' || chr(10) || lines AS tab_text FROM flat""")
def sheet_requirements(spark, sf_dir):
    """The jobs of all sheets of a notice, once each, rolled up and as lines."""
    docs, once = _jobs_once(spark, sf_dir)
    jobs = written(once, "once")
    rolled = R.rolled_up(jobs, ["sheets"]).join(R.as_lines(jobs, ["sheets"]), "sheets")
    return docs.join(written(rolled, "rolled"), "sheets").select("doc", "n_jobs", F.array_join("majors", "|").alias("majors"), "positions", "age", "education", "notes", "tab_text")


@query(f"""
WITH RECURSIVE {LINES}, {LAYOUT}, {MEND}, {JOBS}, {ONCE}
SELECT doc, CASE WHEN NOT regexp_matches(job_id, '^[0-9]+$') THEN job_id END AS code, title, nullif(organization, '') AS organization, major, age, education, nullif(other, '') AS other, slots, concat_ws(' ', title, nullif(organization, ''), major, age, education, nullif(other, '')) AS text FROM each_once""")
def sheet_items(spark, sf_dir):
    """The jobs of notices as rows that are stored."""
    docs, jobs = _jobs_once(spark, sf_dir)
    return docs.join(written(R.crawler_items(jobs, ["sheets"]), "items"), "sheets").drop("sheets")
