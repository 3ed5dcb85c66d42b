"""Recruitment tables: wrapped lines to rows, headers of several rows to columns, broken rows mended, rows to jobs.

A table's rows are rows of a DataFrame with the table's keys, a number and an array of cells. What depends on the rows
before is a window over the table: which row is open, the number last written, the longest row so far. The latter is
needed to mend a row, and is itself the longest of the mended ones; it is settled by repeating the pass over a table until
no reference in it changes. A row's reference only depends on rows above, so each pass settles at least one more row; two
passes do for nearly all tables. They are one job, and only what isn't settled by them goes into the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import majors, rules, titles
from ..functions.text import WS, bind, text, trim, wide, with_once
from ..sources.shared import written
from .dedupe import per_text
from .sequences import running_number

# Patterns that decide results.
HEADER_RULES = (("序号", "专业|岗位"), ("专业", "人数|岗位|学历|年龄"), ("招聘人数|计划数|名额|岗位名称", "学历"))
HEADER_ROW = "序号|计划数|学历|专业要求|年龄要求|其他要求|岗位代码|岗位名称|笔试|主管部门|招聘单位"
LEVEL_WORDS = "|".join([L.ANY_EDUCATION, *(p for _, p in L.EDUCATION)])
SUB_SLOTS, SUB_SLOTS_CELL = "计划数|人数|名额", "^[1-9][0-9]{0,2}$"
SUB_MAJOR, SUB_NO_MAJOR, SUB_MAJOR_CELL = "专业", "代码|类别", r"不限专业|\([0-9]{1,2}\)|[一-龥]{2,}(?:学|类|技术|医学|康复)"
#: Logical columns: patterns in order of precedence, and what a header of them must not hold.
COLUMNS = {
    "seq": (("^(?:序号|编号)$",), None),
    "unit": (("(?:招聘)?单位|用人单位|^学校$",), None),
    "supervisor": (("^主管部门$",), None),
    "dept": (("^部门$", "^所属部门$", "^院系$", "^所属科室$", "^科室$"), None),
    "post_name": (("(?:岗位|职位)(?:名称)?|招聘职位|^岗位$",), None),
    "post_code": (("(?:岗位|职位|报名)代码", "^代码$", "岗位编号"), None),
    "slots": (("(?:招聘)?(?:人数|计划数)|计划(?:招聘)?数|^计划数$|名额|岗位数",), None),
    "education": (("(?:学历|文化程度)(?:学位|要求)?|^学历$|^学位$|^学历学位$",), None),
    "major": (("^专业(?:要求|条件)$", "^所学专业$", "^专业$", "^专业名称$", "专业(?:要求|条件)", "所学专业"), "代码|目录|类别|编号|序号"),
    "age": (("年龄(?:要求|条件)?",), None),
    "other": (("(?:其他|备注|资格|条件)(?:要求|条件|说明)?|特殊要求|附加条件|岗位条件|^其他要求$",), None),
}
LOOSE_MAJOR, NO_LOOSE_MAJOR = "专业", "代码|目录|类别|编号|岗位"
CONTINUED_TAIL = r"周岁|限高校|实操|面试|1:[0-9]|咨询电话|举报电话"
INTERVIEW = wide(r"^(.+?)\s+(实操|面试|直接考核)\s*$")
NO_ROW = "^合计|总计|小计|备注[:：]|说明[:：]|注[:：]"
NO_FIRST_CELL = "^序号$|^计划数$|^专业要求$"
NO_POST_CODE, POST_CODE = "专技岗位|^(?:岗位|专技|教师|学位|无)$", "^(?i:[A-Z]{1,3})?[0-9]{1,4}$"
NO_POST_NAME, PROSE_POST_NAME = "^(?:学历|年龄|专业|学位|其他要求)$", "周岁|硕士|博士|研究生|本科"
OTHER_SIGNAL = "限高校|职称|放宽|应届|经验|优先|户籍|定向|留学|海归|资格"
NO_OTHER, NO_OTHER_UNLESS = "网站|咨询电话|举报电话", "限|职称|高校"
AGE_CELLS = wide((r"([0-9]{1,3})\s*周岁\s*及?\s*以[下内]", r"([0-9]{1,3})\s*周岁以下", r"不超过\s*([0-9]{1,3})\s*周岁", r"年龄\s*(?:在\s*)?([0-9]{1,3})\s*周岁"))
OWNER_CELL = "(?:学院|大学|学校|研究院|单位)$"


def clean_cell(c: Column) -> Column:
    """A cell without its outer quotes and with white space collapsed; null is empty. Most cells hold neither."""
    return F.when(text(c).rlike(f'["{WS[1:]}'), majors.one_line(F.regexp_replace(text(c), r'^"|"\z', ""))).otherwise(text(c))


def cells_of(line: Column) -> Column:
    return F.transform(F.split(text(line), "\t"), clean_cell)


def is_data_start(cells: Column) -> Column:
    c0 = F.coalesce(F.get(cells, 0), F.lit(""))
    return c0.rlike(r"^[0-9]{1,3}\z|^[0-9]{1,3}\s+[一-龥]") | (c0.rlike(r"^[0-9]+\z") & (F.size(cells) > 1))


def _filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c != ""))


def _spaced_number(line: Column) -> Column:
    """A number before a name is set off as a cell of its own."""
    return F.regexp_replace(line, rf"^([0-9]{{1,3}}){WS}+(?=[一-龥])", "$1\t")


def _leading_number(cells: Column) -> Column:
    """A first cell of a number and a name becomes two cells."""
    c0 = F.coalesce(F.get(cells, 0), F.lit(""))
    two = F.concat(F.array(F.regexp_extract(c0, r"^([0-9]{1,3})\s+(.+)$", 1), F.regexp_extract(c0, r"^([0-9]{1,3})\s+(.+)$", 2)), F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))))
    return F.when(c0.rlike(r"^[0-9]{1,3}\s+.+$"), two).otherwise(cells)


def _continued(base: Column, line: Column, pieces: Column) -> Column:
    """A row with what a wrapped line adds: text without tabs goes to the last cell, cells to empty places or the end.

    pieces: the cells of a line with tabs, null for one without.
    """

    def put(row: Column, piece: Column, least: int) -> Column:
        empty = F.filter(F.transform(row, lambda c, i: F.when((c == "") & (i >= least), i)), lambda i: i.isNotNull())
        filled = F.transform(row, lambda c, i: F.when(i == F.get(empty, 0), piece).otherwise(c))
        return F.when(F.size(empty) > 0, filled).otherwise(F.concat(row, F.array(piece)))

    def last(row: Column, piece: Column) -> Column:
        return F.transform(row, lambda c, i: F.when(i == F.size(row) - 1, trim(F.concat(c, F.lit(" "), piece))).otherwise(c))

    def add(state: Column, piece: Column) -> Column:
        tail = state["tail"] | piece.rlike(CONTINUED_TAIL)
        marked = piece.rlike(r"^[（(]\s*[0-9]{1,2}\s*[)）]")
        row = F.when(piece == "", state["row"]).when(tail, put(state["row"], piece, 5)).when(marked, last(state["row"], piece)).otherwise(put(state["row"], piece, 0))
        return F.struct(row.alias("row"), tail.alias("tail"))

    start = F.struct(F.transform(base, clean_cell).alias("row"), F.lit(False).alias("tail"))
    return F.when(pieces.isNotNull(), F.aggregate(pieces, start, add)["row"]).otherwise(last(base, line))


def _is_header_line(v: Column) -> Column:
    return F.contains(v, F.lit("\t")) & ((F.contains(v, F.lit("序号")) & F.contains(v, F.lit("岗位"))) | (F.contains(v, F.lit("计划数")) & F.contains(v, F.lit("专业要求"))) | v.rlike("岗位代码|笔试科目"))


def _tabs(v: Column) -> Column:
    return F.length(v) - F.length(F.replace(v, F.lit("\t"), F.lit("")))


def _line_facts(line: Column) -> Column:
    """struct of what a line is by itself: its text v, whether it is skipped or closes the table, its kind, whether it is a row where
    none is open, its cells as a row's head, and as pieces that go on a row (null without tabs)."""

    def of(v: Column) -> Column:
        skipped = (v == "") | v.startswith("---") | (F.contains(v, F.lit("附件")) & F.contains(v, F.lit("透视")))
        header, tabs = _is_header_line(v), _tabs(v)
        new = ~header & ((v.rlike("^[0-9]+\t") & (tabs >= 1)) | (v.rlike(rf"^[0-9]+{WS}+[^{WS[1:]}") & (tabs >= 2)) | (v.rlike("^\t[一-龥]") & (tabs >= 2)))
        continues = v.rlike(rf"^[（(]{WS}*[0-9]{{1,2}}{WS}*[)）]") | ((tabs == 0) & v.rlike("^[一-龥(0-9（]"))
        alone = ~continues & ~header & (tabs >= 2) & (v.rlike("^[0-9]+\t|^\t[一-龥]") | (_filled(cells_of(v)) >= 4))
        kind = F.when(header, "header").when(new, "new").when(alone, "alone").otherwise("rest")
        tabbed = F.contains(v, F.lit("\t"))
        facts = {"v": v, "skipped": skipped, "closes": v.rlike(r"^注[:：]?\z|^结构化岗位表"), "kind": kind, "lone": tabbed & v.rlike("计划数|专业要求"), "head": cells_of(v), "pieces": F.when(tabbed, cells_of(_spaced_number(v)))}
        return F.struct(*[c.alias(n) for n, c in facts.items()])

    return bind(_spaced_number(trim(line)), of)


def collect_rows(lines: DataFrame, keys: Sequence[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """keys, row_no (order of a row's first line) and cells: the rows of tables whose cells wrap over lines.

    A line that starts a row opens it, those that don't are added to the open row's cells, and a header line closes it.
    Before a row is open, only header lines and those with a header's words are rows. Lines after a closing note don't
    count. Null lines are empty, and empty ones are skipped. Repeated rows of one order are taken in any order.
    """
    at = W.partitionBy(*keys).orderBy(order)
    read = per_text(lines.select(*keys, order, F.col(line).alias("_line")), "_line", _f=_line_facts)
    kept = read.drop("_line").filter("not _f.skipped")
    kept = kept.withColumn("_end", F.max("_f.closes").over(at)).filter("not _end")
    kind = F.col("_f.kind")
    opened = F.last(F.when(kind.isin("header", "new"), kind), ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, -1)) == "new"
    marked = kept.withColumn("_open", F.coalesce(opened, F.lit(False)))
    starts = (kind == "new") | ((kind == "alone") & F.col("_open"))
    first = (kind == "header") | starts | (~F.col("_open") & F.col("_f.lone"))
    numbered = marked.filter(F.col("_open") | first).withColumn("_first", first).withColumn("_data", starts).withColumn("_n", F.count_if("_first").over(at))
    part = F.struct(F.col(order).alias("at"), (~F.col("_first")).alias("later"), F.col("_data").alias("data"), F.col("_f.v").alias("line"), F.col("_f.pieces").alias("pieces"), F.col("_f.head").alias("head"))
    rows = numbered.groupBy(*keys, "_n").agg(F.min(order).alias("row_no"), F.array_sort(F.collect_list(part)).alias("_parts"))
    begun = F.get("_parts", 0)
    base = F.when(begun["data"], _leading_number(begun["head"])).otherwise(begun["head"])
    return rows.select(*keys, "row_no", F.aggregate(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), base, lambda row, p: _continued(row, p["line"], p["pieces"])).alias("cells"))


def _first_index(flags: Column) -> Column:
    """Place of the first true flag from 0, or -1."""
    return (F.array_position(F.transform(flags, lambda f: F.coalesce(f, F.lit(False))), True) - 1).cast("int")


def _header_at(headers: Column, patterns: Sequence[str], but: str | None) -> Column:
    def place(pattern: str) -> Column:
        return _first_index(F.transform(headers, lambda h: h.rlike(pattern) & ~h.rlike(but) if but else h.rlike(pattern)))

    fits = [place(p) for p in patterns]
    return F.coalesce(*[F.when(i >= 0, i) for i in fits], F.lit(-1))


def column_map(headers: Column) -> Column:
    """struct of the place of each logical column from 0, -1 for those that the headers lack."""
    found = {name: _header_at(headers, *how) for name, how in COLUMNS.items()}
    loose = _header_at(headers, [LOOSE_MAJOR], NO_LOOSE_MAJOR)
    found["major"] = bind(found["major"], lambda i: F.when(i >= 0, i).otherwise(loose))
    return F.struct(*[i.alias(name) for name, i in found.items()])


def _sub_start(sample: Column, sub: Column, n_main: Column) -> Column:
    """The column that the last header row starts in, by what the first data row holds in the columns beyond the first one's."""

    def by(index: Column, fits) -> Column:
        def of(ix: Column) -> Column:
            places = F.transform(sample, lambda c, i: F.when((i >= F.greatest(n_main, F.lit(1))) & (i - ix >= 1) & fits(c), i - ix))
            return F.when(ix >= 0, F.get(F.filter(places, lambda p: p.isNotNull()), 0))

        return bind(index, of)

    education = _first_index(F.transform(sub, lambda h: h.rlike("学历|学位")))
    slots = _first_index(F.transform(sub, lambda h: h.rlike(SUB_SLOTS)))
    major = _first_index(F.transform(sub, lambda h: h.rlike(SUB_MAJOR) & ~h.rlike(SUB_NO_MAJOR)))
    # Any label needs one of these words; most cells have none.
    found = [by(education, lambda c: F.when(c.rlike(LEVEL_WORDS), rules.normal_education(c) != "").otherwise(False)), by(slots, lambda c: c.rlike(SUB_SLOTS_CELL)), by(major, lambda c: c.rlike(SUB_MAJOR_CELL))]
    return F.when(sample.isNull(), n_main).otherwise(F.coalesce(*found, F.greatest(n_main, F.size(sample) - F.size(sub))))


def _laid_over(headers: Column, labels: Column, start: Column) -> Column:
    """Labels written into the headers from a column on: after what stands there, unless that holds them already."""
    last = F.array_max(F.transform(labels, lambda v, i: F.when(v != "", i + start + 1).otherwise(0)))
    size = F.greatest(F.size(headers), F.coalesce(last, F.lit(0)))

    def merged(i: Column) -> Column:
        both = F.struct(F.coalesce(F.get(headers, i), F.lit("")).alias("own"), F.coalesce(F.when(i >= start, F.get(labels, i - start)), F.lit("")).alias("new"))
        return bind(both, lambda b: F.when(F.contains(b["own"], b["new"]), b["own"]).otherwise(F.concat(b["own"], b["new"])))

    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), 1, size), merged)


def _folded(block: Column, sample: Column) -> Column:
    """One header of the rows of a header block: the last row placed by the sample, those between laid over by their post name."""

    def measured(x: Column) -> Column:
        post = _first_index(F.transform(x["main"], lambda h: h.rlike("岗位") & ~h.rlike("代码|类别|等级|计划")))
        start = F.greatest(_sub_start(sample, x["tail"], F.size(x["main"])), F.lit(0))
        return F.struct(x["main"].alias("main"), x["tail"].alias("tail"), post.alias("post"), start.alias("start"))

    def whole(x: Column) -> Column:
        main, tail, start = x["main"], x["tail"], x["start"]

        def placed(i: Column) -> Column:
            sub = F.coalesce(F.when(i >= start, F.get(tail, i - start)), F.lit(""))
            return bind(sub, lambda s: F.when(s != "", s).otherwise(F.coalesce(F.get(main, i), F.lit(""))))

        def over(headers: Column, row: Column) -> Column:
            name = _first_index(F.transform(row, lambda h: h.rlike("名称") & ~h.rlike("单位|岗位代码|部门")))
            offset = bind(name, lambda n: F.when((n >= 0) & (x["post"] >= 0), x["post"] - n).otherwise(F.size(main) - 1))
            return bind(F.greatest(offset, F.lit(0)), lambda o: _laid_over(headers, row, o))

        extended = F.transform(F.sequence(F.lit(0), F.greatest(F.size(main), start + F.size(tail)) - 1), placed)
        middle = F.when(F.size(block) == 2, F.slice(block, 2, 1)).otherwise(F.slice(block, 2, F.greatest(F.size(block) - 2, F.lit(0))))
        return F.aggregate(middle, extended, over)

    return bind(bind(F.struct(F.get(block, 0).alias("main"), F.element_at(block, -1).alias("tail")), measured), whole)


def header_layout(rows: DataFrame, keys: Sequence[str], order: str = "row_no", cells: str = "cells") -> DataFrame:
    """keys, headers, columns (see column_map) and data_start of each table that has a header.

    The header is the first row that fits one of three rules with the header rows next to it, folded into one by position.
    data_start: the order of the first row after it that starts with a number or fills four cells; null if there is none.
    """
    joined, rule = F.array_join("_c", "\t"), F.lit(False)
    for a, b in HEADER_RULES:
        rule = rule | (joined.rlike(a) & joined.rlike(b))
    whole = W.partitionBy(*keys)
    flags = with_once(rows.select(*keys, F.col(order).alias("_o"), F.col(cells).alias("_c")), _rule=rule, _head=~is_data_start(F.col("_c")) & joined.rlike(HEADER_ROW), _first=is_data_start(F.col("_c")) | (_filled(F.col("_c")) >= 4))
    o = F.col("_o")
    placed = flags.withColumn("_at", F.min(F.when(F.col("_rule"), o)).over(whole)).filter("_at is not null and _o >= _at")
    placed = placed.withColumn("_after", F.min(F.when((o > F.col("_at")) & ~F.col("_head"), o)).over(whole))
    placed = placed.withColumn("_data", F.min(F.when((o >= F.col("_after")) & F.col("_first"), o)).over(whole))
    block = placed.filter("_after is null or _o < _after or _o = _data")
    in_head = F.col("_after").isNull() | (o < F.col("_after"))
    sorted_rows = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(o.alias("o"), F.col("_c").alias("c"))))), lambda x: x["c"])
    heads = block.groupBy(*keys).agg(sorted_rows(in_head).alias("_block"), F.get(sorted_rows(~in_head), 0).alias("_sample"), F.min("_data").alias("data_start"))

    def layout(x: Column) -> Column:
        return bind(_folded(x["block"], x["sample"]), lambda h: F.struct(h.alias("headers"), column_map(h).alias("columns")))

    shaped = heads.select(*keys, "data_start", F.struct(F.col("_block").alias("block"), F.col("_sample").alias("sample")).alias("_shape"))
    return per_text(shaped, "_shape", hold=True, _layout=layout).select(*keys, "_layout.headers", "_layout.columns", "data_start")


def _pick(row: Column, at: Column) -> Column:
    return F.coalesce(F.when(at >= 0, F.get(row, at)), F.lit(""))


def _post_code(row: Column, columns: Column) -> Column:
    beside = F.when(columns["post_name"] >= 0, _pick(row, columns["post_name"] + 1)).otherwise("")
    return bind(_pick(row, columns["post_code"]), lambda v: F.when(v != "", v).when(beside.rlike(r"^[0-9]{2,4}\z"), beside).otherwise(""))


def _is_job_row(row: Column, columns: Column) -> Column:
    cells = F.struct(_post_code(row, columns).alias("code"), _pick(row, columns["post_name"]).alias("post"), _pick(row, columns["major"]).alias("major"), _pick(row, columns["education"]).alias("education"), F.coalesce(F.nullif(_pick(row, columns["unit"]), F.lit("")), _pick(row, columns["dept"])).alias("unit"))

    def of(x: Column) -> Column:
        head = F.coalesce(F.nullif(F.get(row, 0), F.lit("")), F.get(row, 1), F.lit(""))
        code_fits = ~x["code"].rlike(NO_POST_CODE) & x["code"].rlike(POST_CODE)
        out = F.when(_filled(row) == 0, False).when(F.array_join(row, " ").rlike(NO_ROW), False).when(head.rlike(NO_FIRST_CELL), False)
        out = out.when((x["code"] != "") & ~code_fits, False)
        out = out.when((F.length(x["post"]) >= 2) & (x["post"] != "岗位"), ~x["post"].rlike(NO_POST_NAME) & ~x["post"].rlike(PROSE_POST_NAME))
        named = (F.length(x["unit"]) >= 3) & ((x["education"] != "") | (x["major"] != "") | (x["post"] != ""))
        return out.when(majors.is_major_cell(x["major"]), True).otherwise(named | (_filled(row) >= 5))

    return bind(cells, of)


def _insert(row: Column, at: Column, cell: Column) -> Column:
    return F.concat(F.slice(row, 1, at), F.array(cell), F.slice(row, at + 1, F.greatest(F.size(row) - at, F.lit(0))))


def _aligned(row: Column, ref: Column, columns: Column) -> Column:
    """A row by the longest one above: a merged organisation repeated, an interview word set off from the age."""
    missing = (F.size(row) < ref["size"]) & (ref["a"] != "") & (ref["a"] == ref["b"]) & (F.get(row, 1) == ref["a"]) & (F.coalesce(F.get(row, 2), F.lit("")) != ref["a"])
    padded = F.when(F.coalesce(missing, F.lit(False)), _insert(row, F.lit(2), ref["a"])).otherwise(row)

    def split(v: Column) -> Column:
        age = columns["age"]
        both = F.struct(_pick(v, age).alias("cell"), _pick(v, age + 1).alias("next"))

        def mended(x: Column) -> Column:
            named = F.transform(v, lambda c, i: F.when(i == age, trim(F.regexp_extract(x["cell"], INTERVIEW, 1))).otherwise(c))
            wider = F.when(x["next"].rlike(r"^1:[0-9]+\z") | (x["next"] == ""), _insert(named, age + 1, F.regexp_extract(x["cell"], INTERVIEW, 2))).otherwise(named)
            return F.when((age >= 0) & (age < F.size(v)) & x["cell"].rlike(INTERVIEW) & F.contains(x["cell"], F.lit("周岁")), wider).otherwise(v)

        return bind(both, mended)

    return F.when(ref.isNull(), row).otherwise(bind(padded, split))


def _prepared(row: Column, columns: Column) -> Column:
    """struct of cells and given, the number written: null if it is no job's row; a missing number leaves room for it."""
    used = F.coalesce(F.array_max(F.transform(row, lambda c, i: F.when(c != "", i + 1).otherwise(0))), F.lit(0))

    def of(v: Column) -> Column:
        c0 = F.coalesce(F.get(v, 0), F.lit(""))
        given = F.when(c0.rlike(r"^[0-9]+\z"), c0)
        wide = F.concat(F.array(F.lit("")), v)
        cells = F.when(given.isNotNull(), v).when((c0 != "") & (columns["seq"] == 0) & c0.rlike("[一-龥]{2,}"), wide).otherwise(F.transform(v, lambda c, i: F.when(i == 0, F.lit("")).otherwise(c)))
        return F.when(_is_job_row(v, columns), F.struct(cells.alias("cells"), given.alias("given")))

    return bind(F.slice(row, 1, used), of)


def mended_rows(rows: DataFrame, keys: Sequence[str], order: str = "row_no", cells: str = "cells", most_passes: int = 50) -> DataFrame:
    """keys, row_no, headers, columns and cells of the rows of jobs, each with a running number as its first cell.

    A first cell of a number and a name is split. By the longest mended row so far (of equally long ones the first), a row
    that lacks the second of two equal organisation cells gets it back, and an interview word is set off from the age.
    Rows that can't be a job's are left out; a number that is written restarts the count, and one that is missing is counted on.
    Tables without a header give no rows. Null cells are empty.
    """
    cleaned = rows.select(*keys, F.col(order).alias("row_no"), F.transform(F.coalesce(F.col(cells), F.array().cast("array<string>")), clean_cell).alias("_cells"))
    clean = written(cleaned, "cells")
    layout = header_layout(clean, keys, "row_no", "_cells")
    data = clean.join(layout, list(keys)).filter(F.col("row_no") >= F.col("data_start")).drop("data_start")
    none = F.lit(None).cast("struct<size:int,minus:bigint,a:string,b:string>")
    state = with_once(data, _row=_leading_number(F.col("_cells"))).drop("_cells").withColumns({"_ref": none, "_whole": F.col("_row")})
    state = with_once(state, _p=_prepared(F.col("_row"), F.col("columns")))
    whole = W.partitionBy(*keys)
    before = whole.orderBy("row_no").rowsBetween(W.unboundedPreceding, -1)
    found = F.col("_p.cells")
    longest = F.max(F.when(found.isNotNull(), F.struct(F.size(found).alias("size"), (-F.col("row_no").cast("long")).alias("minus"), F.coalesce(F.get(found, 1), F.lit("")).alias("a"), F.coalesce(F.get(found, 2), F.lit("")).alias("b")))).over(before)
    own = [*keys, "row_no", "headers", "columns"]
    settled = None
    for _ in range(most_passes):
        for _ in range(2):  # a row that its reference leaves as it was stays prepared
            aligned = with_once(state.withColumn("_ref", longest), _aligned=_aligned(F.col("_row"), F.col("_ref"), F.col("columns")))
            fresh = F.when(F.col("_aligned") == F.col("_whole"), F.col("_p")).otherwise(_prepared(F.col("_aligned"), F.col("columns")))
            state = with_once(aligned, _new=fresh).select(*own, "_row", "_ref", F.col("_aligned").alias("_whole"), F.col("_new").alias("_p"))
        moved = ~F.col("_next").eqNullSafe(F.col("_ref"))
        passed = written(state.withColumn("_next", longest).withColumn("_moved", F.max(moved).over(whole)).drop("_next"), "mended")
        done = passed.filter("not _moved and _p is not null").select(*own, F.col("_p.cells").alias("cells"), F.col("_p.given").alias("given"))
        settled = done if settled is None else settled.union(done)
        state = passed.filter("_moved").drop("_moved")
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"rows weren't settled in {2 * most_passes} passes")
    counted = running_number(settled, keys, [F.col("row_no")], F.col("given").cast("long"), "n")
    first = F.coalesce("given", F.col("n").cast("string"))
    return counted.select(*keys, "row_no", "headers", "columns", F.transform("cells", lambda c, i: F.when(i == 0, first).otherwise(c)).alias("cells"))


def age_text(c: Column) -> Column:
    """The age limit of a cell in one wording, the cell itself if it is short and about ages, else empty."""

    def of(v: Column) -> Column:
        found = [bind(F.regexp_extract(v, p, 1), lambda n: F.when(n != "", F.concat(n, F.lit("周岁以下")))) for p in AGE_CELLS]
        return F.coalesce(*found, F.when(v.rlike("周岁|岁以下") & (F.length(v) <= 40), v).otherwise(""))

    return bind(F.regexp_replace(clean_cell(c), r"\s*(?:实操|面试|直接考核)\s*$", ""), of)


def _other(row: Column, columns: Column) -> Column:
    """The cell of other demands, or the one of the two on either side that reads like one."""

    def cell(i: Column) -> Column:
        return bind(_pick(row, i), lambda v: F.when(v.rlike(r"^1:[0-9]+\z|^(?:实操|面试)\z") | (v.rlike(NO_OTHER) & ~v.rlike(NO_OTHER_UNLESS)), "").otherwise(v))

    near = F.transform(F.array(*[F.lit(d) for d in range(-2, 3)]), lambda d: F.when((columns["other"] + d >= 0) & (columns["other"] + d < F.size(row)), cell(columns["other"] + d)).otherwise(""))
    likely = lambda v: v.rlike(OTHER_SIGNAL) & (F.length(v) <= 120)
    direct = cell(columns["other"])
    return bind(direct, lambda v: F.when((v != "") & likely(v), v).otherwise(F.coalesce(F.get(F.filter(near, lambda x: (x != "") & likely(x)), 0), v)))


def _major_cell(row: Column, columns: Column) -> Column:
    """The cell of subjects, found by its content where the header's one isn't of that kind."""
    marked = lambda v: v.rlike(majors.LIST_MARK)

    def score(v: Column, i: Column) -> Column:
        points = F.lit(1) + F.when(v.rlike("不限专业|专业不限"), 5).otherwise(0) + F.when(marked(v), 3).otherwise(0) + F.when(v.rlike("[一-龥]{2,}"), 2).otherwise(0)
        fits = (i != columns["post_code"]) & ~(v.rlike(OWNER_CELL) & ~marked(v)) & majors.is_major_cell(v)
        return F.struct(F.when(fits, points).otherwise(0).alias("points"), (-i).alias("minus"), v.alias("v"))

    def of(v: Column) -> Column:
        best = F.array_max(F.transform(row, score))
        stays = majors.is_major_cell(v) | ((columns["major"] >= 0) & (marked(v) | (v == "")))
        return F.when(stays, v).otherwise(bind(best, lambda b: F.when(b["points"] > 0, b["v"]).otherwise(v)))

    return bind(_pick(row, columns["major"]), of)


def jobs(mended: DataFrame, default_unit: str = "") -> DataFrame:
    """The rows of mended_rows as jobs: id, title, organization, slots, slots_label, education, major, age, other and text replace cells, headers and columns."""
    row, columns = F.col("cells"), F.col("columns")
    unit = F.coalesce(F.nullif(_pick(row, columns["unit"]), F.lit("")), F.nullif(_pick(row, columns["supervisor"]), F.lit("")), F.lit(default_unit))
    picked = with_once(mended, _unit=unit, _dept=_pick(row, columns["dept"]), _post=F.coalesce(F.nullif(_pick(row, columns["post_name"]), F.lit("")), F.lit("岗位")), _code=_post_code(row, columns), _major=_major_cell(row, columns), _age=_pick(row, columns["age"]), _education=_pick(row, columns["education"]), _slots=F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(_pick(row, columns["slots"]), "^[+]?(-?[0-9]{1,9})", 1), F.lit("")), F.lit("S999999999")).cast("int"), F.lit(0)))
    both = F.when((F.col("_dept") != "") & (F.col("_unit") != ""), F.concat_ws(" · ", "_unit", "_dept")).otherwise(F.coalesce(F.nullif("_unit", F.lit("")), F.nullif("_dept", F.lit("")), F.lit(default_unit)))
    major = F.when((F.col("_major") != "—") & majors.is_major_cell(F.col("_major")), majors.label(F.col("_major"))).otherwise(majors.UNSTATED)
    age = F.coalesce(F.nullif(age_text(F.col("_age")), F.lit("")), F.col("_age"))
    education = F.when(rules.is_education_cell(F.col("_education")), rules.normal_education(F.col("_education"))).otherwise("")
    made = with_once(picked, _title=F.when(F.col("_code") != "", F.concat_ws(" · ", "_post", "_code")).otherwise(F.col("_post")), _owner=titles.organization(both, F.lit(default_unit)), _m=major, _a=age, _e=education, _o=_other(row, columns))
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    shown = {"id": F.when(F.col("_code") != "", F.col("_code")).otherwise(F.concat(F.lit("job-"), F.get("cells", 0))), "title": F.col("_title"), "organization": F.col("_owner"), "slots": F.col("_slots"), "slots_label": F.when(F.col("_slots") > 0, F.concat(F.col("_slots").cast("string"), F.lit(" 人"))).otherwise("详见附件"), "education": dash("_e"), "major": dash("_m"), "age": dash("_a"), "other": F.col("_o"), "text": F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("_title", "_m", "_a", "_e", "_o")])}
    keys = [c for c in mended.columns if c not in ("cells", "headers", "columns")]
    return made.select(*keys, *[v.alias(n) for n, v in shown.items()])
