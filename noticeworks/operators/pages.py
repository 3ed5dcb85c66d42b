"""Lists, main texts and recruitment tables of pages, by configured selectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, signals, urls
from ..functions.text import bind, collapse, text, with_once
from . import elements as E

# Selectors and patterns that decide results, in their own order.
CONTENT = ("#vsb_content", ".v_news_content", ".TRS_Editor", ".wp_articlecontent", ".view-content", "article", ".content")
COLUMNS = {
    "title": "^(?:岗位名称|职位名称|岗位|职位|招聘岗位|岗位类型|岗位类别)$",
    "slots": "^(?:招聘人数|计划数|名额|人数|招聘数量|拟招人数)$",
    "duty": "^(?:岗位职责|工作职责|主要职责|职责)$",
    "requirements": "^(?:任职条件|招聘条件|岗位要求|资格条件|基本要求|应聘条件)$",
    "major": "^(?:专业要求|专业|学科专业|需求专业)$",
    "age": "^(?:年龄要求|年龄|年龄条件)$",
    "education": "^(?:学历要求|学历|学历学位|学位要求)$",
}
NO_DATA_TITLE = "^(?:岗位名称|序号|合计|总计|小计|备注)$"
LABELS = {"age": ("年龄要求", "年龄"), "education": ("学历学位", "学历要求", "学历"), "major": ("专业要求", "专业"), "experience": ("工作经历要求", "工作经历"), "other": ("其它要求", "其他要求"), "party": ("政治面貌",)}
SCRIPTS = (r"(?i)\bfunction\s+\w+\s*\([^)]*\)\s*\{[\s\S]*?\}", r"(?i)\bvar\s+\w+\s*=\s*function\s*\([^)]*\)\s*\{[\s\S]*?\};?")


LEFTOVERS = (*signals.CODE, *SCRIPTS)
#: A text that is nothing but one call of a script.
BARE_CALL = r"^\s*[\w$]+(?:\.[\w$]+)+\([^()]*\)\s*;?\s*\z"


def without_scripts(c: Column, patterns: Sequence[str] = LEFTOVERS) -> Column:
    """A text without what is left of scripts, on one line."""
    v = text(c)
    for p in patterns:
        v = F.regexp_replace(v, p, " ")
    return collapse(v)


def list_items(pages: DataFrame, found: DataFrame, texts: DataFrame, key: str, url: str, items: str = "ul li", link: str = "a", date: str = "span", must_include: str = "", most: int = 45) -> DataFrame:
    """key, place, title, url and date (the label, null for none) of the announcements that pages list, at most `most` a page.

    The first link and the first date within each element that `items` selects; on pages where none of these is taken, every
    link with a title of six letters. Taken are titles of four letters whose address resolves to a new one on the page, is one of the
    web and holds must_include; kept are those of six letters that are no markup, menu, page itself or column page. found, texts: see
    elements.
    """
    chosen = E.select(found, items)
    first = lambda what: E.within(E.select(found, what), chosen, ["istart", "iend"]).groupBy("key", "istart").agg(F.min_by(F.struct("start", "end", "t0", "t1", "tag"), "start").alias("x")).select("key", "istart", "x.*")
    links = E.with_text(first(link), texts).select("key", "istart", collapse(F.col("text")).alias("title"), E.attribute(F.col("tag"), "href").alias("href"))
    dates = E.with_text(first(date), texts).select("key", "istart", collapse(F.col("text")).alias("date"))
    listed = links.join(dates, ["key", "istart"], "left").select("key", F.col("istart").alias("at"), "title", "href", F.nullif("date", F.lit("")).alias("date"), F.lit(4).alias("least"))
    anchors = E.with_text(E.select(found, "a[href]"), texts).select("key", F.col("start").alias("at"), collapse(F.col("text")).alias("title"), E.attribute(F.col("tag"), "href").alias("href"), F.lit(None).cast("string").alias("date"), F.lit(6).alias("least"))
    base = pages.select(F.col(key).alias("key"), F.col(url).alias("base"))

    def taken(rows: DataFrame) -> DataFrame:
        whole = with_once(rows.filter((F.length("title") >= F.col("least")) & (text(F.col("href")) != "")).join(base, "key"), url=urls.resolve(F.col("href"), F.col("base")))
        valid = whole.filter(F.col("url").rlike("(?i)^https?://") & F.contains("url", F.lit(must_include)))
        return valid.groupBy("key", "url").agg(F.min_by(F.struct("at", "title", "date", "base"), "at").alias("x")).select("key", "url", "x.*")

    own = taken(listed)
    both = own.union(taken(anchors.join(own.select("key").distinct(), "key", "left_anti")))
    junk = F.col("title").rlike("[{<>]") | rules.is_scrape_junk(F.col("title")) | rules.is_navigation(F.col("title"))
    index = F.col("url").rlike(r"(?i)/index\.html?(?:\?|#|$)") & (F.length("title") < 12)
    kept = both.filter((F.length("title") >= 6) & ~junk & (F.col("url") != F.col("base")) & ~urls.is_column_page(F.col("url")) & ~index)
    placed = kept.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("at")))
    return placed.filter(F.col("place") <= most).select(F.col("key").alias(key), "place", "title", "url", "date")


def main_text(pages: DataFrame, found: DataFrame, texts: DataFrame, key: str, selectors: Sequence[str] = CONTENT, least: int = 80, whole: str | None = "body", leftovers: Sequence[str] = LEFTOVERS) -> DataFrame:
    """key, selector and main_text of each page: the first selector whose first element has a readable text of `least` letters,
    else its longest text, else that of `whole`; selector is null for the latter. Pages without text have an empty one.

    whole: what stands in for pages whose selected texts are all short; None leaves it to the selectors alone.
    leftovers: patterns of what is left of scripts, which is no text."""
    each = [E.select(found, s).groupBy("key").agg(F.min_by(F.struct("t0", "t1"), "start").alias("x")).select("key", F.lit(i).alias("i"), F.lit(s).alias("selector"), "x.*") for i, s in enumerate(selectors)]
    if whole:
        each.append(E.select(found, whole).groupBy("key").agg(F.min_by(F.struct("t0", "t1"), "start").alias("x")).select("key", F.lit(len(selectors)).alias("i"), F.lit(None).cast("string").alias("selector"), "x.*"))
    rows = each[0]
    for e in each[1:]:
        rows = rows.union(e)
    read = with_once(E.with_text(rows, texts), v=without_scripts(F.col("text"), leftovers))
    read = with_once(read, heavy=signals.is_heavy_code(F.col("v")), garbled=rules.is_garbled(F.col("v")), n=F.length("v"))
    own, good = F.col("selector").isNotNull(), ~F.col("heavy") & ~F.col("garbled") & (F.col("n") >= least)
    best = read.groupBy("key").agg(
        F.min_by(F.struct("selector", "v", "n"), F.when(own & good, F.col("i"))).alias("sure"),
        F.max_by(F.struct("selector", "v", "n"), F.when(own & ~F.col("heavy") & (F.col("n") > 0), F.struct(F.col("n"), -F.col("i")))).alias("longest"),
        F.max(F.when(~own, F.struct("v", good.alias("good")))).alias("body"),
    )
    picked = F.coalesce("sure", "longest")
    body = F.struct(F.lit(None).cast("string").alias("selector"), F.col("body.v").alias("v"))
    own_text = F.struct(picked["selector"].alias("selector"), picked["v"].alias("v"))
    chosen = F.when(picked["n"] >= least, own_text).when(F.col("body.good"), body).when(picked["n"] >= 40, own_text).when(text(F.col("body.v")) != "", body).otherwise(own_text)
    return pages.select(F.col(key).alias("key")).join(best, "key", "left").select(F.col("key").alias(key), chosen["selector"].alias("selector"), F.coalesce(chosen["v"], F.lit("")).alias("main_text"))


def table_rows(found: DataFrame, texts: DataFrame, contents: Sequence[str] = CONTENT) -> DataFrame:
    """key, table, row and cells of the tables within a page's first content element, or anywhere in it if it has none.

    Rows without text are left out; rows and cells of tables in cells belong to both tables, as their texts do.
    """
    root = E.select(found, ", ".join(contents)).groupBy("key").agg(F.min_by(F.struct("start", "end"), "start").alias("x")).select("key", "x.*")
    whole = found.filter("name = 'table'").join(root.select("key", F.col("start").alias("rs"), F.col("end").alias("re")), "key", "left")
    tables = whole.filter("rs is null or (start > rs and start < re)")
    rows = E.within(found.filter("name = 'tr'"), tables, ["table", "tend"])
    cells = found.filter("name in ('td', 'th')").select("key", F.col("start").alias("cs"), "t0", "t1")
    held = rows.select("key", "table", F.col("start").alias("row"), F.col("end").alias("rend")).join(cells.withColumnRenamed("key", "ckey"), (F.col("key") == F.col("ckey")) & (F.col("cs") > F.col("row")) & (F.col("cs") < F.col("rend")))
    read = E.with_text(held.drop("ckey"), texts).withColumn("cell", collapse(F.col("text")))
    listed = read.groupBy("key", "table", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("cs", "cell"))), lambda x: x["cell"]).alias("cells"))
    return listed.filter(F.exists("cells", lambda c: c != ""))


def labelled_facts(c: Column) -> Column:
    """struct of age, education, major, other and party out of one run-on block of labels and values; empty for those it lacks.

    Of two labels of a field the later one decides. Experience goes before other demands.
    """

    def of(v: Column) -> Column:
        # A label counts once, with a wide colon before one with a narrow one.
        places = [F.coalesce(*[F.when(F.instr(v, label + colon) > 0, F.instr(v, label + colon)) for colon in "：:"]) for labels in LABELS.values() for label in labels]
        names = [(name, label) for name, labels in LABELS.items() for label in labels]
        found = F.array_sort(F.filter(F.array(*[F.struct(p.alias("at"), F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(len(label) + 1).alias("len")) for i, (p, (n, label)) in enumerate(zip(places, names, strict=True))]), lambda m: m["at"].isNotNull()))

        def value(m: Column, i: Column) -> Column:
            start = m["at"] + m["len"]
            end = F.coalesce(F.get(found, i + 1)["at"], F.length(v) + 1)
            cut = F.trim(F.substring(v, start, F.greatest(end - start, F.lit(0))))
            return F.struct(m["name"].alias("name"), F.regexp_replace(cut, r"[。；;]+\z", "").alias("value"))

        return F.filter(F.transform(found, value), lambda x: x["value"] != "")

    def named(values: Column) -> Column:
        last = lambda n: F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(values, lambda x: x["name"] == n), lambda x: x["value"])), -1), F.lit(""))
        level = bind(last("education"), lambda e: F.coalesce(F.nullif(rules.normal_education(e), F.lit("")), e))
        lived = bind(last("experience"), lambda e: F.when(e != "", F.concat(F.lit("工作经历："), e)))
        return F.struct(last("age").alias("age"), level.alias("education"), last("major").alias("major"), F.concat_ws("；", lived, F.nullif(last("other"), F.lit(""))).alias("other"), last("party").alias("party"))

    return bind(bind(collapse(c), of), named)


def recruitment_tables(rows: DataFrame, first_rows: int = 4) -> DataFrame:
    """key, table, row and the job of each data row of tables that have a recruitment header among their first rows.

    rows: see table_rows. A header names the posts' titles, or their requirements together with headcounts or duties; of two cells of one
    meaning the later one counts. Facts in a run-on cell of requirements are taken apart, and columns of their own go first, but for the age.
    """
    numbered = rows.withColumn("i", F.row_number().over(W.partitionBy("key", "table").orderBy("row")))

    def place(pattern: str) -> Column:
        return F.coalesce(F.array_max(F.transform("cells", lambda c, i: F.when(c.rlike(pattern), i))), F.lit(-1))

    columns = F.struct(*[place(p).alias(n) for n, p in COLUMNS.items()])
    candidates = with_once(numbered.filter(F.col("i") <= first_rows), columns=columns)
    header = (F.col("columns.title") >= 0) | ((F.col("columns.requirements") >= 0) & ((F.col("columns.slots") >= 0) | (F.col("columns.duty") >= 0)))
    heads = candidates.filter(header).groupBy("key", "table").agg(F.min_by("columns", "i").alias("columns"), F.min("i").alias("head"))
    sizes = numbered.groupBy("key", "table").agg(F.count("*").alias("size"))
    data = numbered.join(heads, ["key", "table"]).join(sizes.filter("size >= 2"), ["key", "table"]).filter("i > head")
    cell = lambda n: F.coalesce(F.when(F.col(f"columns.{n}") >= 0, F.get("cells", F.col(f"columns.{n}"))), F.lit(""))
    blank = F.forall("cells", lambda c: (c == "") | c.rlike(r"^[-—－]+\z"))
    read = with_once(data.filter(~blank), **{f"_{n}": cell(n) for n in COLUMNS}).filter((F.length("_title") >= 2) & ~F.col("_title").rlike(NO_DATA_TITLE))
    read = with_once(read, _p=labelled_facts(F.col("_requirements")), _level=rules.normal_education(F.col("_education")))
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    text_of = F.array_join(F.filter(F.array("_title", "_duty", "_requirements"), lambda x: x != ""), "\n")
    made = {"title": F.col("_title"), "slots": F.nullif(F.regexp_extract("_slots", "([0-9]+)", 1), F.lit("")).try_cast("int"), "duty": F.col("_duty"), "age": first("_p.age", "_age"), "education": first("_level", "_p.education"), "major": first("_major", "_p.major"), "other": F.col("_p.other"), "party": F.col("_p.party"), "text": text_of}
    return read.select("key", "table", "row", *[v.alias(n) for n, v in made.items()])


def table_summary(jobs: DataFrame) -> DataFrame:
    """key and summary: the jobs of recruitment_tables in words, a line each, in the page's order."""
    part = lambda label, c: F.when(text(F.col(c).cast("string")) != "", F.concat(F.lit(label), F.col(c).cast("string")))
    slots = F.when(F.col("slots") > 0, F.concat(F.lit("人数："), F.col("slots").cast("string")))
    line = F.concat_ws(" ", part("岗位：", "title"), slots, part("年龄：", "age"), part("学历：", "education"), part("专业：", "major"), part("其它：", "other"))
    lines = F.array_sort(F.collect_list(F.struct("table", "row", line.alias("line"))))
    return jobs.groupBy("key").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("summary"))
