"""Pages as elements numbered by where they start and end, and selectors as containment of these intervals.

One scan cuts a page into tags and texts. Start and end tags of a name alternate on each level of nesting, so an element's end is
the next tag on its level, found by one running sum and one look ahead over the page's tags. List items, table rows and cells may lack
their end tags; they end where the next of their kind or their list's or table's end is. The page's text is kept once, and
an element's text is the stretch of it between the element's start and end.

Selectors are comma-separated lists of `tag`, `#id`, `.class`, `[attribute]`, `:first-child` and `:last-child`, put together
as in `ul.list li` for descendants. Comments, scripts, styles, noscript and frames are left out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import text, trim, with_once
from ..sources.shared import written

TOKEN = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style|noscript|iframe)\b[^>]*+>.*?(?:</(?:script|style|noscript|iframe)\s*>|\z)|<[/!]?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
LEFT_OUT = r"(?i)^<(?:!|(?:script|style|noscript|iframe)\b)"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Kinds of elements that may lack end tags: their names, what else ends them, and what holds them.
OPEN_KINDS = {"cell": (("td", "th"), ("tr", "thead", "tbody", "tfoot"), ("table",)), "row": (("tr",), ("thead", "tbody", "tfoot"), ("table",)), "item": (("li",), (), ("ul", "ol", "menu"))}


def decoded(c: Column) -> Column:
    for name, mark in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a start tag, decoded; null if the tag lacks it."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    bare = F.regexp_replace(found, r"^[\"']|[\"']\z", "")
    return F.when(found != "", decoded(bare)).when(tag.rlike(rf"(?is)\s{name}(?:\s|/?>)"), "")


def elements(pages: DataFrame, key: str, html: str) -> tuple[DataFrame, DataFrame]:
    """The elements of pages (key, name, tag, start, end, t0, t1, first_child, last_child) and their texts (key, page_text).

    start, end: numbers of the tag that opens an element and of what ends it; t0, t1: where its text starts and ends in page_text.
    A tag without an end lasts to the page's end. Null and empty pages have no elements. Keys must be distinct. Both are written
    once, since every selector reads them.
    """
    tokens = pages.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(text(F.col(html)), F.lit(f"({TOKEN})"), 1)).alias("at", "token"))
    tag = F.col("token").rlike("(?is)^<[/!]?[a-z].*>\\z|^<!")
    named = with_once(tokens.filter(~F.col("token").rlike(LEFT_OUT)), name=F.when(tag, F.lower(F.regexp_extract("token", "^</?([A-Za-z][A-Za-z0-9]*)", 1))), plain=F.when(~tag, decoded(F.col("token"))))
    closes, void = F.col("token").startswith("</"), F.col("name").isin(*VOID) | F.col("token").endswith("/>")
    page = W.partitionBy("key").orderBy("at")
    before = page.rowsBetween(W.unboundedPreceding, -1)
    depth = lambda names: F.coalesce(F.sum(F.when(F.col("name").isin(*names), F.when(closes, -1).otherwise(1))).over(page), F.lit(0))
    placed = named.withColumn("closes", closes).withColumn("void", void)
    placed = placed.withColumns({"t0": F.coalesce(F.sum(F.length("plain")).over(before), F.lit(0)), "lists": depth(OPEN_KINDS["item"][2]), "tables": depth(("table",))})
    placed = written(placed, "page-tokens")
    texts = written(placed.filter("plain is not null").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "plain"))), lambda x: x["plain"]), "").alias("page_text")), "page-texts")
    tags = placed.filter("name is not null")
    tags = tags.withColumns({"next_closes": F.coalesce(F.lead("closes").over(page), F.lit(True)), "after_open": F.coalesce(F.lag(~F.col("closes") & ~F.col("void")).over(page), F.lit(True))})

    def kind_event(kind: str) -> Column:
        own, enders, holders = OPEN_KINDS[kind]
        level = F.col("lists" if kind == "item" else "tables")
        held = F.col("name").isin(*holders) & closes
        return F.when(F.col("name").isin(*own, *enders) | held, F.struct(F.lit(kind).alias("kind"), (level + F.when(held, 1).otherwise(0)).cast("long").alias("level"), (F.col("name").isin(*own) & ~closes).alias("opens")))

    loose = [n for own, _, _ in OPEN_KINDS.values() for n in own]
    by_name = W.partitionBy("key", "name").orderBy("at")
    strict = F.when(~F.col("name").isin(*loose) & ~F.col("void"), F.struct(F.col("name").alias("kind"), (F.sum(F.when(closes, -1).otherwise(1)).over(by_name) + F.when(closes, 1).otherwise(0)).cast("long").alias("level"), (~closes).alias("opens")))
    events = tags.withColumn("e", strict).withColumn("e", F.explode(F.array_compact(F.array(F.col("e"), *[kind_event(k) for k in OPEN_KINDS])))).select("key", "name", "token", "at", "t0", "closes", "next_closes", "after_open", "e.*")
    following = F.lead(F.struct("at", "t0", "closes", "next_closes", "name")).over(W.partitionBy("key", "kind", "level").orderBy("at"))
    whole = F.max(F.struct("at", "t0")).over(W.partitionBy("key"))
    ended = events.withColumn("next", following).withColumn("all", whole).filter("opens")
    own_end = F.col("next.closes") & (F.col("next.name") == F.col("name"))
    end = F.coalesce("next.at", F.col("all.at") + 1)
    sibling = F.lit(False)
    for kind, (own, _, _) in OPEN_KINDS.items():
        sibling = sibling | ((F.col("kind") == kind) & F.col("next.name").isin(*own))
    last = F.when(F.col("next").isNull(), True).when(own_end, F.col("next.next_closes")).otherwise(F.col("next.closes") | ~sibling)
    found = ended.join(texts.select("key", F.length("page_text").alias("size")), "key", "left")
    listed = found.select("key", "name", F.col("token").alias("tag"), F.col("at").alias("start"), end.alias("end"), F.col("t0").cast("int").alias("t0"), F.coalesce(F.col("next.t0"), F.col("size"), F.lit(0)).cast("int").alias("t1"), F.col("after_open").alias("first_child"), last.alias("last_child"))
    return written(listed, "page-elements"), texts


def _compound(selector: str) -> Column:
    parts = re.findall(r"^[A-Za-z][\w-]*|\*|#[\w-]+|\.[\w-]+|\[[\w-]+\]|:(?:first|last)-child", selector)
    if "".join(parts) != selector:
        raise ValueError(f"selector {selector!r} isn't understood")
    out = F.lit(True)
    for p in parts:
        if p[0] == "#":
            out = out & F.coalesce(attribute(F.col("tag"), "id") == p[1:], F.lit(False))
        elif p[0] == ".":
            out = out & F.coalesce(F.array_contains(F.split(trim(attribute(F.col("tag"), "class")), r"\s+"), p[1:]), F.lit(False))
        elif p[0] == "[":
            out = out & attribute(F.col("tag"), p[1:-1]).isNotNull()
        elif p[0] == ":":
            out = out & F.col("first_child" if "first" in p else "last_child")
        elif p != "*":
            out = out & (F.col("name") == p.lower())
    return out


def select(found: DataFrame, selector: str) -> DataFrame:
    """The elements that a selector fits, each once. Containment joins on the page and compares starts and ends."""
    groups = []
    for group in selector.split(","):
        steps = group.split()
        if not steps:
            raise ValueError(f"selector {selector!r} has an empty part")
        inner = found.filter(_compound(steps[0]))
        for step in steps[1:]:
            outer = inner.select(F.col("key").alias("okey"), F.col("start").alias("ostart"), F.col("end").alias("oend"))
            inside = (F.col("key") == F.col("okey")) & (F.col("start") > F.col("ostart")) & (F.col("start") < F.col("oend"))
            inner = found.filter(_compound(step)).join(outer, inside, "left_semi")
        groups.append(inner)
    return reduce(lambda a, b: a.union(b), groups).dropDuplicates(["key", "start"]) if len(groups) > 1 else groups[0]


def within(found: DataFrame, outer: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairs of an outer element and one inside it: the outer one's columns as given names (start, end) with the inner element's."""
    o = outer.select(F.col("key").alias("okey"), F.col("start").alias(names[0]), F.col("end").alias(names[1]))
    return found.join(o, (F.col("key") == F.col("okey")) & (F.col("start") > F.col(names[0])) & (F.col("start") < F.col(names[1]))).drop("okey")


def with_text(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The elements with their text as it stands in the page."""
    return found.join(texts, "key", "left").withColumn("text", F.coalesce(F.substring("page_text", F.col("t0") + 1, F.col("t1") - F.col("t0")), F.lit(""))).drop("page_text")
