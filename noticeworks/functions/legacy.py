"""Legacy jobs as home cards: what is inferred from their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, bind, collapse, preview, text, trim

# Words that decide, in their own order.
CITIES = ("长沙", "北京", "上海", "武汉")
CATEGORIES = (("公务员", ("公务员", "选调", "国考", "省考")), ("事业编", ("事业编", "事业单位")), ("高校教师", ("高校", "大学", "学院", "辅导员", "教师岗")), ("申博", ("申博", "博士", "读博", "博士研究生")))
OWNER = "^(.{2,24}?(?:大学|学院|研究院|研究所|教育厅|人社局))"
EDUCATION = (("博士", "博士|博士研究生|博后"), ("硕士及以上", "硕士|研究生"), ("本科及以上", "本科"), ("大专及以上", "大专|专科"))


def book_title(c: Column) -> Column:
    """In title marks, unless empty or in them already."""
    return bind(trim(c), lambda v: F.when((v == "") | (v.startswith("《") & v.endswith("》")), v).otherwise(F.concat(F.lit("《"), v, F.lit("》"))))


def bare_title(c: Column) -> Column:
    return bind(trim(c), lambda v: F.when(v.startswith("《") & v.endswith("》"), trim(F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(v))


def owner_and_title(c: Column) -> Column:
    """struct<owner, title>: from `[owner] title`, else an institution's name at the start, else no owner."""

    def split(v: Column) -> Column:
        inside, rest = F.regexp_extract(v, r"^\[([^\]]+)\]\s*(.*)$", 1), trim(F.regexp_extract(v, r"^\[([^\]]+)\]\s*(.*)$", 2))
        owner = F.when(inside != "", trim(inside)).otherwise(trim(F.regexp_extract(v, OWNER, 1)))
        return F.struct(owner.alias("owner"), F.when((inside != "") & (rest != ""), rest).otherwise(v).alias("title"))

    return bind(trim(c), split)


def city(c: Column, default: str = "长沙") -> Column:
    out = F.when(F.lit(False), "")
    for name in CITIES:
        out = out.when(F.contains(text(c), F.lit(name)), name)
    return out.otherwise(default)


def category(c: Column, default: str = "事业编") -> Column:
    out = F.when(F.lit(False), "")
    for name, words in CATEGORIES:
        out = out.when(any_of(text(c), words), name)
    return out.otherwise(default)


def category_label(c: Column) -> Column:
    return F.when(c == "高校教师", "高校编制").otherwise(c)


def education(c: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in EDUCATION:
        out = out.when(text(c).rlike(pattern), name)
    return out.otherwise("")


def summary(stored: Column, content: Column, most: int = 320) -> Column:
    return F.when(trim(stored) != "", trim(stored)).otherwise(bind(collapse(content), lambda v: preview(v, most)))


def slots(c: Column) -> Column:
    """All digits of a text as one number, so that 3-5 is 35; 0 without any."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(text(c), "[^0-9]", ""), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
