"""Subjects named in table cells: lists with marks and catalogue codes to names, and whether a cell holds any."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import WS, bind, text, trim, wide

# Patterns that decide results.
LIST_MARK = wide(r"[（(]\s*[0-9]{1,2}\s*[)）]")
CATALOG_NUMBER = wide(r"[（(【\[]\s*0?[0-9]{3,6}\s*[)）\]】]")
CODE = r"(?:0?[0-9]{3,4}|[A-Z][0-9]{1,3})"
LEADING_CODES = ("^[A-Z][0-9]{3,6}([一-龥])", "^[0-9]{4,6}([一-龥])")
SEPARATORS = "[、,，;；/|]+"
NAME = "[一-龥]{2,20}"
NO_NAME = "^(?:详见|附件|同上|无|不限)$"
NO_MAJOR_CELL = "试用期满|获得职称|专技岗位|年龄可放宽|周岁|职称者|资格证书|面试|实操|直接考核|咨询电话|举报电话|方案发布"
NUMBERED_PROSE = wide((r"^[0-9]+[、.．]\s*", r"；\s*[0-9]+[、.]"))
UNSTATED, UNLIMITED = "无要求", "不限专业"


def one_line(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return trim(F.regexp_replace(text(c), f"{WS}+", " "))


def without_codes(c: Column) -> Column:
    """The cell without list marks, catalogue numbers and codes that stand alone or before the first name."""

    def bare(v: Column) -> Column:
        v = F.regexp_replace(F.regexp_replace(v, LIST_MARK, " "), CATALOG_NUMBER, " ")
        v = F.regexp_replace(v, f"(?<![A-Za-z0-9_]){CODE}(?![A-Za-z0-9_])", " ")
        for pattern in LEADING_CODES:
            v = F.regexp_replace(v, pattern, "$1")
        return one_line(v)

    return bind(one_line(c), bare)


def is_name(v: Column) -> Column:
    return F.length(v).between(2, 24) & ~v.rlike(r"^[A-Z][0-9]{1,3}\z|^[0-9]+\z") & v.rlike("[一-龥]") & ~v.rlike(NO_NAME)


def names(c: Column) -> Column:
    """array<string>: the subjects of a cell, each once and in order; none for null, empty and unlimited ones.

    A cell with list marks is cut before each mark, any other at separators.
    """

    def of(v: Column) -> Column:
        marked = F.filter(F.split(v, f"(?={LIST_MARK})"), lambda s: s != "")
        chunks = F.when(F.size(marked) > 1, marked).otherwise(F.split(v, SEPARATORS))
        found = F.flatten(F.transform(chunks, lambda s: F.regexp_extract_all(without_codes(s), F.lit(f"({NAME})"), 1)))
        return F.when((v == "") | v.rlike(L.ANY_MAJOR), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(found, is_name)))

    return bind(trim(c), of)


def label(c: Column) -> Column:
    """What a card shows: the names, a word for any subject, or one for none stated."""

    def of(v: Column) -> Column:
        rest = bind(without_codes(v), lambda r: F.when(is_name(r), r).otherwise(UNSTATED))
        listed = bind(names(v), lambda n: F.when(F.size(n) > 0, F.array_join(n, "、")).otherwise(rest))
        return F.when(v.isin("", "—", "详见官网原文"), UNSTATED).when(v.rlike(L.ANY_MAJOR), UNLIMITED).otherwise(listed)

    return bind(trim(c), of)


def is_major_cell(c: Column) -> Column:
    """Whether a cell is one of a column of subjects."""

    def of(v: Column) -> Column:
        prose = v.rlike(NUMBERED_PROSE[0]) & v.rlike(NUMBERED_PROSE[1])
        named = (F.size(names(v)) > 0) | ((F.length(v) <= 24) & is_name(without_codes(v)))
        out = F.when(v == "", False).when(v.rlike(L.ANY_MAJOR), True).when(v.rlike(NO_MAJOR_CELL), False)
        return out.when(v.rlike(LIST_MARK), F.length(v) <= 4000).when((F.length(v) > 200) | prose, False).otherwise(named)

    return bind(trim(c), of)
