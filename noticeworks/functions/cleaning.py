"""Extracted text made readable: control characters, sheet marks, style rules, tags and blank lines taken out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import bind, text, trim, wide

# What is taken out, in this order.
CONTROLS = r"[\x{FEFF}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}]"
SHEET_MARKS = wide((
    "(?i)---+\\s*发现附件透视文本:[^-]*---+",
    "(?i)---+\\s*工作表:\\s*[^\\n-]+---+",
    "(?im)^---+\\s*工作表:\\s*.+$",
    "(?i)工作表:\\s*Sheet[0-9]+",
    "(?im)^Sheet[0-9]+$",
    "(?m)^[-—–]{2,}\\s*$",
    "(?m)^---+\\s*",
    "(?m)\\s*---+\\s*$",
    "\\.[A-Za-z0-9_-]+\\s*\\{[^}]*\\}",
    "var\\s+[A-Za-z0-9_]+\\s*=\\s*document\\.[^;]+;",
))
#: What any of these marks needs.
MARKED = "(?i)[-—–]{2}|sheet|[{]|var"
TAGS = "<[^>]+>"
NO_TITLE = "(?i)^工作表:|^Sheet[0-9]+$|^[-—–]{2,}$"
LEAST_RULE_TEXT, LEAST_RAW_TEXT = 80, 200


def without_controls(c: Column) -> Column:
    """The text without byte-order marks and control characters but tabs and line ends."""
    return F.regexp_replace(text(c), CONTROLS, "")


def clean_text(c: Column) -> Column:
    """Lines that aren't blank, each trimmed, of a text without marks of sheets, style rules and tags; null is empty."""

    def unmarked(v: Column) -> Column:
        for pattern in SHEET_MARKS:
            v = F.regexp_replace(v, pattern, "")
        return v

    def of(v: Column) -> Column:
        v = F.when(v.rlike(MARKED), unmarked(v)).otherwise(v)
        v = F.regexp_replace(F.translate(F.regexp_replace(v, TAGS, " "), "　", " "), "[ \\t]{2,}", " ")
        lines = F.filter(F.transform(F.split(v, "\n"), trim), lambda x: (x != "") & ~x.rlike(r"^[-—–]{2,}\z"))
        return trim(F.array_join(lines, "\n"))

    return bind(without_controls(c), of)


def clean_title(c: Column) -> Column:
    """A cleaned title of at most 120 characters, or empty for names of sheets, junk and single letters."""
    return bind(clean_text(rules.cut_scrape_junk(c)), lambda v: F.when((F.length(v) < 2) | rules.is_garbled(v) | v.rlike(NO_TITLE), "").otherwise(F.left(v, F.lit(120))))


def is_good_reading(c: Column, useful: Column) -> Column:
    """Whether a text was read well: long enough, and either useful facts or a still longer text."""
    return bind(F.length(clean_text(c)), lambda n: (n >= LEAST_RULE_TEXT) & (useful | (n >= LEAST_RAW_TEXT)))
