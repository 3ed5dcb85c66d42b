"""Signs of code in a text, titles of table rows, dates of publication, urgency and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import titles
from .text import bind, collapse, text, trim

# Patterns that decide, in their own order.
CODE = (
    r"(?is)function\s+dosubao\s*\([^)]*\)\s*\{.*?\}",
    r"(?is)function\s+_nl_ys_check\s*\([^)]*\)\s*\{.*?\}",
    r"(?is)function\s+_nl_\w+\s*\([^)]*\)\s*\{.*?\}",
    r"(?is)var\s+_nl_\w+\s*=.*?;",
    r"(?i)document\.(?:write|cookie|getElementById|createElement)\([^)]*\)",
    r"(?i)window\.(?:location|open|onload)\b[^;]*",
    r"(?i)eval\s*\([^)]*\)",
    r"""(?i)\$\(\s*['"][^'"]+['"]\s*\)\.(?:html|text|click|ready)\([^)]*\)""",
)
FUNCTIONS, KEYWORDS = r"\bfunction\s+\w+\s*\(", r"\b(?:var|let|const|document|window|eval|jQuery|\$\()\b"
DATES = ("([0-9]{4})[-./]([0-9]{1,2})[-./]([0-9]{1,2})", "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日")


def is_heavy_code(c: Column, share: float = 0.08) -> Column:
    """A text that still holds scripts: one of the patterns, functions, or many keywords among few ideographs."""

    def heavy(v: Column) -> Column:
        counted = F.struct(v.alias("v"), F.regexp_count(v, F.lit(FUNCTIONS)).alias("f"), F.regexp_count(v, F.lit(KEYWORDS)).alias("k"), F.length(F.regexp_replace(v, "[^一-龥]", "")).alias("cjk"))

        def of(x: Column) -> Column:
            found = (x["f"] >= 2) | ((x["f"] >= 1) & (x["cjk"] < 20)) | ((x["k"] >= 4) & (x["cjk"] / F.greatest(F.length(x["v"]), F.lit(1)) < share))
            for p in CODE:
                found = found | x["v"].rlike(p)
            return found

        return bind(counted, of)

    return bind(text(c), heavy)


def is_row_title(c: Column) -> Column:
    """A short title as rows of tables have it."""

    def row(v: Column) -> Column:
        short = F.contains(v, F.lit(" · ")) | ((F.length(v) <= 32) & ~v.rlike("[，。；：]")) | (F.length(v) <= 24)
        return (v != "") & ~titles.is_bad_title(v) & ~v.isin("岗位", "未命名岗位") & short

    return bind(collapse(c), row)


def publish_time(c: Column) -> Column:
    """Noon at +08:00 of the first date that a label names; null for none and for days that don't exist."""

    def day(v: Column, p: str) -> Column:
        y, m, d = (F.regexp_extract(v, p, i) for i in (1, 2, 3))
        stamp = F.concat(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit(" 04:00:00"))
        return F.when(v.rlike(p), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")))

    return bind(trim(c), lambda v: F.when(v.rlike(DATES[0]), day(v, DATES[0])).otherwise(day(v, DATES[1])))


def is_urgent(days_left: Column, most: int = 5) -> Column:
    return F.coalesce(days_left <= most, F.lit(False))
