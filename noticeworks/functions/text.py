"""Text primitives as Columns: white space, word hits and ordered extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space with the byte-order mark; Java's \s is ASCII alone.
WS = r"[\x09-\x0D\x20   -     　﻿]"


ZERO_WIDTH = "\u200b"
#: The same as single characters: ends are trimmed without a pattern.
BLANK_CHARACTERS = "".join(c for c in map(chr, range(0x10000)) if re.fullmatch(WS, c))
#: What white space is beyond ASCII, as both engines write it in patterns.
BLANKS = r"\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def wide(pattern):
    """A pattern, or each one of a tuple, with its \\s standing for Unicode white space; it's ASCII alone in both engines."""
    if isinstance(pattern, tuple):
        return tuple(map(wide, pattern))
    if not isinstance(pattern, str):
        return pattern
    out, inside, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair[0] == "\\":
            out.append((BLANKS if inside else f"[{BLANKS}]") if pair == r"\s" else pair)
            i += 2
            continue
        inside = pair[0] != "]" and (inside or pair[0] == "[")
        out.append(pair[0])
        i += 1
    return "".join(out)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: a rule may name it often, and as a lambda's element it's a variable."""
    return F.get(F.transform(F.array(value), use), 0)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    return F.btrim(text(c), F.lit(BLANK_CHARACTERS))


def collapse(c: Column) -> Column:
    """Zero-width spaces dropped, runs of white space to one blank, ends trimmed."""
    return trim(F.regexp_replace(F.replace(text(c), F.lit(ZERO_WIDTH), F.lit("")), f"{WS}+", " "))


def hits(c: Column, words: Sequence[str]) -> Column:
    """How many of the words occur."""
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words[1:]), F.contains(c, F.lit(words[0])).cast("int"))


def any_of(c: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def all_of(c: Column, words: Sequence[str]) -> Column:
    found = F.lit(True)
    for w in words:
        found = found & F.contains(c, F.lit(w))
    return found


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, or null without a match."""
    return bind(F.regexp_extract(c, pattern, group), lambda v: F.when(v != "", v))


def first_number(c: Column, patterns: Sequence[str], least: int, most: int) -> Column:
    """Of ordered patterns, the first number that is in range; a match out of range leaves it to the next."""
    numbers = [F.try_to_number(extract(c, p), F.lit("999")).cast("int") for p in patterns]
    return F.coalesce(*[F.when(n.between(least, most), n) for n in numbers])


def with_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns, computed once a row: filters and selections over them don't repeat what they're made of."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)
