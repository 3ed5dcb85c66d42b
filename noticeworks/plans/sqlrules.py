"""The title rules as SQL text, stated apart from the Columns that they check."""

from __future__ import annotations

from ..functions import lexicon as L

BLANKS = r"[\s\x{00a0}\x{3000}]"


def trim(v: str) -> str:
    return f"regexp_replace(coalesce({v}, ''), '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def collapse(v: str) -> str:
    return trim(f"regexp_replace(coalesce({v}, ''), '{BLANKS}+', ' ', 'g')")


def menu(v: str) -> str:
    n = "(" + " + ".join(f"contains({v}, '{w}')::INT" for w in L.NAV_WORDS) + ")"
    return f"({v} <> '' AND (regexp_matches({v}, '^首页(?: |$)') OR {n} >= 3 OR ({n} >= 2 AND length({v}) > 36)))"


def other_notice(v: str) -> str:
    return f"({menu(v)} OR {' OR '.join(f'''regexp_matches({v}, '{p}')''' for p in L.OTHER_NOTICES)})"


def cut(v: str) -> str:
    """The first style rule's place is that of its text, as a rule needs nothing before it."""
    at = f"(CASE WHEN regexp_matches({v}, '{L.SCRAPE_CUT}') THEN strpos({v}, regexp_extract({v}, '{L.SCRAPE_CUT}')) ELSE 0 END)"
    head = f"CASE WHEN {at} > 1 THEN {trim(f'left({v}, {at} - 1)')} ELSE {v} END"
    return trim(f"regexp_replace(regexp_replace({head}, '{L.FOOTER_CUT}', ''), '[·•.]+$', '')")


def garbled(v: str) -> str:
    """Of a trimmed text."""
    found = [f"regexp_matches({v}, '{p}')" for p in (*L.SCRAPE_JUNK, *L.GARBLED)]
    return f"({v} = '' OR {menu(v)} OR {' OR '.join(found)} OR (length({v}) > 40 AND length(regexp_replace({v}, '[^一-龥]', '', 'g')) < 2))"


def header(v: str) -> str:
    return f"(contains({v}, '序号') AND regexp_matches({v}, '{L.HEADER_WORDS}'))"


def bad_reason(v: str) -> str:
    """Of a text that is cut already."""
    named = " ".join(f"WHEN {f'''regexp_matches({v}, '{p}')''' if p else header(v)} THEN '{name}'" for name, p in L.BAD_TITLES)
    return f"""CASE WHEN {v} = '' THEN 'empty' WHEN {garbled(v)} THEN 'garbled' WHEN {menu(v)} THEN 'menu' WHEN {other_notice(v)} THEN 'other_notice'
      WHEN regexp_matches({v}, '{L.FORM_TITLE}') THEN 'form' WHEN regexp_matches({v}, '一览表$') AND NOT contains({v}, '公开招聘') THEN 'list'
      {named} WHEN length({v}) > 36 AND regexp_matches({v}, '[，。；：]') THEN 'prose' END"""
