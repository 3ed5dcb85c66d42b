"""Admission, quality and classification rules of notices, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import WS, ZERO_WIDTH, all_of, any_of, bind, collapse, first_number, hits, text, trim


def either(patterns: Sequence[str]) -> str:
    """One pattern that fits where any of these does; their flags stay their own. A text is decoded once for all of them."""
    return "|".join(f"(?:{p})" for p in patterns)


def is_navigation(title: Column, words=L.NAV_WORDS, home: str = "首页") -> Column:
    """A menu: starts with the home word, or holds three words of the list, or two and is longer than 36.

    Words without blanks are the same in a text and in the collapsed one, so only texts with just two of them are collapsed.
    """
    if any(c.isspace() for w in (*words, home) for c in w):
        return bind(collapse(title), lambda v: (v != "") & (v.rlike(f"^{home}(?: |\\z)") | bind(hits(v, words), lambda n: (n >= 3) | ((n >= 2) & (F.length(v) > 36)))))

    def menu(v: Column) -> Column:
        return bind(hits(v, words), lambda n: (n >= 3) | v.rlike(f"^{WS}*{home}(?:{WS}|\\z)") | ((n == 2) & (F.length(collapse(v)) > 36)))

    return bind(F.replace(text(title), F.lit(ZERO_WIDTH), F.lit("")), menu)


def has_core_word(title: Column, words=L.CORE_WORDS) -> Column:
    return any_of(collapse(title), words)


def is_other_notice(title: Column) -> Column:
    """Results, exam arrangements, health checks and the like."""
    return bind(collapse(title), lambda v: is_navigation(v) | v.rlike("|".join(f"(?:{p})" for p in L.OTHER_NOTICES)))


def is_admitted(title: Column, need_core_word: bool = True) -> Column:
    def admitted(v: Column) -> Column:
        ok = (F.length(v) >= 6) & ~is_other_notice(v)
        return ok & has_core_word(v) if need_core_word else ok

    return bind(collapse(title), admitted)


def content_reason(content: Column, words=L.CONTENT_WORDS, spam=L.SPAM_WORDS, least: int = 150, most_spam: int = 3) -> Column:
    """Why a body is turned away: empty, short, spam or off_topic; null for a good one."""

    def reason(v: Column) -> Column:
        return F.when(v == "", "empty").when(F.length(v) < least, "short").when(hits(v, spam) > most_spam, "spam").when(~any_of(v, words), "off_topic")

    return bind(collapse(content), reason)


def is_result_notice(title: Column, content: Column, words=L.RESULT_WORDS, markers=L.RESULT_MARKERS) -> Column:
    return any_of(text(title), words) | all_of(text(content), markers)


def on_track(title: Column, content: Column, words=L.TRACK_WORDS) -> Column:
    return any_of(F.concat_ws("\n", text(title), text(content)), words)


def track(value: Column, tracks=L.TRACKS) -> Column:
    """The track's own name, else the first whose pattern fits, else empty."""

    def of(v: Column) -> Column:
        out = F.when(v.isin(*[n for n, _ in tracks]), v)
        for name, pattern in tracks:
            out = out.when(v.rlike(pattern), name)
        return out.otherwise("")

    return bind(trim(value), of)


def is_scrape_junk(c: Column) -> Column:
    """Style rules, menus and footers of pages."""

    def junk(v: Column) -> Column:
        return (trim(v) != "") & (is_navigation(v) | v.rlike(either(L.SCRAPE_JUNK)))

    return bind(text(c), junk)


def cut_scrape_junk(c: Column) -> Column:
    """What stands before the first style rule or footer, unless that is nothing, without closing dots."""

    def cut(v: Column) -> Column:
        at = F.regexp_instr(v, F.lit(L.SCRAPE_CUT))
        return F.when(at > 1, trim(F.left(v, at - 1))).otherwise(v)

    return trim(F.regexp_replace(F.regexp_replace(bind(trim(c), cut), L.FOOTER_CUT, ""), r"[·•.]+\z", ""))


def is_garbled(c: Column, least_cjk: int = 2, longer_than: int = 40) -> Column:
    def garbled(v: Column) -> Column:
        cjk = F.length(F.regexp_replace(v, "[^一-龥]", ""))
        odd = v.rlike(either([p.replace("(?i)", "(?iu)") for p in L.GARBLED]))  # the letters aren't all ASCII
        return (v == "") | is_scrape_junk(v) | ((F.length(v) > longer_than) & (cjk < least_cjk)) | odd

    return bind(trim(c), garbled)


def education(c: Column) -> Column:
    """One of five labels, or empty; the longest phrase of a level decides."""

    def labelled(phrase: Column) -> Column:
        out = F.when(F.lit(False), "")
        for label, pattern in L.EDUCATION:
            fits = phrase.rlike(pattern)
            out = out.when(fits & ~phrase.rlike("专科") if label.startswith("本科") else fits, label)
        return out.otherwise("")

    def of(v: Column) -> Column:
        phrases = F.regexp_extract_all(v, F.lit(f"({L.EDUCATION_PHRASE})"), 1)
        longest = F.aggregate(phrases, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
        phrase = bind(longest, lambda p: F.when(p == "", v).otherwise(p))
        return F.when((v == "") | v.rlike("(?i)" + L.NO_EDUCATION), "").when(v.rlike(L.ANY_EDUCATION), "无要求").otherwise(bind(phrase, labelled))

    return bind(collapse(c), of)


def any_major(c: Column) -> Column:
    return trim(c).rlike(L.ANY_MAJOR)


def major_names(c: Column) -> Column:
    """array<string>: names of 2 to 20 ideographs without list marks and codes, each once, in order."""
    v = collapse(c)
    bare = F.regexp_replace(F.regexp_replace(v, r"[（(【\[] *[0-9]{1,6} *[)）\]】]", " "), r"(?<![A-Za-z0-9_])(?:0?[0-9]{3,4}|[A-Z][0-9]{1,3})(?![A-Za-z0-9_])", " ")
    names = F.array_distinct(F.regexp_extract_all(bare, F.lit("([一-龥]{2,20})"), 1))
    return F.when(any_major(c), F.array().cast("array<string>")).otherwise(F.filter(names, lambda n: ~n.isin("详见", "附件", "同上", "无", "不限")))


def major_label(c: Column) -> Column:
    names = major_names(c)
    return F.when(any_major(c), "不限专业").when(F.size(names) > 0, F.array_join(names, "、")).otherwise("无要求")


def age_limit(c: Column, patterns=L.AGE_LIMITS) -> Column:
    return first_number(text(c), patterns, 1, 199)


def needs_party(c: Column, words=L.PARTY_WORDS) -> Column:
    return any_of(text(c), words)


def region_token(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim(c), L.REGION_ENDINGS, ""), f"{WS}+", "")


def region_matches(place: Column, province: Column, city: Column, everything: str = "全部") -> Column:
    """Equality, a common start or containment; an empty part of the place fits anything."""
    raw = trim(place)
    p, c = region_token(F.split_part(raw, F.lit("·"), F.lit(1))), region_token(F.when(F.contains(raw, F.lit("·")), F.split_part(raw, F.lit("·"), F.lit(2))).otherwise(""))

    def fits(own: Column, wanted: Column) -> Column:
        w = region_token(wanted)
        return (wanted == everything) | own.startswith(w) | w.startswith(own) | F.contains(region_token(raw), w)

    return fits(p, province) & fits(c, city)


def slots(*candidates: Column) -> Column:
    """The first positive number, else 0."""
    numbers = [c.cast("int") for c in candidates]
    return F.coalesce(*[F.when(n > 0, n) for n in numbers], F.lit(0))


def is_incomplete(deadline: Column, published: Column, n_slots: Column) -> Column:
    return deadline.isNull() & published.isNull() & (F.coalesce(n_slots, F.lit(0)) <= 0)


def cell(c: Column) -> Column:
    return trim(c)


def is_post_code(c: Column) -> Column:
    """A letter and up to three digits, or two to four digits."""
    return c.rlike(r"^[A-Z][0-9]{1,3}\z|^[0-9]{2,4}\z")


def fits_education(c: Column, level: str, everything: str = "全部") -> Column:
    return F.lit(True) if level == everything else F.contains(text(c), F.lit(level))


def shown_field(c: Column, none: str = "—") -> Column:
    """A field's text, or a dash for empty ones and words for no demand."""
    return bind(trim(c), lambda v: F.when(v.isin("", "—", "不限", "无"), none).otherwise(v))


def slots_label(slots: Column, positions: Column, none: str = "—") -> Column:
    """The row's number of people, else the notice's, else its words, else a dash."""
    words = shown_field(positions, none)
    return F.when(slots > 0, F.concat(slots.cast("string"), F.lit(" 人"))).when(text(positions).rlike(r"^[0-9]+\z"), F.concat(positions, F.lit(" 人"))).otherwise(words)


def normal_education(c: Column) -> Column:
    """The label of a labelled part of the text if it has one, else of the text; empty for placeholders."""

    def of(v: Column) -> Column:
        labelled = [bind(education(F.regexp_extract(v, p, 1)), lambda x: F.when(x != "", x)) for p in L.EDUCATION_LABELS]
        return F.when((v == "") | v.rlike("(?i)" + L.NO_EDUCATION), "").when(v.rlike(L.ANY_EDUCATION), "无要求").otherwise(F.coalesce(*labelled, education(v)))

    return bind(collapse(c), of)


def is_education_cell(c: Column) -> Column:
    """A short cell with a level, and no piece of prose about a school."""

    def of(v: Column) -> Column:
        return (v != "") & (F.length(v) <= 48) & ~v.rlike(L.SCHOOL_PROSE) & ~(v.rlike(L.NO_EDUCATION_CELL) & (F.length(v) > 16)) & (normal_education(v) != "")

    return bind(collapse(c), of)


def match_label(status: Column, reasons: Column) -> Column:
    """What a card says of a match; the first reason that isn't blank names a conflict."""
    first = F.coalesce(F.get(F.filter(F.transform(reasons, lambda r: trim(r)), lambda r: r != ""), 0), F.lit(""))
    conflict = bind(first, lambda r: F.when(r.rlike("年龄"), "[ ❌ 年龄超限 ]").when(r.rlike("政治|党员|面貌"), "[ ❌ 政治面貌不符 ]").when(r.rlike("专业"), "[ ❌ 专业不符 ]").otherwise("[ ❌ 条件冲突 ]"))
    return F.when(status == "PERFECT", "[ 🔥 完美匹配 ]").when(status == "CONFLICT", conflict).otherwise("[ · 无冲突 ]")


def source_label(status: Column) -> Column:
    return F.when(status == "active", "正常").when(status == "inactive", "停用").when(status == "error", "异常").when(text(status) != "", status).otherwise("—")
