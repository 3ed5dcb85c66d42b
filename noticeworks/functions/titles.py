"""Titles of notices and cards: what is none, what is taken instead, and how it is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from . import rules
from .text import WS, bind, collapse, extract, text, trim


def is_table_header(c: Column) -> Column:
    """A header line of a sheet."""
    return bind(collapse(c), lambda v: F.contains(v, F.lit("序号")) & v.rlike(L.HEADER_WORDS))


def bad_title_reason(c: Column) -> Column:
    """The first reason why a text is no card title, or null; null and empty texts are `empty`."""

    def reason(v: Column) -> Column:
        out = F.when(v == "", "empty").when(rules.is_garbled(v), "garbled").when(rules.is_navigation(v), "menu").when(rules.is_other_notice(v), "other_notice")
        out = out.when(v.rlike(L.FORM_TITLE), "form").when(v.rlike("一览表$") & ~F.contains(v, F.lit("公开招聘")), "list")
        for name, pattern in L.BAD_TITLES:
            out = out.when(v.rlike(pattern) if pattern else is_table_header(v), name)
        return out.when((F.length(v) > 36) & v.rlike("[，。；：]"), "prose")

    return bind(rules.cut_scrape_junk(c), reason)


def is_bad_title(c: Column) -> Column:
    return bad_title_reason(c).isNotNull()


def organization(name: Column, fallback: Column) -> Column:
    """The name without page junk, at most 60 characters; the fallback where nothing readable is left."""
    both = F.struct(rules.cut_scrape_junk(name).alias("v"), fallback.alias("otherwise"))
    return bind(both, lambda x: F.when(rules.is_garbled(x["v"]), x["otherwise"]).otherwise(F.left(x["v"], F.lit(60))))


def clean_title(c: Column, fallback: str = "未命名岗位") -> Column:
    return bind(rules.cut_scrape_junk(c), lambda v: F.when(is_bad_title(v), fallback).otherwise(F.left(v, F.lit(120))))


def list_title(c: Column) -> Column:
    """The notice's title in an attachment's name, or empty."""

    def cleaned(v: Column) -> Column:
        bare = trim(F.regexp_replace(F.regexp_replace(v, L.LIST_TAIL, ""), L.LIST_FILE, ""))
        return bind(bare, lambda b: F.when(v.rlike(L.LIST_TITLE) & (F.length(b) >= 8) & F.contains(b, F.lit("招聘")) & ~is_bad_title(b), F.left(b, F.lit(120))).otherwise(""))

    return bind(rules.cut_scrape_junk(c), cleaned)


def post_name(prose: Column) -> Column:
    """The first of three wordings that names a post, or empty."""

    def accepted(found: Column) -> Column:
        return bind(rules.cut_scrape_junk(found), lambda v: F.when(F.length(v).between(2, 40) & ~v.rlike(L.NO_POST_NAME) & ~is_bad_title(v), v))

    return bind(F.regexp_replace(text(prose), f"{WS}+", " "), lambda blob: F.coalesce(*[accepted(extract(blob, p)) for p in L.POST_NAMES], F.lit("")))


def title_line(prose: Column, lines: int = 40) -> Column:
    """The first of the lines that could be a title, or empty."""
    cleaned = F.filter(F.transform(F.split(text(prose), "\r?\n"), rules.cut_scrape_junk), lambda v: v != "")
    fits = F.filter(F.slice(cleaned, 1, lines), lambda v: v.rlike(L.TITLE_LINE) & F.length(v).between(6, 60) & ~is_table_header(v) & ~is_bad_title(v))
    return F.coalesce(F.get(fits, 0), F.lit(""))


def is_generic_title(c: Column) -> Column:
    return bind(rules.cut_scrape_junk(c), lambda v: (v == "") | v.rlike(L.GENERIC_TITLE))


def is_outside_staff(*sources: Column) -> Column:
    return F.concat_ws("\n", *map(trim, sources)).rlike(L.OUTSIDE_STAFF)


def picked_title(title: Column, announcement: Column, raw: Column, has_owner: Column) -> Column:
    """The card title: attachment name, own title, post named in the text, announcement unless generic, a line of the
    text, the announcement after all, else a general word."""

    def nonempty(c: Column) -> Column:
        return bind(c, lambda v: F.when(v != "", v))

    stated = clean_title(announcement, "")
    special = bind(stated, lambda v: F.when((v != "") & ~is_generic_title(v), v))
    own = [nonempty(list_title(title)), nonempty(clean_title(title, "")), nonempty(post_name(raw))]
    return F.coalesce(*own, special, nonempty(title_line(raw)), nonempty(stated), F.when(has_owner, "招聘岗位").otherwise("招聘公告"))


def card_title(title: Column, announcement: Column, raw: Column, has_owner: Column, mark: str = "非事业编制") -> Column:
    """The picked title, marked where the notice says that the staff is outside the establishment."""
    outside = is_outside_staff(announcement, title, F.left(text(raw), F.lit(2000)))
    both = F.struct(picked_title(title, announcement, raw, has_owner).alias("v"), outside.alias("outside"))
    return bind(both, lambda x: F.when(~x["v"].startswith(mark) & x["outside"], F.concat(F.lit(f"{mark} · "), x["v"])).otherwise(x["v"]))


def display_text(raw: Column, title: Column, owner: Column, age: Column, party: Column, majors: Column, education: Column, notes: Column) -> Column:
    """The raw text if it can be read, else one made of the posting's fields."""

    def part(c: Column, label: str = "") -> Column:
        return F.when(text(c) != "", F.concat(F.lit(label), c))

    major = F.array_join(F.coalesce(majors, F.array().cast("array<string>")), "、")
    rebuilt = F.concat_ws(" ", part(title), part(owner), part(age, "年龄要求："), part(party, "政治面貌："), part(major, "专业要求："), part(education, "学历："), part(notes))
    return F.when(~rules.is_garbled(raw), trim(raw)).otherwise(trim(rebuilt))
