"""Posts, headcounts and conditions in notices that institutions write as prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields, rules, titles
from .text import WS, bind, extract, text, trim, wide

# Patterns that decide. A section ends where the next one, the sign-up, a contact or an annex begins.
ENDS = "报名(?:方式|时间|截止|须知)|联系(?:方式|电话)|附件|附：|$"
POSTS = wide((r"(?:一、)?(?:招聘岗位及人数|招聘岗位及岗位职责|招聘岗位(?:及人数)?)\s*", "二、|三、|四、|五、|六、|" + ENDS))
CONDITIONS = ("(?:二、|三、)?(?:任职基本条件|应聘条件|任职资格|报名条件)(?:及?(?:任职资格|条件))?", "[三四五六七八九十]、|" + ENDS)
DUTIES = ("(?:三、)?岗位职责", "[四五]、|" + ENDS)
TABLE = wide(r"岗位名称\s+职数")
TABLE_HEAD = wide(r"^.*?岗位名称\s+职数\s*(?:岗位职责|岗位概述\s*)?")
TABLE_COUNT = wide(r"[一-龥（）()A-Za-z·、0-9]{2,28}(?:员|师|秘书|专员|管理|工程|科员|助理)\s+([0-9]+)")
TABLE_ROW = wide(r"([一-龥（）()A-Za-z·、]+(?:员|师|秘书|专员|管理|工程|科员|助理))\s+([0-9]+)\s*(?:名|\s+[0-9.]|$)")
PAIR = wide(r"([一-龥（）()·、A-Za-z0-9]{2,32}?)([0-9]+)\s*名")
LEADS = wide((r"(?:公开)?招聘(?:管理|专技|技术)?(?:人员|工作人员|(?:管理)?(?:人员|专员|教师|科员))?([0-9]+)\s*名", r"面向(?:全校|校内).*?招聘[一-龥]{0,12}(?:人员|专员|教师|科员|管理)?([0-9]+)\s*名"))
OPEN_POST = wide(r"(?:公开)?招聘([一-龥]{2,24}(?:人员|教师|专员|秘书|科员|工程师|管理))([0-9]+)\s*名")
NO_POST = "岗位名称|职数|岗位职责|序号|岗位概述"
SCOPES = (("学校编制内在岗教职工", "学校编制内(?:在)?(?:岗)?(?:职工|教职工)"), ("面向校内教职工", "面向(?:全校|校内)(?:教职工|职工)"), ("须符合学校跨部门流动条件", "符合学校跨部门流动条件"), ("本校编制内人员", "本校(?:在编|编制内)"))


def flat(c: Column) -> Column:
    return F.regexp_replace(text(c), f"{WS}+", " ")


def posts_section(blob: Column) -> Column:
    """Of a flat text: what follows the heading of its posts, at most 3,500 characters."""
    return trim(F.regexp_extract(blob, f"{POSTS[0]}([\\s\\S]{{0,3500}}?)(?={POSTS[1]})", 1))


def _with_heading(blob: Column, section: tuple[str, str]) -> Column:
    return trim(F.regexp_extract(blob, f"({section[0]}[\\s\\S]{{0,3500}}?)(?={section[1]})", 1))


def duties_section(blob: Column) -> Column:
    return _with_heading(blob, DUTIES)


def conditions_section(blob: Column) -> Column:
    return _with_heading(blob, CONDITIONS)


def _tables(c: Column, posts: Column | None = None, duties: Column | None = None) -> Column:
    """Where posts are listed: their section with the duties', else the whole text; sections that were cut before can be given."""
    posts, duties = (posts_section(flat(c)), duties_section(flat(c))) if posts is None else (posts, duties)
    parts = bind(F.array(posts, duties), lambda x: F.array_join(F.filter(x, lambda v: v != ""), " "))
    return bind(F.struct(parts.alias("p"), text(c).alias("t")), lambda x: F.when(x["p"] != "", x["p"]).otherwise(x["t"]))


def _numbers(found: Column) -> Column:
    return F.aggregate(F.filter(F.transform(found, lambda n: n.try_cast("int")), lambda n: n.between(1, 999)), F.lit(0), lambda s, n: s + n)


def _positive(n: Column) -> Column:
    return bind(n, lambda v: F.when(v > 0, v))


def headcount(c: Column, posts: Column | None = None, duties: Column | None = None) -> Column:
    """The sum of a list of posts, else of the posts' section, else what the lead sentence says; each from 1 to 999."""
    table = bind(_tables(c, posts, duties), lambda b: F.when(b.rlike(TABLE), _numbers(F.regexp_extract_all(F.regexp_replace(b, "(?s)" + TABLE_HEAD, ""), F.lit(TABLE_COUNT), 1))))
    section = _numbers(F.regexp_extract_all(posts_section(flat(c)) if posts is None else posts, F.lit(r"([0-9]+)\s*名"), 1))
    lead = F.coalesce(*[extract(text(c), p) for p in LEADS]).try_cast("int")
    return F.coalesce(_positive(table), _positive(section), bind(lead, lambda n: F.when(n.between(1, 999), n)))


def scopes(c: Column, conditions: Column | None = None) -> Column:
    """array<string>: whom the conditions admit."""
    blob = bind(F.struct((conditions_section(flat(c)) if conditions is None else conditions).alias("q"), text(c).alias("t")), lambda x: F.struct(F.when(x["q"] != "", x["q"]).otherwise(x["t"]).alias("q"), x["t"].alias("t")))
    return bind(blob, lambda x: F.array_compact(F.array(*[F.when(x["t" if name == "面向校内教职工" else "q"].rlike(p), name) for name, p in SCOPES])))


def jobs(c: Column) -> Column:
    """array<struct<title, slots>>: each post once, in order: rows of a list, else all `post n 名`, else the lead sentence's.

    Only internal notices are read; null and other texts give none.
    """

    def found(blob: Column, pattern: str) -> Column:
        names, counts = (F.regexp_extract_all(blob, F.lit(pattern), i) for i in (1, 2))
        pairs = F.filter(F.arrays_zip(names.alias("name"), counts.alias("n")), lambda p: ~p["name"].rlike(r"^[一二三四五六七八九十]+\z"))

        def job(p: Column) -> Column:
            n = p["n"].try_cast("int")
            return F.struct(rules.cut_scrape_junk(p["name"]).alias("title"), F.when(n.between(1, 999), n).otherwise(1).alias("slots"))

        return F.array_distinct(F.filter(F.transform(pairs, job), lambda j: ~titles.is_bad_title(j["title"]) & ~j["title"].rlike(NO_POST)))

    def listed(blob: Column) -> Column:
        rows = found(F.when(blob.rlike(TABLE), F.regexp_replace(blob, "(?s)" + TABLE_HEAD, "")).otherwise(""), TABLE_ROW)
        return bind(F.struct(rows.alias("rows"), blob.alias("blob")), lambda x: F.when(F.size(x["rows"]) > 0, x["rows"]).otherwise(found(x["blob"], PAIR)))

    opened = found(F.regexp_extract(text(c), f"({OPEN_POST})", 1), OPEN_POST)
    every = bind(F.struct(bind(_tables(c), listed).alias("own"), opened.alias("opened")), lambda x: F.when(F.size(x["own"]) > 0, x["own"]).otherwise(x["opened"]))
    return F.when(fields.is_internal(c), every).otherwise(F.array().cast("array<struct<title:string,slots:int>>"))
