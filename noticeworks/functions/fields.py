"""Fields out of a notice's text: dates, headcounts, demands on people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import any_of, bind, collapse, extract, text, wide

# Patterns that decide, in their own order.
PLACEHOLDER = "(?i)" + L.NO_EDUCATION
FORM_FILE = wide(r"(?:报名|申请|登记|推荐|应聘)(?:表|材料|表\s*[0-9]*)|(?:管理辅助)?岗位招聘报名表|zpbmb|glfzgw")
INTERNAL = "面向(?:全校|校内)|编制内|管理辅助岗位|任职基本(?:条件|资格)|应聘条件"
NO_PARTY = "不限.*党员|党员.*不限|不作党员要求"
GENDERS = (("限男性", "限男性|仅限男|男性"), ("限女性", "限女性|仅限女|女性"), ("不限", "性别不限|不限性别"))
GENDER_LABEL = wide(r"性别要求[:：]?\s*([^\n\r]{2,20})")
FRESH = "限(?:应届|当年)毕业生|仅限应届|应届(?:生|毕业生)(?:报考|优先)|须为应届"
NOT_FRESH = "不限应届|非应届|社会(?:人员|在职)"
NOTES = wide((r"其他要求[:：]?\s*([^\n\r]{4,500})", r"备注[:：]?\s*([^\n\r]{4,500})"))
COUNTS = wide((r"招聘计划\s*([0-9]+)\s*名", r"计划\s*([0-9]+)\s*名", r"(?:拟)?招聘\s*([0-9]+)\s*名", r"名额\s*([0-9]+)", r"岗位\s*([0-9]+)\s*个"))
LABELLED_COUNTS = wide((
    r"(?:招聘|计划(?:招录|招聘)|拟招|招录)(?:人数|计划数|名额|岗位数)?[:：]?\s*([0-9]+|若干)",
    r"(?:招聘人数|计划招录|招录人数|岗位数|名额|计划数)[:：]?\s*([0-9]+|若干)",
    r"(?:人数|名额|岗位数)[:：]?\s*([0-9]+|若干)",
    r"(?:共|合计|总计)\s*([0-9]+)\s*(?:名|人|个(?:岗位|名额)?)",
))
INLINE_COUNT = wide(r"(?:招聘|拟招|计划招聘|计划招录)\s*([0-9]+)\s*(?:名|人)")
SEVERAL = "(?:招聘|招录|名额|岗位).*若干|若干(?:名|人|个)"
HOUR = "(?:[0-9]{1,2}时)?"
DAY, ISO_DAY = "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日" + HOUR, "([0-9]{4})[-./]([0-9]{1,2})[-./]([0-9]{1,2})"
TO = wide(r"\s*[至到—\-~]\s*")
#: The end of a range: pattern and the groups of its year, month and day.
RANGES = wide((
    (DAY + TO + DAY, (4, 5, 6)),
    (DAY + TO + "([0-9]{1,2})月([0-9]{1,2})日" + HOUR, (1, 4, 5)),
    (ISO_DAY + TO + ISO_DAY, (4, 5, 6)),
    (r"[至到]\s*" + DAY, (1, 2, 3)),
    (r"[至到]\s*" + ISO_DAY, (1, 2, 3)),
))
SINGLE_DAYS = ((DAY, (1, 2, 3)), (ISO_DAY, (1, 2, 3)))
SIGN_UP = wide((r"(?s)(?:网上)?报名时间\s*[:：]?\s*.{0,800}?[至到]\s*" + DAY, r"(?s)(?:网上)?报名时间.{0,600}?[至到]\s*" + ISO_DAY, "(?s)报名截止.{0,200}?" + DAY))
DEADLINE_LABEL = wide(r"(?:报名(?:时间|期限)|报名截止|截止时间?)[:：]?\s*([^\n\r。；;]{4,200})")


def is_placeholder(c: Column) -> Column:
    return bind(collapse(c), lambda v: (v == "") | v.rlike(PLACEHOLDER))


def is_form_file(name: Column, title: Column) -> Column:
    return F.concat_ws(" ", text(name), text(title)).rlike(FORM_FILE)


def is_internal(c: Column) -> Column:
    return text(c).rlike(INTERNAL)


def party(c: Column) -> Column:
    """The membership that a text demands, or that it demands none; null where it's silent."""
    return F.when(any_of(text(c), L.PARTY_WORDS), "中共党员").when(text(c).rlike(NO_PARTY), "不限")


def gender(c: Column) -> Column:
    labelled = bind(collapse(F.regexp_extract(text(c), GENDER_LABEL, 1)), lambda v: F.when(v != "", v))
    out = F.when(F.lit(False), "")
    for name, pattern in GENDERS:
        out = out.when(text(c).rlike(pattern), name)
    return F.coalesce(labelled, out)


def fresh_graduates(c: Column) -> Column:
    """Whether only fresh graduates may apply; null where a text is silent."""
    return F.when(text(c).rlike(FRESH), True).when(text(c).rlike(NOT_FRESH), False)


def notes(c: Column) -> Column:
    return F.coalesce(*[bind(collapse(F.regexp_extract(text(c), p, 1)), lambda v: F.when(v != "", v)) for p in NOTES])


def headcount(c: Column) -> Column:
    """A cell's number from 1 to 999 as text, or 若干; null for placeholders, dates and the rest."""

    def of(v: Column) -> Column:
        n = F.coalesce(extract(v, "^([0-9]{1,3})$"), extract(v, r"([0-9]{1,3})(?:\s*(?:名|人|个))?$")).cast("int")
        return F.when((v == "") | v.rlike(PLACEHOLDER), None).when(F.contains(v, F.lit("若干")), "若干").when(~v.rlike("[年月日]") & n.between(1, 999), n.cast("string"))

    return bind(collapse(c), of)


def headcount_in(c: Column) -> Column:
    """The headcount that a text states: first wording in range, then labelled ones, then 若干."""
    v = text(c)
    counts = [bind(extract(v, p).try_cast("int"), lambda n: F.when(n.between(1, 999), n.cast("string"))) for p in COUNTS]
    return F.coalesce(*counts, *[headcount(extract(v, p)) for p in LABELLED_COUNTS], extract(v, INLINE_COUNT).try_cast("int").cast("string"), F.when(v.rlike(SEVERAL), "若干"))


def _days(v: Column, shapes: Sequence[tuple[str, tuple[int, int, int]]]) -> Column:
    def day(pattern: str, groups: tuple[int, int, int]) -> Column:
        y, m, d = (F.regexp_extract(v, pattern, g) for g in groups)
        return F.when(v.rlike(pattern), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))

    return F.coalesce(*[day(p, g) for p, g in shapes])


def range_end(c: Column) -> Column:
    """The last day of the first of five forms of range, as yyyy-mm-dd."""
    return bind(collapse(c), lambda v: _days(v, RANGES))


def deadline_text(c: Column) -> Column:
    """A cell's day, that of a range's end if it is one; null for placeholders."""
    return bind(collapse(c), lambda v: F.when(~((v == "") | v.rlike(PLACEHOLDER)), _days(v, (*RANGES, *SINGLE_DAYS))))


def deadline_in(c: Column) -> Column:
    """The closing day that a text states: end of the sign-up, cut-off, labelled line, then any range's end."""
    v = text(c)
    labelled = deadline_text(extract(v, DEADLINE_LABEL))
    return F.coalesce(_days(v, [(p, (1, 2, 3)) for p in SIGN_UP]), labelled, _days(v, [RANGES[3]]), range_end(c))
