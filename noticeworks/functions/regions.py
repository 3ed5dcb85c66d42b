"""Provinces and cities of postings; the dictionary is a parameter, in the order that decides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, collapse, text, wide

# Fixed values.
MUNICIPALITIES = ("北京", "天津", "上海", "重庆")
PROVINCE_END = "(?:特别行政区|壮族自治区|回族自治区|维吾尔自治区|自治区|省|市)$"
CITY_END = "(?:市|区|县|州|盟|地区)$"
NO_CITY = "大学|学院|中学|小学|学校|医院|研究|公司|有限|集团|厅|局|部|委|中心|所|馆|队|站|办|处|科|室|湖南|湖北|广东|山东|江苏|浙江|四川|河南|河北|山西|陕西|甘肃|云南|贵州|福建|安徽|江西|辽宁|吉林|黑龙江|广西|内蒙古|宁夏|新疆|西藏|青海|海南"
ADMINISTRATIVE = wide(r"([一-龥]{2,10}(?:省|自治区|特别行政区))[\s，,]?([一-龥]{2,10}?)(?:市|地区|州|盟)")
WORKPLACE = wide(r"(?:工作地点|工作地|单位地址|地址|位于)[:：\s]*([一-龥]{2,12}?)(?:市|区|县)")

Regions = Mapping[str, Sequence[str]]


def _first(names: Column, fits) -> Column:
    return F.get(F.filter(names, fits), 0)


def _alike(raw: Column):
    return lambda name: raw.startswith(name) | name.startswith(raw)


def province(c: Column, regions: Regions) -> Column:
    """The first province of the dictionary that starts like the text, else the text without its ending."""
    names = F.array(*map(F.lit, regions))
    raw = F.regexp_replace(collapse(c), PROVINCE_END, "")
    return bind(raw, lambda v: F.when(v == "", "").otherwise(F.coalesce(_first(names, _alike(v)), v)))


def cities(name: Column, regions: Regions) -> Column:
    """array<string>: the cities of a province in their order, none for others."""
    table = F.create_map(*[x for p, own in regions.items() for x in (F.lit(p), F.array(*map(F.lit, own)))])
    return F.coalesce(F.try_element_at(table, name), F.array().cast("array<string>"))


def city(c: Column, of: Column, regions: Regions) -> Column:
    """A city of the province `of` that starts like the text, else a short text that is no institution, else empty."""

    def found(x: Column) -> Column:
        v, p = x["v"], x["p"]
        usual = _first(cities(p, regions), _alike(v))
        own = F.when(p.isin(*MUNICIPALITIES) & ((v == p) | p.startswith(v)), p)
        return F.when((v == "") | v.rlike(NO_CITY), "").otherwise(F.coalesce(usual, own, F.when(F.length(v).between(2, 8), v), F.lit("")))

    return bind(F.struct(F.regexp_replace(collapse(c), CITY_END, "").alias("v"), province(of, regions).alias("p")), found)


def inferred(c: Column, hint: Column, regions: Regions) -> Column:
    """struct<province, city> of a text: an administrative name, a place of work, any city of the province, any province."""
    t = text(c)

    def stated(h: Column) -> Column:
        named = F.regexp_extract(t, ADMINISTRATIVE, 1)
        p = bind(province(named, regions), lambda v: F.when(v != "", v).otherwise(h))
        return p

    def places(p: Column) -> Column:
        first = city(F.regexp_extract(t, ADMINISTRATIVE, 2), p, regions)
        work = city(F.regexp_extract(t, WORKPLACE, 1), p, regions)
        named = F.when(p != "", _first(cities(p, regions), lambda n: F.contains(t, n)))
        found = F.coalesce(F.nullif(first, F.lit("")), F.nullif(work, F.lit("")), named, F.lit(""))
        anywhere = _first(F.array(*map(F.lit, regions)), lambda n: F.contains(t, n))
        return F.struct(F.when(p != "", p).otherwise(F.coalesce(anywhere, F.lit(""))).alias("province"), found.alias("city"))

    return bind(bind(province(hint, regions), stated), places)


def shown(own_province: Column, own_city: Column, source_province: Column, source_city: Column, c: Column, regions: Regions) -> Column:
    """`province · city` of a posting, one of them alone, or empty; an institution's name is no place."""
    hint = province(F.coalesce(F.nullif(text(own_province), F.lit("")), source_province), regions)

    def of(x: Column) -> Column:
        p = F.when(x["hint"] != "", x["hint"]).otherwise(province(x["found"]["province"], regions))

        def joined(y: Column) -> Column:
            return F.when((y["p"] != "") & (y["c"] != "") & (y["p"] != y["c"]), F.concat_ws(" · ", y["p"], y["c"])).when(y["p"] != "", y["p"]).otherwise(y["c"])

        def nonempty(v: Column) -> Column:
            return bind(v, lambda z: F.when(z != "", z))

        def with_city(q: Column) -> Column:
            each = F.coalesce(nonempty(city(x["own"], q, regions)), nonempty(city(x["source"], q, regions)), nonempty(city(x["found"]["city"], q, regions)), F.lit(""))
            return bind(F.struct(q.alias("p"), each.alias("c")), joined)

        return bind(p, with_city)

    parts = bind(hint, lambda h: F.struct(h.alias("hint"), inferred(c, h, regions).alias("found"), own_city.alias("own"), source_city.alias("source")))
    return bind(parts, of)
