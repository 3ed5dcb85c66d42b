"""Institutions behind addresses: names out of titles and hosts, kinds, and the list pages of known ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import WS, bind, text, trim

# Hosts and titles that name institutions, in their own order.
HOSTS = {"hnu.edu.cn": "湖南大学", "hunnu.edu.cn": "湖南师范大学", "csu.edu.cn": "中南大学", "hnucm.edu.cn": "湖南中医药大学", "xtu.edu.cn": "湘潭大学", "csust.edu.cn": "长沙理工大学", "csuft.edu.cn": "中南林业科技大学", "hunau.edu.cn": "湖南农业大学", "hnust.edu.cn": "湖南科技大学", "hnut.edu.cn": "湖南工业大学", "usc.edu.cn": "南华大学", "hnuc.edu.cn": "湖南城市学院"}
#: Name, address of the list page, and what must not follow the name in a title.
KNOWN = (
    ("湖南大学", "https://rsc.hnu.edu.cn/zpxx.htm", "科技"),
    ("湖南师范大学", "https://rsc.hunnu.edu.cn/", None),
    ("中南大学", "https://rsc.csu.edu.cn/", "林业"),
    ("湖南中医药大学", "https://www.hnucm.edu.cn/qtsw/tzgg.htm", None),
    ("湘潭大学", "https://rsc.xtu.edu.cn/", None),
    ("长沙理工大学", "https://www.csust.edu.cn/rsc/zpxx.htm", None),
    ("中南林业科技大学", "https://rscn.csuft.edu.cn/rczp/zpxx.htm", None),
    ("湖南农业大学", "https://rsc.hunau.edu.cn/", None),
    ("湖南科技大学", "https://rsc.hnust.edu.cn/", None),
    ("湖南工业大学", "https://rsc.hnut.edu.cn/", None),
    ("南华大学", "https://rsc.usc.edu.cn/", None),
    ("湖南工商大学", "https://rsc.hutb.edu.cn/", None),
    ("湖南理工学院", "https://rsc.hnist.cn/", None),
    ("吉首大学", "https://rsc.jsu.edu.cn/", None),
    ("衡阳师范学院", "https://rsc.hynu.edu.cn/", None),
    ("湖南文理学院", "https://rsc.huas.edu.cn/", None),
)
NAMES = ("([一-龥]{2,30}(?:大学|学院|学校|研究院|医院|中心))", "(湖南[一-龥]{2,20})")
KINDS = (("高校", "大学|学院|学校", r"(?i)\.edu\.cn"), ("事业单位", "医院|中心|研究所", None))


def flat(c: Column) -> Column:
    return trim(F.regexp_replace(text(c), f"{WS}+", " "))


def known(title: Column, listed=KNOWN) -> Column:
    """struct of name and url of the first known institution that a title names; null for none."""

    def of(v: Column) -> Column:
        places = [F.when(v.rlike(f"{name}(?!{but})" if but else name), i) for i, (name, _, but) in enumerate(listed)]
        return F.get(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(u).alias("url")) for n, u, _ in listed]), F.coalesce(*places))

    return bind(flat(title), of)


def name_of(title: Column, url: Column, hosts=HOSTS) -> Column:
    """An institution's name: out of the title, by the host, else the host's first part, the title or the host."""

    def of(x: Column) -> Column:
        first = F.coalesce(*[F.nullif(F.regexp_extract(x["v"], p, 1), F.lit("")) for p in NAMES])
        by_host = F.coalesce(*[F.when(F.contains(x["host"], F.lit(domain)), name) for domain, name in hosts.items()])
        edu = F.when(F.contains(x["host"], F.lit(".edu.cn")), F.concat(F.split_part(x["host"], F.lit("."), F.lit(1)), F.lit(".edu.cn")))
        rest = [F.nullif(F.left(x["v"], F.lit(40)), F.lit("")), F.nullif(x["host"], F.lit("")), F.lit("未命名来源")]
        return F.coalesce(bind(first, lambda n: F.when(F.length(n) >= 4, n)), by_host, edu, *rest)

    return bind(F.struct(flat(title).alias("v"), F.coalesce(urls.host(url), F.lit("")).alias("host")), of)


def kind_of(name: Column, url: Column) -> Column:
    both = F.concat_ws(" ", text(name), text(url))
    out = F.when(name.rlike(KINDS[0][1]) & url.rlike(KINDS[0][2]), KINDS[0][0]).when(name.rlike(KINDS[1][1]), KINDS[1][0])
    return out.when(both.rlike(r"rst\.hunan\.gov|人社|人事"), "事业单位").when(url.rlike(r"教育厅|jyt\."), "其他").otherwise("事业单位")


def is_local(title: Column, url: Column, hosts=HOSTS) -> Column:
    """Whether a link is one of the province: a school's host or name, or its government's notices; null hosts aren't."""

    def of(x: Column) -> Column:
        named = F.contains(x["v"], F.lit("湖南"))
        school = x["host"].endswith(".edu.cn") & (named | F.contains(x["host"], F.lit("hn")) | x["host"].rlike("|".join(d.replace(".", "[.]") for d in hosts)))
        office = F.contains(x["host"], F.lit("hunan.gov.cn")) & x["v"].rlike("招聘|招贤|人事")
        return (school | office | named) & ~x["host"].rlike(r"(?:^|\.)moe\.gov\.cn\z")

    return bind(F.struct(text(title).alias("v"), F.coalesce(urls.host(url), F.lit("")).alias("host")), of)
