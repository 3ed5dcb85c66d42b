"""Search for subjects: a keyword with those of its family against texts, either of which may contain the other.

Containment is joined by equality alone. What may be part of a term is looked up among the term's own substrings, which are few;
what may contain a term is found by an inverted index of the texts' pairs of letters, under the term's rarest pair, and
checked. So no term is compared with a text that doesn't share that pair.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, text, trim

# Families of subjects, each with the words that stand for it.
FAMILIES = {
    "computer": "计算机 计算 软件 软件工程 网络工程 网络 大数据 数据科学 数据 信息安全 网络安全 物联网 人工智能 智能科学 信息 信息技术 信息管理 信息系统 电子商务 数字媒体 技术",
    "electronics": "电子 电子信息 通信 电子信息工程 电子工程 微电子 集成电路 光电 光电子 通信工程 电信 信号 自动化 测控 仪器",
    "electrical": "电气 电力 电气工程 电气自动化 电力系统 电网 能源 动力工程 机电",
    "mechanical": "机械 制造 机械工程 机械设计 车辆 汽车 材料成型 工业工程 智能制造 数控",
    "civil": "土木 建筑 城建 土木工程 建筑工程 结构 造价 工程管理 城市规划 交通 道路",
    "economics": "经管 经济 管理 工商 经济学 金融学 金融 会计 会计学 财务 财务管理 审计 市场营销 国际贸易 工商管理 公共管理 行政管理 人力资源",
    "law": "法学 法律 法学理论 民商法 刑法 诉讼法 司法",
    "education": "教育 师范 教育学 学前教育 小学教育 学科教学 心理健康 体育教育",
    "medicine": "医学 临床 护理 药学 临床医学 口腔 中医 公共卫生 预防医学 药学 中药 护理学 康复",
    "chinese": "中文 汉语 文学 汉语言 汉语言文学 中国语言文学 新闻 传播 广告",
    "marxism": "马克思 思政 政治 马克思主义 思想政治教育 政治学 党史 党建",
    "psychology": "心理 心理学 应用心理 心理健康",
}
SEPARATORS = f"(?:[、,，;；/|｜]|{WS})+"


def compact(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text(c), f"{WS}+", ""))


def substrings(c: Column) -> Column:
    """All distinct substrings of a short text, itself among them."""
    n = F.length(c)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), lambda j: F.substring(c, i, j)))))


def grams(c: Column, size: int = 2) -> Column:
    """The distinct pieces of `size` letters; a shorter text is its own."""
    places = F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(c, i, F.lit(size))))


def family_table(spark: SparkSession, families: Mapping[str, str] = FAMILIES) -> DataFrame:
    return spark.createDataFrame([(f, w) for f, words in families.items() for w in dict.fromkeys(words.split())], "family string, word string")


def expanded(keywords: DataFrame, families: DataFrame, keyword: str = "keyword") -> DataFrame:
    """keyword and term: each word of a keyword, with the words of every family that has one containing it or contained in it.

    families: family and word, a dictionary that is sent to every task. Blank and null keywords have no terms.
    """
    tokens = keywords.select(F.col(keyword).alias("keyword")).distinct().select("keyword", F.explode(F.split(trim(F.col("keyword")), f"{WS}+")).alias("t")).select("keyword", compact(F.col("t")).alias("t")).filter("t <> ''")
    words = families.select("family", compact(F.col("word")).alias("w")).filter("w <> ''")
    within = tokens.withColumn("w", F.explode(substrings(F.col("t")))).join(F.broadcast(words), "w").select("keyword", "family")
    around = tokens.join(F.broadcast(words.select("family", F.explode(substrings(F.col("w"))).alias("t"))), "t").select("keyword", "family")
    related = within.union(around).distinct().join(F.broadcast(words), "family").select("keyword", F.col("w").alias("term"))
    return tokens.select("keyword", F.col("t").alias("term")).union(related).distinct()


def search(texts: DataFrame, terms: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """keyword and id of the texts that a term of the keyword fits, once each.

    texts: the columns together are a row's text. A term fits if the whole text without white space contains it, or if it
    contains the whole text or a segment of it; segments stand between separators and white space. terms: see expanded.
    Rows without text fit nothing. Equal texts are searched once; rows whose id is repeated count once.
    """
    whole = F.concat_ws(" ", *[F.nullif(text(F.col(c)), F.lit("")) for c in columns])
    rows = texts.select(F.col(id_col).alias("id"), whole.alias("whole")).filter(F.col("whole") != "")
    distinct = rows.select("whole").distinct().select("whole", compact(F.col("whole")).alias("full")).filter("full <> ''")
    each = terms.select("term").distinct()
    parts = F.array_union(F.filter(F.transform(F.split("whole", SEPARATORS), compact), lambda s: s != ""), F.array("full"))
    contained = distinct.select("whole", F.explode(parts).alias("part")).join(each.select("term", F.explode(substrings(F.col("term"))).alias("part")), "part").select("whole", "term")

    pieces = each.select("term", F.when(F.length("term") > 1, 2).otherwise(1).alias("size"), F.explode(F.when(F.length("term") > 1, grams(F.col("term"))).otherwise(F.array("term"))).alias("gram"))
    keyed = distinct.select("whole", "full", F.explode(F.array_union(grams(F.col("full")), grams(F.col("full"), 1))).alias("gram")).join(pieces.select("gram").distinct(), "gram", "left_semi")
    counts = keyed.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = pieces.join(counts, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    containing = keyed.join(rarest, "gram").filter(F.contains("full", "term")).select("whole", "term")
    found = contained.union(containing).distinct()
    return found.join(terms, "term").select("keyword", "whole").distinct().join(rows, "whole").select("keyword", "id").distinct()
