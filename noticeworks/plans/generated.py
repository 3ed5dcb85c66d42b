"""Postings, sources and legacy jobs made from the driver's tables by rule, alike for Spark and as SQL.

Each text is picked from a list by a mix of the row's key, so that thousands of combinations lie on both sides of each
rule's boundaries. The lists are test input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _literal(v) -> str:
    return "NULL" if v is None else "'" + v + "'" if isinstance(v, str) else str(v)


class Made:
    """A table of picked columns over one driver table; `sql` is the same relation for the other engine."""

    def __init__(self, table: str, key: str, **columns):
        self.table, self.key = table, key
        self.spark_columns, sql_columns = [f"{key} AS id"], [f"{key} AS id"]
        for i, (name, made) in enumerate(columns.items()):
            parts = made if isinstance(made, tuple) else (made,)
            both = [self._pick(p, 10 * i + j) if isinstance(p, list) else p for j, p in enumerate(parts)]
            for k, out in enumerate((self.spark_columns, sql_columns)):
                cells = [p[k] if isinstance(p, tuple) else p for p in both]
                out.append(f"{' || '.join(cells)} AS {name}")
        self.sql = f"(SELECT {', '.join(sql_columns)} FROM {table})"

    def _pick(self, choices: Sequence, salt: int) -> tuple[str, str]:
        at = f"CAST((({self.key} * 2654435761 + {7_919 * salt}) % 1000003) % {len(choices)} AS INT)"
        listed = ", ".join(map(_literal, choices))
        return f"array({listed})[{at}]", f"([{listed}])[{at} + 1]"

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The rows, dealt by key before they are made: a small file is one task, and what is done by key later needs no shuffle."""
        dealt = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").repartition(4 * spark.sparkContext.defaultParallelism, F.expr(self.key))
        return dealt.selectExpr(*self.spark_columns)

    def once(self, spark: SparkSession, sf_dir: str, group: str) -> DataFrame:
        """The rows of each key once, with `copies`, how often the key comes, and `group`, an expression of the key by which they are dealt.

        For tables whose columns are made of the key alone; rows without a key are left out.
        """
        keys = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").filter(f"{self.key} is not null").selectExpr(self.key, f"{group} AS `group`")
        dealt = keys.repartition(4 * spark.sparkContext.defaultParallelism, "group").groupBy("group", self.key).agg(F.count("*").alias("copies"))
        return dealt.selectExpr("`group`", "copies", *self.spark_columns)


HEADS = ["", "", "某大学", "湖南某学院", "[南方大学] ", "长沙市人社局", "首页 ", "附件：", "某中心"]
BODIES = ["2026年公开招聘专任教师公告", "公开招聘工作人员一览表", "公开招聘岗位、计划数及要求一览表", "岗位计划一览表", "报名表", "拟聘用人员公示", "关于公布公开招聘面试分数", "公开招聘资格复核通过人员", "公开招聘资格复核合格人员公告", "公开招聘公示笔试分数", "辅导员", "研究生秘书", "因工作需要，拟招聘若干名", "根据《条例》规定", "是经教育部批准的高校", "工作表:Sheet1", "Sheet2 岗位", "-- 1 of 3 --", "及名额 3", "序号 岗位名称 招聘单位", "序号 联系人", "·.tab{color:red}", "招聘公告 {color:red} 页面", "招聘公告 | 中国政府网", "招聘公告｜中国教育部 网站地图", "nánh tuổi", "Ã¤ 招聘", "---", "abcdefghijklmnopqrstuvwxyz abcdefghijklmnop 字", "abcdefghijklmnopqrstuvwxyz abcdefghijklmnop 字文", "机构设置 职能简介", "为做好招聘工作", "体检和政审安排", "校内招聘管理人员公告", "公开招聘管理人员公告", "非事业编制实验员招聘", "附件　1 招聘岗位", "某校　岗位表　下载", "NÁNH TUỔI", "首页　招聘", "学院位于岳麓山下，公开招聘岗位若干；请符合条件的人员及时报名，具体要求如下：见附件。", "学院位于岳麓山下公开招聘岗位若干请符合条件的人员及时报名具体要求见后文所列各项内容"]
TAILS = ["", "", "公告", "·", "（第二批）", ".pdf", "。"]
RAWS = ["招聘岗位及人数：实验室管理员2名。要求本科及以上", "一、招聘岗位 行政秘书 1 名", "岗位职责 教学秘书 3 名 年龄35周岁以下", "某学院面向全校公开招聘科研管理人员", "第一行\n某大学公开招聘辅导员岗位\n第三行", "", "---", "非事业编制人员招聘，专业不限，限党员，年龄不超过30周岁", "abcdefghijklmnopqrstuvwxyz abcdefghijklmnop 字", "湖南省长沙市某单位招聘岗位", "工作地点：株洲市 岗位名称见附件", "招聘 {color:red} 岗位", "序号 岗位名称\n公开招聘辅导员和教师的公告", "招聘岗位：　宿管员 2　名，年龄　35 周岁以下", "教师 1 名，年龄不超过　28 周岁", None]
PROVINCES = ["湖南", "湖南省", "广西壮族自治区", "北京市", "新疆", "", None, "火星"]
CITIES = ["长沙市", "长沙", "株", "某大学", "", None, "海淀区", "桂林市", "小城"]

#: Postings with their fields; a null date is absent.
POSTINGS = Made(
    "orders",
    "o_orderkey",
    title=(HEADS, BODIES, TAILS),
    announcement=(["", "", "某大学", "湖南大学"], ["公开招聘辅导员公告", "校内招聘公告", "报名表", "非事业编人员招聘公告", "", "2026年人才引进公告"]),
    raw_text=(RAWS,),
    organization=(["", "湖南大学", "某研究院", "·.tab{", None],),
    source=(["湖南人社", "某大学人事处", ""],),
    province=(PROVINCES,),
    city=(CITIES,),
    source_province=(["湖南", "北京", "", None],),
    age_limit=(["", "35周岁以下", "30周岁及以下", "—", "不限", None],),
    party=(["", "中共党员", "无", "不限", None],),
    major=(["", "不限专业", "（1）教育学 0402 （2）心理学", "法学、会计学", "A01", "详见附件", "专业：不限", "—", None],),
    education=(["", "本科及以上", "硕士研究生", "博士", "大专以上", "学历要求：本科", "无要求", "高中", "—", None],),
    notes=(["", "需夜班", "—", "取得教师资格证", None],),
    positions=(["", "3", "若干", "12", "—", None],),
    slots=([None, 0, 2, 5],),
    status=([None, "PERFECT", "NORMAL", "CONFLICT"],),
    published=[None, "2026-01-05", "2026-03-01", "2026-03-02"],
    deadline=[None, "2026-02-28", "2026-03-01", "2026-03-04", "2026-03-20", "2025-12-31"],
    deleted=([True, False, False, False],),
)
NOW = "2026-03-01 12:00:00"
