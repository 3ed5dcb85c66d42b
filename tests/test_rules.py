"""Boundaries of the rules, both sides of each."""

import re

import pytest
from pyspark.sql import functions as F

from noticeworks.functions.text import WS, trim
from noticeworks.functions import cleaning, dates, prose, rules, text, titles, urls
from noticeworks.operators import dedupe, matching, merging, sequences, snapshots
from noticeworks.plans import catalog


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("value", "want"), [("　a　 b﻿ ", "a b"), (None, ""), ("​x", "x"), ("\t\n", "")])
def test_collapse(spark, value, want):
    assert one(spark, text.collapse(F.lit(value))) == want


@pytest.mark.parametrize(("length", "reason"), [(149, "short"), (150, None), (0, "empty")])
def test_content_length(spark, length, reason):
    assert one(spark, rules.content_reason(F.lit(("招聘" + "字" * length)[:length]))) == reason


def test_content_spam_and_topic(spark):
    spam = list(rules.L.SPAM_WORDS)
    assert one(spark, rules.content_reason(F.lit("招聘" + "字" * 150 + "".join(spam[:3])))) is None
    assert one(spark, rules.content_reason(F.lit("招聘" + "字" * 150 + "".join(spam[:4])))) == "spam"
    assert one(spark, rules.content_reason(F.lit("字" * 150))) == "off_topic"


@pytest.mark.parametrize(("value", "limit"), [("35周岁以下", 35), ("0周岁以下", None), ("199周岁以下", 199), ("200周岁以下", None), ("200周岁以下，不超过27周岁", 27), ("无", None), (None, None)])
def test_age_limit(spark, value, limit):
    assert one(spark, rules.age_limit(F.lit(value))) == limit


@pytest.mark.parametrize(("offset", "grace", "expired", "visible"), [(0, 0, False, True), (-1, 0, True, False), (1, 0, False, True), (-5 * 86400, 5, False, False), (-5 * 86400 - 1, 5, True, False)])
def test_expiry_to_the_second(spark, offset, grace, expired, visible):
    at = F.lit("2026-05-10 23:59:59").cast("timestamp")
    end = F.timestamp_add("SECOND", F.lit(offset), at)
    assert one(spark, dates.is_expired(end, at, grace)) == expired
    assert one(spark, dates.is_visible(end, at)) == visible
    assert one(spark, dates.is_expired(F.lit(None).cast("timestamp"), at, grace)) is False


def test_code_next_to_an_ideograph_goes(spark):
    assert one(spark, rules.major_label(F.lit("0402教育学A01"))) == "教育学"


@pytest.mark.parametrize(("url", "want"), [("HTTPS://A.cn/X/index.html?a#b", "https://a.cn/x"), ("https://a.cn/x/", "https://a.cn/x"), ("https://a.cn/", "https://a.cn/"), (None, "")])
def test_normal_url(spark, url, want):
    assert one(spark, urls.normal(F.lit(url))) == want


def test_unknown_age_and_membership_pass(spark):
    none = F.lit(None)
    got = one(spark, matching.status(none.cast("int"), none.cast("boolean"), F.lit("法学"), none.cast("string"), F.lit("不超过30周岁，中共党员，法学"), F.array().cast("array<string>")))
    assert got.status == "PERFECT" and got.reasons == []


def test_upsert_last_wins_and_keeps(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, v string, is_deleted boolean")
    new = spark.createDataFrame([(1, "x", False, 1), (1, "y", False, 2), (3, "z", False, 1)], "k int, v string, is_deleted boolean, n int")
    for order in (F.col("n"), F.struct("n", "v")):
        got = snapshots.upsert(old, new, ["k"], ["v"], [order])
        assert got.columns == old.columns
        assert sorted(map(tuple, got.collect())) == [(1, "y", True), (2, "b", False), (3, "z", False)]
    for nothing in (new.limit(0), new.filter("k > 5")):
        assert sorted(map(tuple, snapshots.upsert(old, nothing, ["k"], ["v"], [F.col("n")]).collect())) == sorted(map(tuple, old.collect()))
    assert sorted(map(tuple, snapshots.upsert(old.limit(0), new, ["k"], ["v"], [F.col("n")]).collect())) == [(1, "y", False), (3, "z", False)]


def test_pick_with_nulls_ties_and_clashing_names(spark):
    rows = [(None, 1, "a"), (None, 1, "a"), (None, 2, "b"), (1, None, "c"), (1, 5, None)]
    df = spark.createDataFrame(rows, "k int, n int, rank string")
    assert sorted(map(tuple, dedupe.pick(df, ["k"], [F.col("n")]).collect()), key=str) == [(1, None, "c"), (None, 1, "a")]
    assert sorted(map(tuple, dedupe.pick_last(df, ["k"], [F.col("n")]).collect()), key=str) == [(1, 5, None), (None, 2, "b")]
    assert sorted(map(tuple, dedupe.ranked(df, ["k"], [F.col("n")], 2).collect()), key=str) == [(1, 5, None), (1, None, "c"), (None, 1, "a"), (None, 1, "a")]
    assert dedupe.pick(df.limit(0), ["k"], [F.col("n")]).collect() == []
    assert sorted(r.n or 0 for r in dedupe.pick_text(df, "rank", [F.col("n")]).collect()) == [0, 1, 2, 5]


def test_title_rules_of_edge_texts(spark):
    texts = [None, "", " \u3000 ", "公开招聘公告", "报名表.doc", "x" * 60_000, "公开招聘 | 中国政府网", "·.tab{", "关于公布公开招聘面试分数"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, title string")
    got = {r.id: r.reason for r in df.select("id", titles.bad_title_reason(F.col("title")).alias("reason")).collect()}
    assert got == {0: "empty", 1: "empty", 2: "empty", 3: None, 4: "form", 5: "garbled", 6: None, 7: "garbled", 8: "other_notice"}


@pytest.mark.parametrize("partitions", [1, 8])
def test_order_does_not_hang_on_partitions(spark, partitions):
    rows = [(1, i, str(i) if i % 3 == 0 else None, f"m{i % 2}") for i in range(20)]
    df = spark.createDataFrame(rows, "k int, o int, v string, m string").repartition(partitions)
    rolled = merging.roll_up(df.withColumn("n", F.col("o")).withColumn("ms", F.array("m")), ["k"], ["o"], ["v"], "n", "ms").first()
    assert (rolled.n_rows, rolled.n, rolled.v, rolled.ms) == (20, 190, "0", ["m0", "m1"])
    seq = sequences.running_number(df, ["k"], [F.col("o")], F.when(F.col("o") == 5, 100)).orderBy("o").collect()
    assert [r.seq for r in seq[:8]] == [1, 2, 3, 4, 5, 100, 101, 102]


def test_education_reads_its_text_once(spark):
    """Each step of the rule stands once in the plan; it used to be repeated for every label."""
    plan = spark.createDataFrame([("本科",)], "v string").select(rules.education(F.col("v")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert plan.count("regexp_replace(") == 1


def test_menus_are_collapsed_only_where_length_decides(spark):
    """the same as over the collapsed text, without the pattern over whole texts before words are counted."""
    words, blanks = ("aa", "bb", "cc"), ["", " ", "　", "​", "\t\n", "﻿"]
    texts = [f"{b}{s}{b}{e}" for b in blanks for s in ("", "Home", "aa", "aa bb", "aabbcc", "a​a b​b", "aa  bb") for e in ("", "x", " x", "x" * 30, "x" * 31, "x" * 32, " " * 40 + "x")] + [None]

    def menu(t):
        v = re.sub(f"{WS}+", " ", (t or "").replace("​", "")).strip(" ")
        n = sum(w in v for w in words)
        return v != "" and (bool(re.match(r"Home(?: |\Z)", v)) or n >= 3 or n == 2 and len(v) > 36)

    df = spark.createDataFrame([(t,) for t in texts], "v string").select("v", rules.is_navigation(F.col("v"), words, "Home").alias("m"))
    assert [(r.v, r.m) for r in df.collect()] == [(t, menu(t)) for t in texts]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 1


def test_trim_takes_every_blank_and_nothing_else(spark):
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(f"{c} x{c}y {c}",) for c in chars], "v string")
    got = df.select("v", trim(F.col("v")).alias("got"), F.regexp_replace("v", rf"^{WS}+|{WS}+\z", "").alias("want")).filter("got <> want")
    assert got.collect() == []
    assert trim_plan(spark).count("regexp_replace(") == 0


def trim_plan(spark):
    return spark.range(1).select(trim(F.lit(" a "))).selectExpr("*")._jdf.queryExecution().analyzed().toString()


def test_prose_sections_are_cut_once(spark, sf_small):
    """the pattern of the posts' section stands once in the query's plan; it used to be repeated for each field."""
    plan = catalog.QUERIES["prose_facts"](spark, sf_small)._jdf.queryExecution().analyzed().toString()
    assert plan.count(prose.POSTS[0]) == 1


def test_marks_are_looked_for_only_where_one_can_be(spark):
    """whatever holds a mark passes the one pattern that is tried before all others."""
    marks = ["--- 发现附件透视文本:x ---", "--- 工作表: x ---", "工作表: SHEET1", "sheet2", "—–", "---- x", "x ---", ".a-b {x}", "var a = document.b;"]
    df = spark.createDataFrame([(m,) for m in marks], "v string")
    assert df.filter(F.col("v").rlike(cleaning.MARKED)).count() == len(marks)
    assert all(any(r) for r in df.select(*[F.col("v").rlike(p) for p in cleaning.SHEET_MARKS]).collect())
    assert [r.c for r in spark.createDataFrame([("a  b\n\n c ",), (None,), ("<p>x</p>\n--- y",)], "v string").select(cleaning.clean_text(F.col("v")).alias("c")).collect()] == ["a b\nc", "", "x\ny"]


def test_a_repeated_text_is_read_once(spark):
    """the rule ran for every row, also where the same text came again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def length(v):
        seen.add(1)
        return None if v is None else len(v)

    texts = ["a", "bb", None, "", "bb "]
    df = spark.createDataFrame([(i, texts[i % 5]) for i in range(100)], "id int, `the text` string")
    got = dedupe.per_text(df, "the text", n=length)
    assert got.columns == ["id", "the text", "n"]
    assert sorted(map(tuple, got.collect())) == [(i, texts[i % 5], texts[i % 5] if texts[i % 5] is None else len(texts[i % 5])) for i in range(100)]
    assert seen.value == len(texts)
    assert dedupe.per_text(df.limit(0), "the text", n=length).collect() == []
