import datetime as dt

from pyspark.sql import Observation
from pyspark.sql import functions as F

from noticeworks.functions import institutions
from noticeworks.operators import discovery, facts, sequences, snapshots, subjects

READING = "id int, kind string, rank int, " + ", ".join(f"{f} {t}" for f, t in facts.FACTS.items())


def reading(id, kind, rank=0, **given):
    return (id, kind, rank, *[given.get(f) for f in facts.FACTS])


def test_facts_of_any_number_of_readings(spark):
    rows = [
        reading(1, "table", 2, age="c", majors=["z", "x"], notes="n2", table_sum=5, deadline="2026-01-02"),
        reading(1, "table", 1, age="b", majors=["y"], notes="n1", job_slots=["2", "3"], deadline="待定"),
        reading(1, "main", 0, majors=["x"], notes="n1", positions="9", deadline="另行通知", education="高中"),
        reading(2, "main", 0, no_recruitment=True, age="a", deadline="2026-01-01", positions="3"),
        reading(2, "table", 0, education="本科", deadline="2026-01-01", positions="4", notes=""),
        reading(3, "main"),
        reading(None, "main", 0, positions="若干", fresh=False),
    ]
    df = spark.createDataFrame(rows, READING).withColumns({"_order": F.lit("clash"), "_silent": F.lit(1), "v": F.lit(2)})
    got = {r.id: r for r in facts.merge_facts(df, ["id"]).collect()}
    one = got[1]
    assert (one.age, one.majors, one.notes, one.deadline, one.positions, one.education) == ("b", ["x", "y", "z"], "n1\nn2", "2026-01-02", "5", None)
    assert (one.deadline_source, one.positions_source) == ("table-fallback", "table")
    assert one.origins == {"age": "table", "majors": "main+table", "notes": "main+table", "deadline": "table", "positions": "table"}
    assert (got[2].age, got[2].deadline, got[2].positions, got[2].education, got[2].origins) == (None, None, None, "本科", {"education": "table"})
    assert (got[3].majors, got[3].origins, got[3].notes) == ([], {}, None)
    assert (got[None].positions, got[None].positions_source, got[None].fresh) == ("若干", "main-fallback", False)
    m = facts.merge_facts(df, ["id"])
    assert {r.id: r.u for r in m.select("id", facts.is_useful(m).alias("u")).collect()} == {1: True, 2: True, 3: False, None: True}
    assert facts.merge_facts(df.limit(0), ["id"]).collect() == []


def test_walk_is_bounded_and_meets_cycles(spark):
    links = spark.createDataFrame([("a", "b", ""), ("b", "a", ""), ("b", "c", ""), ("a", "c", ""), ("c", "d", ""), ("d", "e", ""), ("a", None, ""), (None, "f", ""), ("a", "b", "")], "page string, url string, title string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "url string")
    assert {r.url: r.depth for r in discovery.walk(links, seeds, F.lit(True), 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.url: r.depth for r in discovery.walk(links, seeds, F.col("url") != "c", 9).collect()} == {"a": 0, "b": 1}
    assert discovery.walk(links, seeds.limit(0), F.lit(True)).collect() == []


def test_institutions(spark):
    rows = [("湖南大学科技学院招聘", "https://x.org/"), ("湖南大学招聘", None), ("", "https://rsc.hnu.edu.cn/a"), ("", "https://abc.edu.cn/a"), (None, None), ("短", "ftp://h.com")]
    df = spark.createDataFrame(rows, "t string, u string")
    got = df.select(institutions.known(F.col("t")).alias("k"), institutions.name_of(F.col("t"), F.col("u")).alias("n")).collect()
    assert [r.k and r.k.name for r in got] == [None, "湖南大学", None, None, None, None]
    assert [r.n for r in got] == ["湖南大学科技学院", "湖南大学", "湖南大学", "abc.edu.cn", "未命名来源", "短"]


def test_subjects_by_either_containment(spark):
    terms = subjects.expanded(spark.createDataFrame([("法学",), ("工",), ("data  心理",), (" ",), (None,)], "keyword string"), subjects.family_table(spark))
    texts = [(1, "民商法", None), (2, "法", ""), (3, None, None), (4, "Big DATA", "x"), (5, "应用 心理", "岗"), (6, "工", None), (6, "工", None), (7, "、，", None)]
    df = spark.createDataFrame(texts, "id int, a string, b string").withColumns({"whole": F.lit(1), "term": F.lit("clash")})
    got = {(r.keyword, r.id) for r in subjects.search(df, terms, "id", ["a", "b"]).collect()}
    assert got == {("法学", 1), ("法学", 2), ("工", 6), ("data  心理", 4), ("data  心理", 5)}


def test_janitor_counts_what_it_does(spark):
    now, old, new = (dt.datetime(2024, 6, d) for d in (20, 1, 19))
    rows = [(1, "jobs", old, False, None), (2, "jobs", new, True, old), (3, "raw", old, False, None), (4, "raw", old, True, new), (5, "raw", None, True, old), (6, "jobs", None, False, None), (7, None, old, True, old)]
    df = spark.createDataFrame(rows, "id int, kind string, deadline timestamp, is_deleted boolean, deleted_at timestamp")
    seen = Observation()
    got = {r.id: r for r in snapshots.janitor(df, F.lit(now), {"jobs": 5}, "kind", seen).collect()}
    assert set(got) == {1, 3, 4, 6} and got[1].is_deleted and got[1].deleted_at == now and not got[3].is_deleted
    assert seen.get == {"late_jobs": 1, "gone_jobs": 1, "gone_raw": 2}


def test_places_over_all_rows_meet_in_no_one_task(spark):
    rows = [(i * 7919 % 1009, "x") for i in range(1009)] + [(2000, "y")] * 3 + [(None, "z")]
    df = spark.createDataFrame(rows, "n long, v string").repartition(5)
    placed = sequences.numbered(df, [F.desc("n")])
    got = sorted((r.place, r.n, r.v) for r in placed.collect())
    assert [p for p, _, _ in got] == list(range(1, len(rows) + 1))
    assert [n for _, n, _ in got] == sorted((n for n, _ in rows if n is not None), reverse=True) + [None]
    assert sequences.numbered(df.limit(0), [F.col("n")]).collect() == []


def test_what_comes_again_is_cleaned_once_and_the_last_counts(spark):
    old = spark.createDataFrame([(1, "/a", "旧公告招聘教师", "旧")], "id long, url string, title string, raw string")
    new = spark.createDataFrame([(i, "/a", "旧公告招聘教师", "新文甲" if i % 2 else "新文乙") for i in range(2, 9)] + [(20, "/b", "某县公开招聘", "文"), (21, "/b", "某县公开招聘", "文")], "id long, url string, title string, raw string")
    out = snapshots.upsert_postings(old, new, ["url"], "title", "raw", ["raw"], [F.col("id")])
    assert sorted((r.id, r.url, r.raw, r.outcome) for r in out.collect()) == [(1, "/a", "新文乙", "updated"), (21, "/b", "文", "created")]
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_link_on_many_pages_is_scored_once_at_its_least_depth(spark):
    links = spark.createDataFrame([(f"p{i}", "https://rsc.hnu.edu.cn/zpxx/index.htm", "湖南大学招聘") for i in range(50)], "page string, url string, title string")
    visited = spark.createDataFrame([(f"p{i}", 1 + i % 3) for i in range(50)], "url string, depth int")
    found = discovery.candidates(links.union(links), visited, F.lit(True))
    assert found.count() >= 1 and found.filter("depth <> 1").isEmpty()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
