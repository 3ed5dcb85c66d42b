"""Edge rows of table operators; the queries hold the rules against SQL."""

from pyspark.sql import functions as F

from noticeworks.operators import dedupe, tables
from noticeworks.plans import tables as plans

HEAD = "序号\t单位\t单位\t岗位\t代码\t人数\t学历\t专业\t年龄\t面试方式\t比例\t其他要求"
FULL = "1\t湖南学院\t湖南学院\t教师\tA01\t2\t硕士\t教育学\t35周岁以下\t面试\t1:3\t限高校"


def lines(spark, *texts):
    rows = [(d, i, x) for d, text in enumerate(texts) for i, x in enumerate(text)]
    return spark.createDataFrame(rows, "doc long, line_no int, line string").withColumns({"_v": F.lit("clash"), "_open": F.lit(1), "_n": F.lit(2), "row": F.lit(3)})


def mended(spark, *texts):
    rows = tables.mended_rows(tables.collect_rows(lines(spark, *texts), ["doc"]), ["doc"]).collect()
    return {(r.doc, r.row_no): r.cells for r in rows}


def test_broken_rows_are_mended(spark):
    got = mended(spark, [HEAD, FULL, "2\t湖南学院\t辅导员\tA02\t1\t本科\t法学\t40周岁以下\t面试\t1:2", "7 湖南学院\t湖南学院\t校医\tA03\t1\t本科\t医学\t40周岁以下 面试\t1:2\t无", "湖南学院\t湖南学院\t会计\tA04\t1\t本科\t会计学", None, "合计\t\t\t4", "注：", "9\t不\t算\t教师"])
    assert got[0, 2] == ["2", "湖南学院", "湖南学院", "辅导员", "A02", "1", "本科", "法学", "40周岁以下", "面试", "1:2"]
    assert got[0, 3] == ["7", "湖南学院", "湖南学院", "校医", "A03", "1", "本科", "医学", "40周岁以下", "面试", "1:2", "无"]
    # A row without a number is aligned before it gets one, so its second cell counts as the organisation.
    assert got[0, 4][:5] == ["8", "湖南学院", "湖南学院", "湖南学院", "会计"]
    assert set(got) == {(0, 1), (0, 2), (0, 3), (0, 4)}


def test_a_longer_reference_changes_later_rows_only(spark):
    """A mended row may become the longest one, and is the reference of those below it."""
    short = "\t".join(FULL.split("\t")[:10])
    got = mended(spark, [HEAD, short, "2\t湖南学院\t干事\tA02\t1\t本科\t法学\t40周岁以下 面试", "3\t湖南学院\t干事\tA05\t1\t本科\t法学\t40周岁以下\t面试\t1:2"])
    assert got[0, 2] == ["2", "湖南学院", "湖南学院", "干事", "A02", "1", "本科", "法学", "40周岁以下", "面试"]
    assert len(got[0, 3]) == 10 and got[0, 3][2] == "干事"


def test_tables_without_header_or_rows(spark):
    assert mended(spark, ["无表头\t一行\t二列"], [HEAD], [None, ""], [HEAD.replace("\t", " ")]) == {}
    empty = lines(spark, ["x"]).limit(0)
    assert tables.mended_rows(tables.collect_rows(empty, ["doc"]), ["doc"]).collect() == []
    assert tables.jobs(tables.mended_rows(tables.collect_rows(empty, ["doc"]), ["doc"])).collect() == []


def test_wrapped_cells(spark):
    rows = tables.collect_rows(lines(spark, [HEAD, "1\t甲校\t乙部\t教师\tA01\t1\t硕士\t（1）教育学", "（2）心理学", "\t35周岁以下\t限高校", "第二行"]), ["doc"]).collect()
    assert {r.row_no: r.cells for r in rows}[1] == ["1", "甲校", "乙部", "教师", "A01", "1", "硕士", "（1）教育学 （2）心理学", "35周岁以下", "限高校 第二行"]


def test_jobs_keep_keys_and_clashing_names(spark):
    rows = tables.mended_rows(tables.collect_rows(lines(spark, [HEAD, FULL]), ["doc"]), ["doc"])
    job = tables.jobs(rows).first()
    assert (job.doc, job.id, job.title, job.slots, job.education, job.major, job.age, job.other) == (0, "A01", "教师 · A01", 2, "硕士研究生及以上", "教育学", "35周岁以下", "限高校")


def test_two_passes_are_one_job(spark, monkeypatch):
    """Rows are made once, and tables that two passes settle are written once."""
    names, plain = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df, name: names.append(name) or plain(df, name))
    rows = [HEAD, FULL, "2\t湖南学院\t辅导员\tA02\t1\t本科\t法学\t40周岁以下\t面试\t1:2"]
    assert len(mended(spark, rows, rows)) == 4
    assert names == ["cells", "mended"]


def test_lines_and_headers_that_come_again_are_read_once(spark, monkeypatch):
    """each line and each header was read anew in every table."""
    counts, plain = {}, dedupe.written

    def written(df, name):
        out = plain(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(dedupe, "written", written)
    table = [HEAD, FULL, "", "2\t湖南学院\t辅导员\tA02\t1\t本科\t法学", "\t40周岁以下\t面试\t1:2"]
    rows = tables.collect_rows(lines(spark, *[table] * 20), ["doc"])
    layouts = tables.header_layout(rows, ["doc"]).collect()
    assert len(layouts) == 20 and {r.data_start for r in layouts} == {1}
    assert {r["columns"].major for r in layouts} == {7}
    assert counts == {"texts": [5, 1], "held": [20]}


AGAIN = 3 * 1_000_003  # the sheets of keys that lie so far apart are alike


def orders(spark, path, keys):
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{path}/orders.parquet")
    return str(path)


def rows_written(monkeypatch, *modules):
    """Rows of each table that these modules write, by its name."""
    counts, plain = {}, tables.written

    def written(df, name):
        out = plain(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    for m in modules:
        monkeypatch.setattr(m, "written", written)
    return counts


def by_key(df, key, far):
    """The other columns' rows of keys that lie `far` apart, one list each."""
    got = {}
    for r in df.collect():
        got.setdefault(r[key] // far, []).append((r[key] % far, *[str(r[c]) for c in df.columns if c != key]))
    return {at: sorted(rows) for at, rows in got.items()}


def test_sheets_that_come_again_are_jobs_once(spark, tmp_path, monkeypatch):
    """each sheet's rows were made, mended and read as jobs, however often the sheet comes."""
    keys = range(6, 15)
    where = orders(spark, tmp_path, [k + AGAIN * j for k in keys for j in range(4)])
    counts = rows_written(monkeypatch, tables, dedupe)
    got = by_key(plans.sheet_jobs(spark, where), "id", AGAIN)
    assert set(got) == {0, 1, 2, 3} and got[0] and all(rows == got[0] for rows in got.values())
    assert counts["contents"] == [len(keys)]
    alone = spark.createDataFrame([(k,) for k in keys], "o_orderkey long").selectExpr(*plans.SHEETS.spark_columns)
    lines = sum(len(r.body.split("\n")) for r in alone.collect())
    assert counts["cells"][0] <= lines and counts["mended"][0] <= lines


def test_a_sheet_whose_key_comes_twice_has_its_lines_twice(spark, tmp_path):
    where, keyless = orders(spark, tmp_path / "keys", [8, 8, 11, 14, 14, 14]), orders(spark, tmp_path / "keyless", [8, 8, 11, None, 14, 14, 14])
    bodies = plans.SHEETS.rows(spark, where).select("id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    want = tables.collect_rows(bodies, ["id"]).select("id", F.col("row_no").cast("int").alias("row_no"), F.array_join("cells", "|").alias("cells"))
    assert sorted(plans.sheet_rows(spark, keyless).collect()) == sorted(plans.sheet_rows(spark, where).collect()) == sorted(want.collect()) != []


def test_notices_with_the_same_sheets_are_rolled_up_once(spark, tmp_path, monkeypatch):
    """jobs were gathered and rolled up for every notice, whether or not its sheets came before."""
    keys = range(6, 15)
    where = orders(spark, tmp_path, [k + AGAIN * j for k in keys for j in range(4)])
    counts = rows_written(monkeypatch, tables, dedupe, plans)
    got = by_key(plans.sheet_requirements(spark, where), "doc", AGAIN // 3)
    assert set(got) == {0, 1, 2, 3} and got[0] and all(rows == got[0] for rows in got.values())
    assert counts["contents"] == [len(keys), 3] and counts["rolled"] == [len(got[0])]
    assert counts["once"][0] == sum(int(r[1]) for r in got[0])


def test_notices_with_the_same_sheets_are_stored_rows_once(spark, tmp_path, monkeypatch):
    """rows to store were made for every notice, whether or not its sheets came before."""
    keys = range(6, 15)
    where = orders(spark, tmp_path, [k + AGAIN * j for k in keys for j in range(4)])
    counts = rows_written(monkeypatch, tables, dedupe, plans)
    got = by_key(plans.sheet_items(spark, where), "doc", AGAIN // 3)
    assert set(got) == {0, 1, 2, 3} and got[0] and all(rows == got[0] for rows in got.values())
    assert counts["contents"] == [len(keys), 3] and counts["items"] == [len(got[0])]
