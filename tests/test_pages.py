from pyspark.sql import functions as F

from noticeworks.functions import urls
from noticeworks.operators import elements, pages


def found(spark, *htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "id long, html string").withColumns({"at": F.lit("clash"), "name": F.lit(1), "start": F.lit(2)})
    return elements.elements(df, "id", "html")


def texts(spark, html, selector):
    e, t = found(spark, html)
    return [r.text for r in elements.with_text(elements.select(e, selector), t).orderBy("start").collect()]


def test_selectors(spark):
    html = '<div id=a class="x y"><p>one</p><p class=y>two<br>more</p></div><ul class="list"><li>1<li>2<ul><li>2a</ul><li class=last>3</ul><table><tr><td>a<td>b<tr><th>c</th><td>d</td></table><!-- <p>no</p> --><script>var p = "<p>no</p>";</script>'
    assert texts(spark, html, "p") == ["one", "twomore"]
    assert texts(spark, html, "#a .y, div.x.y") == ["onetwomore", "twomore"]
    assert texts(spark, html, "ul.list li") == ["1", "22a", "2a", "3"]
    assert texts(spark, html, "ul ul li") == ["2a"]
    assert texts(spark, html, "td:last-child, th:first-child") == ["b", "c", "d"]
    assert texts(spark, html, "li:last-child") == ["2a", "3"]
    assert texts(spark, html, "[class]") == ["onetwomore", "twomore", "122a3", "3"]
    assert texts(spark, html, "tr td") == ["a", "b", "d"]


def test_broken_pages(spark):
    """Tags that never end last to the page's end; stray ends, odd quotes and unclosed comments do no harm."""
    assert texts(spark, "<div>a<span>b", "div") == ["ab"]
    assert texts(spark, "</div><div>a</div></div>b<div>c</div>", "div") == ["a", "c"]
    assert texts(spark, "<a href='x>y' title=\"a>b\">t</a> 1 < 2 <a href=z>u</a>", "a[href]") == ["t", "u"]
    assert texts(spark, "<p>a</p><!-- open <p>b</p>", "p") == ["a"]
    assert texts(spark, "<p>a</p><script>open <p>b</p>", "p") == ["a"]
    e, t = found(spark, None, "", "plain", "<br>")
    assert e.collect() == [] and elements.with_text(e, t).collect() == []
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert texts(spark, deep, "#none") == [] and len(texts(spark, deep, "div")) == 3000


def test_attributes(spark):
    row = spark.createDataFrame([("<a HREF = '/x?a=1&amp;b=2' data-href=no hidden>",)], "t string")
    got = row.select(elements.attribute(F.col("t"), "href").alias("h"), elements.attribute(F.col("t"), "hidden").alias("e"), elements.attribute(F.col("t"), "id").alias("i")).first()
    assert (got.h, got.e, got.i) == ("/x?a=1&b=2", "", None)


def test_resolve(spark):
    base = "HTTP://A.org/x/y/z.htm?q=1#f"
    rows = {"../b.htm": "http://a.org/x/b.htm", "./c/./d/../e?x#y": "http://a.org/x/y/c/e?x#y", "/r/../s": "http://a.org/s", "?k": "http://a.org/x/y/z.htm?k", "#t": "http://a.org/x/y/z.htm?q=1#t", "": "http://a.org/x/y/z.htm?q=1", "//B.net/p": "http://B.net/p", "https://C.de": "https://c.de/", "mailto:x@y": "mailto:x@y", "../../../..": "http://a.org/", "a": "http://a.org/x/y/a"}
    df = spark.createDataFrame([(h,) for h in rows], "h string")
    got = {r.h: r.u for r in df.select("h", urls.resolve(F.col("h"), F.lit(base)).alias("u")).collect()}
    assert got == rows
    assert df.select(urls.resolve(F.col("h"), F.lit("none")).alias("u")).filter("u is null").count() == len(rows) - 2


def test_labelled_facts(spark):
    rows = [("年龄：35岁，学历：硕士 专业要求: 法学；工作经历：两年。其他要求：有证", ("35岁，", "硕士研究生及以上", "法学", "工作经历：两年；有证", "")), ("", ("", "", "", "", "")), (None, ("", "", "", "", "")), ("年龄：", ("", "", "", "", "")), ("学历：高中 政治面貌：党员", ("", "高中", "", "", "党员"))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    for r in df.select("i", pages.labelled_facts(F.col("t")).alias("f")).collect():
        assert tuple(r.f) == rows[r.i][1]


def test_tables_in_cells_and_short_tables(spark):
    e, t = found(spark, "<table><tr><td>岗位</td></tr></table>", "<table><tr><td>岗位<td>人数</tr><tr><td>教师<td><table><tr><td>3 人</table></tr></table>", None)
    jobs = pages.recruitment_tables(pages.table_rows(e, t)).collect()
    # The inner table's row is one of the outer table, too.
    assert sorted((r.key, r.title, r.slots) for r in jobs) == [(1, "3 人", None), (1, "教师", 3)]
    assert {r.key: r.summary for r in pages.table_summary(pages.recruitment_tables(pages.table_rows(e, t))).collect()} == {1: "岗位：教师 人数：3\n岗位：3 人"}


def test_short_main_texts(spark):
    """Where all selected texts are short, the body stands in, unless the selectors alone decide."""
    html = '<body>' + "menu " * 30 + '<div class="v_news_content">short</div><article>a longer one</article></body>'
    e, t = found(spark, html, None)
    df = spark.createDataFrame([(0,), (1,)], "id long")
    got = {r.id: (r.selector, r.main_text) for r in pages.main_text(df, e, t, "id").collect()}
    assert got[0][0] is None and got[0][1].startswith("menu menu") and got[1] == (None, "")
    alone = {r.id: (r.selector, r.main_text) for r in pages.main_text(df, e, t, "id", whole=None).collect()}
    assert alone == {0: ("article", "a longer one"), 1: (None, "")}
    e, t = found(spark, '<div class="v_news_content">window.openx(1)</div><article>Éaux.</article>')
    assert [r.main_text for r in pages.main_text(df.limit(1), e, t, "id", whole=None, leftovers=(*pages.LEFTOVERS, pages.BARE_CALL)).collect()] == ["Éaux."]


def test_elements_are_written_once(spark, monkeypatch):
    names, plain = [], elements.written
    monkeypatch.setattr(elements, "written", lambda df, name: names.append(name) or plain(df, name))
    e, t = found(spark, "<ul><li>a</ul><p>b</p>")
    assert elements.select(e, "li, p").count() == 2 and t.count() == 1
    assert sorted(names) == ["page-elements", "page-texts", "page-tokens"]
