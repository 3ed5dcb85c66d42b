import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noticeworks.llm import queries
from noticeworks.llm.url_filter import judge, resolve, url_parts


def test_query_equals_sql(spark, sf):
    got = sorted(map(tuple, queries.op4_url_filter(spark, sf).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    assert got == sorted(con.execute(queries.OP4_SQL).fetchall(), key=repr)


ALIASES = [
    (1, "https://a.example.net/es/x", ""),  # blocked by its rule
    (2, "https://b.org/p", '<LINK href="https://a.example.net/es/x#top" REL=canonical>'),  # alias of a blocked page
    (3, "https://c.org/q", '<meta http-equiv="Refresh" content="0; url=//b.org/p">'),  # alias of an alias
    (4, "https://www.example.com/en/1", '<link rel="canonical" href="http://a.example.net/es/x">'),  # its own rule allows it
    (5, "https://d.org/r", "<link rel='stylesheet' href='http://net/fr/'>"),
    (6, "https://e.org/s", "<link rel='canonical' href='http://net/fr/unseen?a=1&amp;b=2'>"),  # the target is no page
    (7, "https://f.org/t?x", '<link rel="canonical" href="/u">'),
    (8, "https://f.org/u", '<link rel="canonical" href="https://net/fr/">'),
    (9, None, '<link rel="canonical" href="https://net/fr/">'),
    (10, "no scheme", None),
    (11, "https://g.org", '<link rel="canonical" href="https://f.org/u">'),
    (11, "https://g.org", '<link rel="canonical" href="https://f.org/u">'),
    (12, "HTTP://Sub.EXAMPLE.com?x#y", "y" * 200_000),
    (13, "https://h.org/z", '<link rel="canonical" href="https://x.com/">'),  # with 14 and 8: the component is allowed
    (14, "https://i.org/z", '<link rel="canonical" href="https://h.org/z">'),
]


def test_aliases(spark):
    df = spark.createDataFrame(ALIASES, "page_id long, url string, html string").selectExpr("*", "1 as node", "2 as host", "3 as rule")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(df, queries.URL_RULES).collect())
    verdicts = [(r[0], r[4]) for r in got]
    # 1, 2, 3 and 4 are one component; 4 is allowed explicitly, and so are those of it without a rule.
    assert verdicts == [(1, "block"), (2, "allow"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "block"), (7, "block"), (8, "block"), (9, "allow"), (10, "allow"), (11, "block"), (11, "block"), (12, "allow"), (13, "allow"), (14, "allow")]
    assert got[12][1:4] == ("sub.example.com", "", None) and got[8][1:3] == ("", "")
    without = sorted((r.page_id, r.verdict) for r in judge(df.filter("page_id <> 4"), queries.URL_RULES).collect())
    assert without[1:3] == [(2, "block"), (3, "block")]
    assert judge(df.limit(0), queries.URL_RULES).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_links_equal_sql(spark, seed):
    """Links among few addresses, with and without paths and queries, relative ones too, against the query's SQL."""
    rng = random.Random(seed)
    hosts = ["b.com", "net", "x.net", "example.com", "www.example.com", "o.org", "p.org", "q.org", "R.org"]
    tails = ["", "/", "/es/z", "/en/1", "/fr/", "?k=1", "/p?k=2", "#f", "/es/z#f"]
    targets = ["/", "?k=1", "#g", "rel", "/es/z", "//q.org", "//net/fr/"] + [f"https://{h}{t}" for h in hosts for t in tails]
    rows = []
    for i in range(80):
        link = rng.choice(targets)
        tag = rng.choice([f'<link rel="canonical" href="{link}">', f'<meta http-equiv="refresh" content="0; url={link}">', "", ""])
        rows.append((i, f"https://{rng.choice(hosts)}{rng.choice(tails)}", f"<html>{tag}</html>"))
    rows += [(90, None, '<link rel="canonical" href="/x">'), (91, "none", ""), (92, "http:///es/z", None), *rows[:3]]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), queries.URL_RULES)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(queries.OP4_SQL).fetchall(), key=repr)


@pytest.mark.parametrize(("address", "want"), [("http://x/y", "http://x/y"), ("//x/y", "http://x/y"), ("/y", "http://h.org/y"), ("y", "http://h.org/a/y"), ("?z", "http://h.org/a/b?z"), ("#z", "http://h.org/a/b?q")])
def test_resolve(spark, address, want):
    df = spark.createDataFrame([("https://h.org/a/b?q#f", address)], "url string, address string")
    assert df.select(resolve(F.col("address"), url_parts(F.col("url")))).first()[0] == want
