import random
import re
from collections import Counter

import duckdb

from noticeworks.llm import host_rules, queries


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force():
    rng = random.Random(5)
    texts = [None, "", " \n\t\r\x0b\x0c", "a a a a", "a b c a b c", "é# x\n\n \n \né# x", "x" * 100_000, "a b " * 20_000]
    texts += ["".join(rng.choice("ab  \n#é\t") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        assert host_rules.measure(t) == brute(t), t


def test_query_equals_sql(spark, sf):
    got = sorted(map(tuple, queries.op7_host_quality_rules(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(queries.OP7_SQL).fetchall())


def test_bad_hosts_fall_and_small_hosts_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, f"h{i % 400}", bad if i < 60 else good) for i in range(8000)]
    rows += [(10_000 + i, "farm", good if i % 10 == 0 else bad) for i in range(500)]
    rows += [(20_000, "tiny", bad), (20_001, "tiny", good), (20_002, "tiny", bad), (30_000, None, good), (30_001, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as host", "2 as n", "3 as rate", "true as kept")
    got = {r.doc_id: r for r in host_rules.judge(df).collect()}
    assert len(got) == len(rows)
    assert not any(r.kept for r in got.values() if r.host == "farm")
    assert got[20_001].kept and got[20_001].rate_few_words < 0.5 and not got[20_000].kept
    assert got[30_000].kept and not got[30_001].kept
    assert all(got[i].kept for i in range(60, 8000))


def test_bad_hosts_among_few(spark):
    """One to eight bad hosts of twenty fall, and one of three; half failing, or failing altogether; a small host stays."""
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    for hosts, wrong in ((20, 1), (20, 2), (20, 5), (20, 8), (3, 1)):
        for share in (2, 1):
            rows = [(h * 1000 + i, f"h{h}", bad if (i % share == 0 if h < wrong else i % 20 == h % 3) else good) for h in range(hosts) for i in range(120 + h)]
            rows += [(90_000 + i, "tiny", bad if i < 2 else good) for i in range(3)]
            df = spark.createDataFrame(rows, "doc_id long, source string, text string")
            got = host_rules.judge(df).filter("not base_failed").groupBy("host").agg({"kept": "max"}).collect()
            kept = {r[0] for r in got if r[1]}
            assert kept == {f"h{h}" for h in range(wrong, hosts)} | {"tiny"}, (hosts, wrong, share)
            con = duckdb.connect()
            documents = df.toPandas()  # noqa: F841
            want = con.execute(queries.OP7_SQL).fetchall()
            names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
            assert sorted(map(tuple, host_rules.judge(df).select(*names).collect())) == sorted(want)


def test_each_rule_counts_for_itself(spark):
    """Hosts stand out by symbols and by repeated lines, though no document of theirs fails by itself."""
    plain = [f"w{i}" for i in range(60)]
    texts = {"plain": " ".join(plain), "marks": " ".join(plain) + " # # # # # # # #", "lines": " ".join(plain) + "\nsame x\nsame x\nsame x" * 3}
    rows = [(i, f"h{i % 300}", texts["plain"]) for i in range(6000)] + [(7000 + i, k, texts[k]) for i in range(200) for k in ("marks", "lines")]
    rows += [rows[0], (None, "h1", texts["plain"]), (9000, "h2", texts["marks"])]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(got) == len(rows) and not any(r.base_failed for r in got)
    assert {r.host for r in got if not r.kept} == {"marks", "lines"}


def test_empty_table(spark):
    assert host_rules.judge(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
