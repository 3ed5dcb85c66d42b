import re
from fractions import Fraction
from hashlib import md5

import duckdb
import pytest

from noticeworks.llm import mixing, queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Shares the words out by weight again and again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, Fraction(0)), set(names), share * sum(sizes.values())
    while left and free:
        total = sum(weight[s] for s in free)
        grown = {s: target[s] + left * weight[s] / total for s in free}
        left = sum(max(0, grown[s] - most * sizes[s]) for s in free)
        for s in free:
            target[s] = min(grown[s], Fraction(most * sizes[s]))
        free = {s for s in free if target[s] < most * sizes[s]}
    return {s: float(t) for s, t in target.items()}


def brute(rows):
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    targets, out = brute_targets(sizes), []
    for s in sizes:
        budget = int(targets[s] + 0.5)
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        own = sorted((md5(str(d).encode()).hexdigest()[:15], d, len(words(t))) for d, x, t in rows if x == s)
        for _, d, n in own:
            out.append((d, n, sizes[s], targets[s], epochs * n + max(0, min(n, rest))))
            rest -= n
    return sorted(out)


def close(got, want):
    assert [(a, b, c, e) for a, b, c, _, e in got] == [(a, b, c, e) for a, b, c, _, e in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])


@pytest.mark.parametrize("bucket_rows", [3, 10_000])
def test_equals_brute_force(spark, sf_small, bucket_rows):
    rows = [(r.doc_id, None if r.source == "src3" else r.source, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sizes(df, bucket_rows=bucket_rows).collect()
    close(sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got), brute(rows))
    per = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        per.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(a - t) <= 0.5 for a, t in per.values())


def test_query_equals_sql(spark, sf):
    got = sorted(map(tuple, queries.op3_mixing_to_target_weights(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(queries.OP3_SQL).fetchall())


def test_edge_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, "b", "x " * 5000), (4, None, "one two three"), (None, "c", "p q"), (7, "d", "u v w"), (7, "d", "u v w"), (8, "e", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "'k' as key", "2 as bucket", "0 as cut", "9 as n_chars")
    got = [tuple(r) for r in mixing.mix_sizes(df).collect()]
    assert len(got) == len(rows) and sorted(got, key=repr) == sorted((tuple(r) for r in mixing.mix_sizes(df).collect()), key=repr)
    assert {r[5] for r in got if r[0] in (1, 2, 8)} == {0}
    twins = [r[5] for r in got if r[0] == 7]
    assert twins[0] == twins[1]
    mixed = mixing.mix(df).collect()
    assert mixed[0].asDict().keys() == set(df.columns) and all(r.n_chars == len(r.text) for r in mixed)
    took = {}
    for r in mixed:
        took[r.source] = took.get(r.source, 0) + len(words(r.text))
    want = {}
    for r in got:
        want[r[1]] = want.get(r[1], 0) + r[5]
    assert took == {s: n for s, n in want.items() if n}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sizes(df).collect() == [] and mixing.mix(df).collect() == []
