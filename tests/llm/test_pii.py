import random
import re
import time
from hashlib import sha256

from noticeworks.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        s = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def digest(spans):
    return sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def agrees(rows, got):
    for (d, t), r in zip(rows, got, strict=True):
        want = brute(t)
        assert (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) == (d, *(sum(k == x for k, _, _ in want) for x in PATTERNS)), (t, want, r)
        assert r.base_sha256 == digest(want), (t, want, r)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_query_equals_brute_force(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    agrees(rows, sorted(queries.op8_pii(spark, sf).collect()))


ODD = ["a", "é", "😀", "@", ".", "-", "_", "+", " ", "  ", "(", ")", "1", "22", "255", "256", "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "a@b.co", "x.y@d-e.f.g", "1.2.3.4", "+1 (555) 555-0100", "\n", "[at]", " (at) ", "555-555-0100"]


def test_random_texts(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices(ODD, k=rng.randint(0, 14)))) for i in range(4000)]
    agrees(rows, sorted(pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))


def test_edge_rows(spark):
    texts = [None, "", "1" * 60_000, "1 " * 60_000, "a." * 60_000, "a@" + "b." * 900 + "c", "+1" + "(" * 60_000, "x" * 100_000 + "@", "1.2.3.4 " * 3000, "0001.2.3.00000255", "é😀 a@b.co é", "a@b.co a@b.co_c@d.e"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as base", "3 as span", "4 as votes")
    agrees(rows, sorted(pii.report(df).collect()))
    twice = pii.report(spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "x")], "doc_id long, text string")).collect()
    assert len(twice) == 3
    assert pii.report(df.limit(0)).collect() == []


def test_zero_parts(spark):
    """Address parts of zero are numbers up to 255 like any."""
    rng = random.Random(9)
    texts = ["10.0.0.1", "127.0.0.1", "192.168.0.1", "203.0.113.7", "8.8.8.0", "0.0.0.0", "00.000.0.1", "0.0.0.256", "0.0.0.", "000256.0.0.1", "1.2.3.0255"]
    texts += ["".join(rng.choices([*ODD, "0", "00", "10.0.0.1", "0.0.0", "."], k=rng.randint(1, 14))) for _ in range(2000)]
    rows = list(enumerate(texts))
    got = sorted(pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    agrees(rows, got)
    assert [r.n_ip for r in got[:11]] == [1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 1]


def test_long_domain(spark):
    """A domain's labels are all of the match, and what follows is searched from its end."""
    texts = ["a@" + "b." * 3000 + "c", "a@" + "b." * 60_000 + "c_x@d.e 10.0.0.1", "a@" + "b." * 1001 + "c@d.e"]
    rows = list(enumerate(texts))
    agrees(rows, sorted(pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))


def test_weak_supervision_adds_likely_spans(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        n = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        rows.append((i, f"tel: {n}" if i % 3 == 0 else f"tel: +1 ({n[:3]}) {n[4:]} end" if i % 3 == 1 else f"id={rng.randint(10**15, 10**16 - 1)}x token 300.1.2.{rng.randint(1, 9)}"))
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].spans == "phone:5:17" and got[i].n_phone == 0 for i in range(0, 300, 3))
    assert all("ip" not in got[i].spans for i in range(2, 300, 3))


def test_many_matches_in_one_text(spark):
    rows = [(1, "a@b.co " * 100_000), (2, "1.2.3.4 é " * 20_000)]
    began = time.time()
    agrees(rows, sorted(pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert time.time() - began < 120


def test_planted_spans_that_the_patterns_miss(spark):
    """Of obfuscated addresses and local numbers among ordinary text and data, 9 in 10 are found, and nothing else."""
    rng = random.Random(5)
    words = "the of and contact mail call with order from about please regards our new more".split()
    rows, planted = [], {}
    for i in range(600):
        filler = lambda: " ".join(rng.choices(words, k=rng.randint(3, 9)))
        name, host = rng.choice(["ann", "j.doe", "info"]), rng.choice(["mail", "corp-x", "uni"]) + rng.choice([".com", ".org", ".de"])
        number = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        kind = i % 6
        lead = filler() + " "
        if kind == 0:
            span = f"{name} [at] {host}"
            text = f"{lead}mail {span} {filler()}"
        elif kind == 1:
            span = rng.choice([number, f"({number[:3]}) {number[4:]}"])
            text = f"{lead}call {span} {filler()}"
        else:
            span = None
            text = lead + rng.choice([f"{name}@{host}", f"tel +1 {number}", f"version 300.{i % 9}.2.4", f"id={rng.randint(10**15, 10**16 - 1)}", f"host 10.0.{i % 9}.1", filler()])
        rows.append((i, text))
        if span:
            at = text.index(span)
            planted[i] = f"{'email' if kind == 0 else 'phone'}:{at}:{at + len(span)}"
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(span in got[i] for i, span in planted.items()) >= 0.9 * len(planted)
    for i, text in rows:
        assert got[i] - {planted.get(i)} == {f"{k}:{a}:{b}" for k, a, b in brute(text)}, text


def test_reliabilities(spark):
    """Labelers that mostly agree are trusted; one that votes at random isn't."""
    rng, rows = random.Random(3), []
    for _ in range(3000):
        y = rng.random() < 0.4
        good = [(1 if y else -1) if rng.random() < 0.9 else (-1 if y else 1) for _ in range(3)]
        rows.append(([0, *good, rng.choice([-1, 1])],))  # the first one's -1 would be proof
    patterns = spark.createDataFrame(rows, "votes array<int>").groupBy("votes").count().withColumnRenamed("count", "n")
    share, odds = pii.estimate(patterns)
    assert abs(share - 0.4) < 0.05
    assert all(abs(odds[j][1][2] - 0.9) < 0.05 and abs(odds[j][0][0] - 0.9) < 0.05 for j in range(1, 4))
    assert abs(odds[4][1][2] - 0.5) < 0.06
