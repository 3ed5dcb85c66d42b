import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticeworks.llm import queries, toxicity


def grams(word, order=toxicity.ORDER):
    s = f"^{word}$"
    return [(s[max(0, i - order + 1) : i], s[i]) for i in range(1, len(s))]


def brute_probability(classes, corpus, y, ctx, ch, d=0.75):
    """P of ch after ctx in class y, of words by class and of all: own counts, then shared ones of ever shorter contexts."""

    def discounted(counts, ctx, lower):
        here = {x: n for (c, x), n in counts.items() if c == ctx}
        t = sum(here.values())
        return max(here.get(ch, 0) - d, 0) / t + d * len(here) / t * lower if t else lower

    counts = [Counter(g for w in corpus for g in grams(w))]
    for k in toxicity.BACKOFF[1:]:
        counts.append(Counter((c[-k:] if k else "", x) for c, x in counts[-1]))
    p = 1 / len({x for _, x in counts[0]})
    for k, n in zip(reversed(toxicity.BACKOFF), reversed(counts), strict=True):
        p = discounted(n, ctx[-k:] if k else "", p)
    return discounted(Counter(g for w in classes[y] for g in grams(w)), ctx, p)


def brute_evidence(classes, corpus, text):
    excess = letters = 0
    for w in [w for p in (text or "").lower().split() for w in toxicity.LETTERS.findall(p)]:
        llr = sum(math.log(brute_probability(classes, corpus, 1, *g) / brute_probability(classes, corpus, 0, *g)) for g in grams(w))
        excess, letters = excess + max(0, llr - toxicity.MARGIN * (len(w) + 1)), letters + len(w) + 1
    return excess / letters if letters else 0.0


CLASSES = {0: ["abc", "abd", "bcd", "bad", "abc", "préambule"], 1: ["abc", "xyz", "xyd", "bad", "préambulesque"]}
CORPUS = [*CLASSES[0], *CLASSES[1], "zabc", "qq", "abc"]


def made_table(spark):
    def counted(words):
        rows = [(y, w, n) for y, own in words.items() for w, n in Counter(own).items()]
        return toxicity.gram_counts(spark.createDataFrame(rows, "y int, word string, n long"))

    return toxicity.evidence_table(counted(CLASSES), counted({0: CORPUS}).select("ctx", "ch", "n"))


def test_table_equals_brute_force(spark):
    got = {(r.ctx, r.ch): r.llr for r in made_table(spark).collect()}
    for (ctx, ch), v in got.items():
        p = [brute_probability(CLASSES, CORPUS, y, ctx, ch or "no such letter") for y in (0, 1)]
        assert v == pytest.approx(math.log(p[1] / p[0])), (ctx, ch)
    seen = {g for own in CLASSES.values() for w in own for g in grams(w)}
    assert seen | {(c, "") for c, _ in seen} == got.keys()


def test_evidence_of_whole_texts_equals_brute_force(spark):
    rows = toxicity.numbered(made_table(spark)).toArrow()
    texts = [None, "", "xyz xyd", "abc, XYZ! q-xyz; bcd abx", "nothing known 123 here", "préambulesques " * 3, "abc bad " * 500 + "xyz", "xy" * 100]
    for limit in (0, 2, 1000):
        scorer = toxicity.Scorer(toxicity._ordered(rows, True), toxicity._ordered(rows, False), limit=limit)
        for chars in (1, 10_000):
            assert scorer.texts(texts, chars) == pytest.approx([brute_evidence(CLASSES, CORPUS, t) for t in texts], abs=1e-5)


def test_counts(spark):
    rows = [(0, "Ab, ab!"), (1, None), (1, ""), (0, "é1é 中"), (1, "z" * 200)]
    df = spark.createDataFrame(rows, "y int, text string").repartition(3)
    words = {0: ["ab", "ab", "é", "é", "中"], 1: ["z" * 64, "z" * 64, "z" * 64, "z" * 8]}
    for held in (1, 1000):
        found = toxicity.word_counts(df, held)
        assert {(r.y, r.word): r.n for r in found.collect()} == Counter((y, w) for y, own in words.items() for w in own)
        assert {(r.y, r.ctx, r.ch): r.n for r in toxicity.gram_counts(found).collect()} == Counter((y, *g) for y, own in words.items() for w in own for g in grams(w))


def test_held_out_accuracy(spark, sf):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op6_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_edge_rows(spark):
    docs = [(i, f"you idiot{i % 3} plain words here" if i % 2 else "plain words here and there") for i in range(60)]
    docs += [(100, None), (101, ""), (None, "you idiot1"), (102, "word " * 30_000 + "idiot1 idiot2 idiot1"), (1, "repeated id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as y", "3 as toxic")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(60)), (None, 1), (7, None), (8, 0), (8, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.score(df, labels).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[102].score > by[100].score == by[101].score and not by[None].held_out
    for empty in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert toxicity.score(df, empty).count() == len(docs)
    assert toxicity.score(df.limit(0), labels).collect() == []
