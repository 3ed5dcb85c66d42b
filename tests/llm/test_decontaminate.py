import random
from collections import Counter

import pytest

from noticeworks.llm import queries
from noticeworks.llm.decontaminate import ItemIndex, is_contaminated, matches


def grams(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)])


def brute(text, items, least=0.8):
    """Every window of an item's length against every item, without fingerprints."""
    words, out = (text or "").lower().split(), {}
    for item, t in items:
        other = (t or "").lower().split()
        if not words or not other:
            continue
        n = min(len(other), len(words))
        for s in range(len(words) - n + 1):
            a, b = grams(words[s : s + n]), grams(other)
            j = (a & b).total() / (a | b).total()
            if j >= least and j > out.get(item, (0, -1))[1]:
                out[item] = (s, j)
    return {k: (s, pytest.approx(j)) for k, (s, j) in out.items()}


def found(text, items):
    return {i: (s, j) for i, s, _, j in ItemIndex(items).find(text)}


def test_planted_near_passages_equal_brute_force():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 20, 60, 90, 140])))) for i in range(30)]
    n = 0
    for _ in range(150):
        item = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            k = rng.randrange(len(item) + 1)
            item[k : k + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
        text = " ".join(rng.choices(vocabulary, k=rng.choice([0, 10, 200])) + item + rng.choices(vocabulary, k=rng.choice([0, 50])))
        want = brute(text, items)
        assert found(text, items) == want
        n += len(want)
    assert n > 60


def test_windows_in_parts(monkeypatch):
    """A text with matches far apart gives the same as one whose sums are held at once."""
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=40))) for i in range(5)]
    text = " ".join(" ".join(rng.choices(["x", "y"], k=rng.randint(0, 90))) + " " + rng.choice(items)[1] for _ in range(40))
    index = ItemIndex(items)
    want, parts = index.find(text), index._parts
    for span in (1, 7, 100):
        monkeypatch.setattr(index, "_parts", lambda w, span=span: parts(w, span))
        assert index.find(text) == want and want


def test_query_equals_brute_force(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    # A similar window shares a five-word run, so only documents that do need the slow comparison.
    runs = {g for _, t in items for g in grams(t.lower().split())}
    want = {(d, i, s) for d, t in docs if runs & grams(t.lower().split()).keys() for i, (s, _) in brute(t, items).items()}
    got = {(r.doc_id, r.item_id, r.start) for r in queries.op1_benchmark_decontamination(spark, sf_small).collect()}
    assert got == want and want


def test_edge_rows(spark):
    long = "x y z " * 10_000
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A b C d e f g"), (None, "a b c d e f g h"), (4, long + "a b c d e f g"), (5, "a b c d e f"), (6, "a b c d e f g"), (6, "a b c d e f g")], "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as start")
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (None, "p q r"), (1, "a b c d e f g")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    for block in (1, 2, 100):
        got = sorted((r.doc_id or 0, r.item_id, r.start) for r in matches(docs, items, block_items=block).collect())
        assert got == sorted(2 * [(0, 1, 0), (3, 1, 0), (4, 1, 30_000), (6, 1, 0), (6, 1, 0)])
    assert sorted(r.doc_id or 0 for r in docs.filter(~is_contaminated(docs.text, items)).collect()) == [1, 2, 5]
    assert matches(docs.limit(0), items).collect() == [] and matches(docs, items.limit(0)).collect() == []
    assert docs.filter(is_contaminated(docs.text, items.limit(0))).count() == 0
