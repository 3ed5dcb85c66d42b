import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from noticeworks.llm import queries, spelling


def brute_words(rows, least_length=7, least_count=2):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times=10):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words)


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_equals_brute_force(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    expected = brute(brute_words(rows))
    assert found(queries.op13_spelling_variants(spark, sf_small)) == expected
    assert any(form for _, form, *_ in expected)


@pytest.mark.parametrize("per", [1, 3, 2_000])
def test_near_words_of_few_letters(spark, per):
    """Words over few letters share most keys; nulls, odd letters, ties, chains and replacements within one band."""
    rng = random.Random(per)
    words = {"".join(rng.choice("aeé×ÿz") for _ in range(rng.randrange(1, 6))): rng.choice([2, 3, 25, 25, 400, 5000]) for _ in range(250)}
    words |= {"a" * n: 10**n for n in range(1, 9)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("i", F.lit(1))
    assert found(spelling.variants(df, per=per)) == brute(words)


def test_edge_texts(spark):
    rows = [(None, "Straßenbahn straßenbahn STRASSE"), (1, None), (2, ""), (3, "12 34 _ short"), (4, "ÉCOLIÈRE écolière ÉCOLIÈRE"), (5, "Wordword, WORDWORD wordwords×÷x " * 40), (5, "Wordword"), (5, "Wordword"), (6, "x" * 100_000), (7, "x" * 100_000)]
    rows += [(i, "variant variants variantt varaint") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(None).cast("long"))
    assert found(spelling.spelling_variants(df)) == brute(brute_words(rows))


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
