"""Document quality by Bradley-Terry ranking.

Preference pairs are made of labelled rows, one of high quality preferred to one of low quality. A weight vector is
learned by logistic loss on the differences of the pairs' features, which makes weights times features the log odds
of one document being preferred to another. The cut is the quantile of all documents' ranks at the share of low
labels, and a logistic curve about it gives the score.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize
from .host_rules import measure
from .labels import labelled

FEATURES = ("log_words", "word_length", "symbols", "repeated_lines", "repeated_words", "distinct_words", "upper_case", "exclamations", "digits", "ends", "longest_run", "bars")
#: Labelled rows of each class that are learned from, and pairs made of them.
MAX_ROWS, MAX_PAIRS = 20_000, 200_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Of the quantile, whose place is right to one in so many rows.
ACCURACY = 100_000


def features(text: str | None) -> list[float]:
    """Ratios of a whole text, on a log scale so that a little of a bad thing already shows; zeros for no words."""
    text = text or ""
    n, chars, symbols, dup_lines, repeats = measure(text)
    if not n:
        return [0.0] * len(FEATURES)
    words = text.encode().split()
    letters = sum(map(str.isalpha, text)) or 1
    run = best = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    shares = (symbols / n, dup_lines / (1 + text.count("\n")), repeats / n)
    more = (sum(map(str.isupper, text)) / letters, text.count("!") / n, sum(map(str.isdigit, text)) / n, (text.count(".") + text.count("?")) / n, best / n, text.count("|") / n)
    curved = [math.log1p(20 * x) for x in (*shares, *more)]
    return [math.log1p(n), math.log1p(chars / n), *curved[:3], len(set(words)) / n, *curved[3:]]


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return measured(text)


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights that minimise log(1 + exp(-w (better - worse))) over the pairs, by Newton steps."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, d.T @ p / len(d) - ridge * w)
        w += np.clip(step, -3, 3)
        if abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_pairs: int = MAX_PAIRS) -> dict:
    """Means, scales and weights of the features, the share of low labels and the width of the curve; numbers only.

    Without labels of both classes the weights are zero, and every document has the score at the cut.
    """
    sample = labelled(docs, labels, "quality", FOLDS, F.col("fold") != HELD_OUT, max_rows)
    rows = sample.select("doc_id", "y", feature_column(F.col("text")).alias("x")).toPandas().sort_values("doc_id")  # bounded by max_rows
    x, y = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES)), rows["y"].to_numpy()
    mean, scale = (x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = (x - mean) / scale
    good, bad = z[y == 1], z[y == 0]
    if not len(good) or not len(bad):
        return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": [0.0] * len(FEATURES), "low": 0.5, "width": 1.0}
    rng, n = np.random.default_rng(0), min(max_pairs, 20 * max(len(good), len(bad)))
    w = bradley_terry(good[rng.integers(0, len(good), n)], bad[rng.integers(0, len(bad), n)])
    totals = {r.y: r.n for r in labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("y").agg(F.count("*").alias("n")).collect() if r.y in (0, 1)}
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": w.tolist(), "low": totals[0] / (totals[0] + totals[1]), "width": float((z @ w).std()) or 1.0}


def rank_column(text: Column, model: dict) -> Column:
    """Weights times features: the log odds of a text being preferred, up to a constant."""

    @F.pandas_udf("double")
    def ranked(texts: pd.Series) -> pd.Series:
        mean, scale, weights = (np.array(model[k]) for k in ("mean", "scale", "weights"))
        return pd.Series([float((np.array(features(t)) - mean) / scale @ weights) for t in texts], dtype="float64")

    return ranked(text)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    The cut is the quantile of all documents' ranks at the share of low labels, and has the score THRESHOLD. Only
    texts are scored. Null and empty texts have zeros for features and are scored like any. Repeated rows are scored
    alike; null ids stay and are not held out. Other columns of docs and labels are not read.
    """
    model = fit(docs, labels, **options)
    ranked = materialize(docs.select("doc_id", rank_column(F.col("text"), model).alias("rank")), "ranks")
    low = ranked.agg(F.percentile_approx("rank", model["low"], ACCURACY)).first()[0]
    above = ranked.filter(F.col("rank") > F.lit(low)).agg(F.min("rank")).first()[0]
    # Between two ranks, so that equal ones fall on one side; on the rank itself where all from there on are equal.
    cut = 0.0 if low is None else low if above is None else (low + above) / 2
    scaled = (F.col("rank") - cut) * (4 / model["width"]) + math.log(THRESHOLD / (1 - THRESHOLD))
    scored = ranked.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), (1 / (1 + F.exp(-scaled))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
