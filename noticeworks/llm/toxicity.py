"""Toxicity by two class-conditional Kneser-Ney models of how expressions are spelled.

An expression is a run of letters within what stands between white space, lower-cased; runs of more than 64 letters
are taken 64 at a time. Each class has counts of a letter after the seven before it (with marks for an expression's
ends) from its labelled rows, discounted and backed off to shared Kneser-Ney counts of all documents, labelled or not:
how often each letter follows the same seven, then in how many of those it follows shorter contexts. So a rare
expression is judged by the parts that were seen, weighed by how common they are in the corpus, and where neither
class knows a context both back off to the same counts and nothing is decided.

An expression is compared by its toxic less its ordinary log-likelihood, for each of its letters. Ordinary words
spread a little around zero and would drown a few insults, so what counts is by how much this exceeds a margin, and a
text's evidence is the mean of that over all its letters. A logistic curve that is fitted on labelled rows which the
models haven't seen maps it to a score.

The table that is broadcast has 12 bytes for each context and letter of the sample of labelled rows, which is bounded
in rows and in characters.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import each, fold, materialize, passing, resident
from .labels import labelled

#: Letters of a gram, context lengths that the shared counts back off through, discount, margin a letter.
ORDER, BACKOFF, DISCOUNT, MARGIN, LONGEST = 8, (7, 5, 3, 1, 0), 0.75, 0.4, 64
#: Labelled rows of each class that are learned from, and their characters.
MAX_ROWS, MAX_CHARS = 5_000, 8_000_000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
FACTORS = np.random.default_rng(42).integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_counts(texts: DataFrame, held: int = 100_000) -> DataFrame:
    """(y, word, n): counts of the expressions of texts (y, text), aggregated in each task before they are shuffled.

    A task holds at most about `held` distinct pieces of text, and one text's, at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, Counter] = {}

        def drain() -> pa.RecordBatch:
            found: dict[int, Counter] = {}
            for y, own in pieces.items():
                words = found.setdefault(y, Counter())
                for piece, n in own.items():
                    for word in LETTERS.findall(piece.lower()):
                        words[word] += n
            pieces.clear()
            columns = [pa.array([y for y, own in found.items() for _ in own], pa.int32()), pa.array([w for own in found.values() for w in own], pa.string()), pa.array([n for own in found.values() for n in own.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["y", "word", "n"])

        for batch in batches:
            for y, text in zip(each(batch["y"]), each(batch["text"]), strict=True):
                own = pieces.setdefault(y, Counter())
                own.update((text or "").split())
                if len(own) > held:
                    yield drain()
        yield drain()

    return texts.select("y", "text").mapInArrow(count, "y int, word string, n long").groupBy("y", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(y, ctx, ch, n): each letter of words (y, word, n), and the end mark, after the order - 1 characters before it."""
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = F.transform(F.sequence(F.lit(2), F.length("marked")), lambda i: F.struct(F.substring("marked", F.greatest(F.lit(1), i - (order - 1)), F.least(F.lit(order - 1), i - 1)).alias("ctx"), F.substring("marked", i, F.lit(1)).alias("ch")))
    return words.select("y", "n", marked.alias("marked")).select("y", "n", F.explode(grams).alias("g")).groupBy("y", "g.ctx", "g.ch").agg(F.sum("n").alias("n"))


def shared_probabilities(wanted: DataFrame, corpus: DataFrame, lengths: Sequence[int] = BACKOFF, discount: float = DISCOUNT) -> DataFrame:
    """(ctx, ch, shared): Kneser-Ney probability, in the corpus, of wanted's letters after their contexts.

    corpus: (ctx, ch, n) of all documents, contexts of up to lengths[0] characters; it has all of wanted, whose texts
    are documents. A shorter context counts the longer ones that a letter was seen after. The tables of contexts stay
    distributed; only what wanted asks for is joined.
    """
    letters = 0
    level, found = corpus, wanted.select("ctx", "ch").distinct()
    for k in lengths:
        if k != lengths[0]:
            level = level.select(F.expr(f"right(ctx, {k})").alias("ctx"), "ch").groupBy("ctx", "ch").agg(F.count("*").alias("n"))
        level = materialize(level, "contexts")
        letters = letters or level.select("ch").distinct().count()
        after = W.partitionBy("ctx")  # at most the alphabet
        own = level.select(F.col("ctx").alias(f"x{k}"), F.col("ch").alias("ch"), F.col("n").alias(f"n{k}"), F.sum("n").over(after).alias(f"t{k}"), F.count("*").over(after).alias(f"y{k}"))
        found = found.withColumn(f"x{k}", F.expr(f"right(ctx, {k})")).join(own.hint("merge"), [f"x{k}", "ch"])
    p = F.lit(1.0 / max(1, letters))
    for k in reversed(lengths):
        p = (F.greatest(F.col(f"n{k}") - discount, F.lit(0.0)) + discount * F.col(f"y{k}") * p) / F.col(f"t{k}")
    return found.select("ctx", "ch", p.alias("shared"))


def evidence_table(own: DataFrame, corpus: DataFrame, lengths: Sequence[int] = BACKOFF, discount: float = DISCOUNT) -> DataFrame:
    """(ctx, ch, llr): log of toxic over ordinary probability; ch is empty for what a class's own counts lack.

    own: (y, ctx, ch, n) of the labelled rows. After a context, a letter that neither class has seen there leaves
    only the two backoff weights to compare, as the shared probability cancels out.
    """
    by_letter = own.groupBy("ctx", "ch").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    after = W.partitionBy("ctx")
    for y in (0, 1):
        by_letter = by_letter.withColumn(f"t{y}", F.sum(f"n{y}").over(after)).withColumn(f"d{y}", F.sum((F.col(f"n{y}") > 0).cast("long")).over(after))
    seen = materialize(by_letter, "class-contexts")

    def weight(y: int) -> Column:
        return F.when(F.col(f"t{y}") > 0, discount * F.col(f"d{y}") / F.col(f"t{y}")).otherwise(1.0)

    def probability(y: int) -> Column:
        first = F.when(F.col(f"t{y}") > 0, F.greatest(F.col(f"n{y}") - discount, F.lit(0.0)) / F.col(f"t{y}")).otherwise(0.0)
        return first + weight(y) * F.col("shared")

    letters = seen.join(shared_probabilities(seen, corpus, lengths, discount).hint("merge"), ["ctx", "ch"]).select("ctx", "ch", F.log(probability(1) / probability(0)).alias("llr"))
    contexts = seen.select("ctx", F.lit("").alias("ch"), F.log(weight(1) / weight(0)).alias("llr")).distinct()
    return letters.union(contexts)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their marks, one after another, and how many stand before each within its word."""
    marked = "".join([f"^{w}$" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return codes, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _gram_keys(codes: np.ndarray, before: np.ndarray, order: int, skip: int = 0) -> np.ndarray:
    """One number for the last up to `order` characters that end at each place, less the last `skip` of them."""
    keys = np.zeros(len(codes), dtype=np.uint64)
    for j in range(skip, order):
        there = before >= j
        keys[there] += (codes[np.flatnonzero(there) - j] + np.uint64(1)) * FACTORS[j]
    return keys ^ (keys >> np.uint64(29))


def _table_keys(ctx: list[str], ch: list[str]) -> np.ndarray:
    """The same numbers for contexts and letters; an empty letter leaves its place out."""
    whole = np.array([c + (x or "$") for c, x in zip(ctx, ch, strict=True)], dtype=f"<U{ORDER}")
    codes = whole.view("<u4").reshape(len(whole), ORDER).astype(np.uint64)
    sizes, given = np.char.str_len(whole), np.array([bool(x) for x in ch], dtype=bool)
    keys = np.zeros(len(whole), dtype=np.uint64)
    for j in range(ORDER):
        rows = np.flatnonzero((sizes > j) & (given | (j > 0)))
        keys[rows] += (codes[rows, sizes[rows] - 1 - j] + np.uint64(1)) * FACTORS[j]
    return keys ^ (keys >> np.uint64(29))


def numbered(table: DataFrame) -> DataFrame:
    """(letter, key, llr): the entries of an evidence table, by number."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ch = b["ch"].tolist()
            yield pd.DataFrame({"letter": [bool(x) for x in ch], "key": _table_keys(b["ctx"].tolist(), ch).view(np.int64), "llr": b["llr"].astype("float32")})

    return table.select("ctx", "ch", "llr").mapInPandas(keyed, "letter boolean, key long, llr float")


class Scorer:
    """Evidence of texts by ordered arrays of keys, with a bounded memory of pieces already judged."""

    def __init__(self, letters: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], order: int = ORDER, margin: float = MARGIN, limit: int = 150_000):
        self.letters, self.contexts, self.order, self.margin, self.limit = letters, contexts, order, margin, limit
        self.known: dict[str, complex] = {}

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ordered, values = table
        if not len(ordered):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
        return ordered[at] == keys, values[at]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Toxic less ordinary log-likelihood of each word, and its number of letters with the end mark."""
        codes, before = _codes(words)
        hit, llr = self._find(self.letters, _gram_keys(codes, before, self.order))
        known, weight = self._find(self.contexts, _gram_keys(codes, before, self.order, skip=1))
        llr = np.where(hit, llr, np.where(known, weight, 0.0)).astype(np.float64)
        llr[before == 0] = 0.0  # the mark of the start is given
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        return np.add.reduceat(llr, np.cumsum(sizes) - sizes) if words else np.zeros(0), sizes - 1

    def _judge(self, pieces: list[str], chunk: int = 20_000) -> dict[str, complex]:
        """By piece: what its expressions exceed the margin by, and as the imaginary part their letters."""
        found = {}
        for first in range(0, len(pieces), chunk):
            part = pieces[first : first + chunk]
            words = [LETTERS.findall(p) for p in part]
            llr, letters = self.words([w for own in words for w in own])
            both = np.maximum(0.0, llr - self.margin * letters) + 1j * letters
            sums = np.concatenate((np.zeros(1, complex), np.cumsum(both)))
            ends = np.cumsum([len(own) for own in words])
            found.update(zip(part, (sums[ends] - sums[ends - [len(own) for own in words]]).tolist(), strict=True))
        return found

    def texts(self, texts: Iterable[str | None], chars: int = 1_000_000) -> list[float]:
        """Each text's evidence; new pieces of about so many characters of texts are judged together."""
        out: list[float] = []
        group: list[list[str]] = []
        size = 0
        for t in texts:
            group.append((t or "").lower().split())
            size += len(t or "")
            if size >= chars:
                out += self._sums(group)
                group, size = [], 0
        return out + self._sums(group)

    def _sums(self, group: list[list[str]]) -> list[float]:
        known, new = self.known, self._judge(list(set().union(*group) - self.known.keys()))
        sums = [sum([known[p] if p in known else new[p] for p in pieces], 0j) for pieces in group]
        for p, v in new.items():
            if len(known) >= self.limit:
                break
            if len(p) <= LONGEST:
                known[p] = v
        return [s.real / s.imag if s.imag else 0.0 for s in sums]


def evidence(text: Column, model: Broadcast) -> Column:
    @F.arrow_udf("double")
    def judged(texts: pa.Array) -> pa.Array:
        m = model.value
        scorer = resident(("toxicity", m["token"]), lambda: Scorer(m["letters"], m["contexts"], m["order"], m["margin"]))
        return pa.array(scorer.texts(each(texts)), pa.float64())

    return judged(text)


def _curved(x: np.ndarray) -> np.ndarray:
    return np.log1p(1000 * x)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of y on one feature by Newton steps; the slope is never negative."""
    if not len(x) or y.min() == y.max():
        return 1.0, -math.log(1 / THRESHOLD - 1) - (float(x.max()) if len(x) and y.max() == 0 else 5.0)
    mean, sd = float(x.mean()), float(x.std()) or 1.0
    z, w = np.column_stack(((x - mean) / sd, np.ones(len(x)))), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([ridge * len(x) / 10, 1e-9]), z.T @ (y - p) - np.array([ridge * len(x) / 10 * w[0], 0]))
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    slope = max(float(w[0]) / sd, 0.0)
    return slope, float(w[1]) - slope * mean


def _ordered(rows, letter: bool) -> tuple[np.ndarray, np.ndarray]:
    chosen = rows.filter(rows["letter"] if letter else np.invert(rows["letter"].to_numpy(zero_copy_only=False)))
    keys, values = chosen["key"].to_numpy().view(np.uint64), chosen["llr"].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def fit(docs: DataFrame, labels: DataFrame, margin: float = MARGIN, discount: float = DISCOUNT, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> dict:
    """The model: a broadcast table, and the slope and intercept of the score.

    A quarter of the sampled rows, by a hash of the id, is kept from the counts to fit the curve.
    """
    with passing(docs.sparkSession):
        sample = materialize(labelled(docs, labels, "toxic", FOLDS, F.col("fold") != HELD_OUT, max_rows, max_chars), "toxic-sample")
        later = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(4)) == 0
        own = materialize(gram_counts(word_counts(sample.filter(~later))), "class-grams")
        words = materialize(word_counts(docs.select(F.lit(0).alias("y"), "text")), "words")
        rows = numbered(evidence_table(own, gram_counts(words).select("ctx", "ch", "n"), BACKOFF, discount)).toArrow()
        model = {"token": uuid.uuid4().hex, "order": ORDER, "margin": margin, "letters": _ordered(rows, True), "contexts": _ordered(rows, False)}
        del rows
        table = docs.sparkSession.sparkContext.broadcast(model)
        seen = sample.filter(later).select("y", evidence(F.col("text"), table).alias("x")).toPandas()  # bounded by max_rows
        slope, intercept = logistic(_curved(seen["x"].to_numpy(float)), seen["y"].to_numpy(float))
    return {"table": table, "slope": slope, "intercept": intercept}


def score_column(text: Column, model: dict) -> Column:
    """From 0 to 1, higher where a toxic text is likelier."""
    return 1 / (1 + F.exp(-(F.lit(model["slope"]) * F.log1p(1000 * evidence(text, model["table"])) + model["intercept"])))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Only texts are scored. Null and empty texts have no evidence and get the score of none. Repeated rows are
    scored alike; null ids stay and are in the fold of crc32(null), which is null: not held out. Without labels of
    both classes the curve is a fixed one and nothing is learned. Other columns of docs and labels are not read.
    """
    model = fit(docs, labels, **options)
    scored = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
