"""Spelling variants: words within one edit of each other, found by bands of letter-parity masks.

A word's mask has a bit for each letter (letters share bits where there are more of them) that is set if the word holds
the letter an odd number of times. An inserted or deleted letter flips one bit, a replaced one two or none. The mask is
split into three bands, so near words agree in a whole band; words are joined on an equal band and on lengths that
differ by one at most, and verified by their edit distance in code points.

A band alone has few values, so a large vocabulary would crowd them; but an edit leaves the first or the last half of the
shorter word's letters as they are. So the key of an equal band is split by that half: each word is keyed by each of its
bands with its first half and with its last half, which finds the same pairs by keys of few words.

All of it is DataFrame functions; only words, never their occurrences, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, materialize, sized_join, spread_join

#: Letters of a run; A-Z are lower-cased, letters beyond them stay as they are.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Letters by frequency: dealt to the bands in turn, so that each band has as many frequent ones.
FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"
BANDS, BITS = 3, 18


def _bit_of(code: int) -> int:
    """The bit of a code point: letters a-z get the first places of the bands, others share the remaining ones."""
    place = FREQUENT.find(chr(code)) if code < 128 else len(FREQUENT) + code % (BANDS * BITS - len(FREQUENT))
    return 0 if place < 0 else place % BANDS * BITS + place // BANDS


def parity_mask(word: Column) -> Column:
    """The letters that a word has an odd number of times, as bits of a long."""
    bits = F.array(*[F.lit(1 << _bit_of(c)).cast("long") for c in range(256)])
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: F.when(c == "", mask).otherwise(mask.bitwiseXOR(F.get(bits, F.ascii(c)))))


def band(mask: Column, i: int) -> Column:
    return F.shiftright(mask, i * BITS).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


def misspelt_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, every: int = 31) -> DataFrame:
    """(word, n): the distinct results of a text's runs of at least `least_length` code points, and how often each occurs.

    If `every` divides the unsigned crc32 h of `<id>:<run>`, the run loses its code point h % length, counted from 0. A
    null id counts as an empty one and a null text has no runs. Occurrences are counted in each task before words are shuffled.
    """
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", "run", F.char_length("run").alias("len")).filter(F.col("len") >= least_length)
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    hashed = runs.select("run", "len", h.alias("h"))
    at = (F.col("h") % F.col("len")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("len")))
    words = hashed.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def _keys(length: Column) -> Column:
    """tag and k of a word for each band and each half, by the length of the shorter word of a pair."""
    half = F.floor(length / 2).cast("int")
    halves = (F.left("word", half), F.right("word", half))
    tagged = [(2 * i + e, band(F.col("mask"), i), ends) for i in range(BANDS) for e, ends in enumerate(halves)]
    return F.array(*[F.struct(F.lit(tag).alias("tag"), F.xxhash64(F.lit(tag), own, length, ends).alias("k")) for tag, own, ends in tagged])


def _one_edit() -> Column:
    """Whether words a and b are one edit apart and their key is the first that they share."""
    apart, half = F.col("a_mask").bitwiseXOR(F.col("b_mask")), F.floor(F.char_length("a") / 2).cast("int")
    first = F.lit(True)
    for i in range(BANDS):
        first = first & ((F.col("tag") < 2 * i + 2) | (band(apart, i) != 0))
    first = first & ((F.col("tag") % 2 == 0) | (F.left("a", half) != F.left("b", half)))
    ordered = (F.char_length("a") != F.char_length("b")) | (F.col("a") < F.col("b"))
    return (F.bit_count(apart) <= 2) & ordered & first & (F.levenshtein("a", "b", 1) == 1)


def near_words(words: DataFrame, per: int = 2_000) -> DataFrame:
    """(a, a_n, b, b_n): each two words that one inserted, deleted or replaced code point makes equal, once.

    words: distinct words and a count n of each, which is handed on. b is the longer word, or the later of two equally
    long ones. Words of a frequent key are dealt to parts of about `per`.
    """
    masked = materialize(words.select("word", "n", F.char_length("word").alias("len"), parity_mask(F.col("word")).alias("mask")), "masks")
    a = masked.select(F.explode(_keys(F.col("len"))).alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"))
    b = masked.select(F.explode(F.concat(_keys(F.col("len")), _keys(F.col("len") - 1))).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"))
    joined = dealt_join(a.select("key.*", "a", "a_n", "a_mask"), b.select("key.k", "b", "b_n", "b_mask"), ["k"], per)
    return joined.filter(_one_edit()).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where a word's form, the form's form and so on end. forms: word and form, none of them null; no cycles.

    Each round looks up how far the word that has been reached has got itself, so a chain takes the logarithm of its length.
    """
    reached = materialize(forms.select("word", F.col("form").alias("root")), "reached")
    while True:
        targets = reached.groupBy("root").agg(F.count("*").alias("n")).join(reached.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge"), "root", "left")
        steps = materialize(targets.select("root", "n", F.coalesce("next", "root").alias("next"), F.col("next").isNotNull().alias("on")), "steps")
        if steps.filter("on").isEmpty():
            return reached
        reached = materialize(spread_join(reached, steps.drop("on"), "root").select("word", F.col("next").alias("root")), "reached")


def variants(words: DataFrame, times: int = 10, per: int = 2_000) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word; words: distinct words and their counts n.

    form: the near word of the largest n, of equal ones the first in code-point order, if its n is at least `times` that
    of the word; else null, as is form_n. root: where forms of forms end, the word itself if it has none. n_near: near
    words of any count. An empty table gives an empty one.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = near_words(words, per)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(pairs.select("b", "a", "a_n"))
    near = materialize(both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")), "near")
    fits = -F.col("best.minus") >= times * F.col("n")
    placed = materialize(words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")), "placed")
    ends = roots(placed.filter("form is not null"))
    return sized_join(placed, ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31, times: int = 10, per: int = 2_000) -> DataFrame:
    """variants() of the words of all texts that occur at least `least_count` times; see misspelt_runs."""
    return variants(misspelt_runs(docs, least_length=least_length, every=every).filter(F.col("n") >= least_count), times, per)
