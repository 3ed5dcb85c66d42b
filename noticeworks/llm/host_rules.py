"""Host-level quality rules: shrunken failure rates of hosts decide over their documents.

Each document is measured by itself. Failures of each rule are summed by host, a beta prior is fitted to the middle of
the hosts' rates, each host's rate is shrunk towards it, and hosts whose rate lies far outside the prior are turned away:
their verdict is joined back. The prior comes from the median of the rates and the median distance from it, so that bad
hosts, up to nearly half of all, can't widen the prior that judges them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, spread_join

MEASURES = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long>"
SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of width words which occurs twice or more."""
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    last = len(ids) - width + 1
    keys = ids[:last]
    for i in range(1, width):
        if len(known) >= 1_500_000:  # products of three would overflow
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * len(known) + ids[i : i + last]
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for i in range(width):
        covered[i : i + last] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and repeated words; all 0 for null."""
    raw = (text or "").encode()
    words = raw.split()
    seen, repeated = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated += bool(line.strip())
        else:
            seen.add(line)
    blank = len(raw) - len(raw.translate(None, SPACES))
    return len(words), len(text or "") - blank, len(raw) - len(raw.translate(None, SYMBOLS)), repeated, repeated_words(words)


def measures(text: Column) -> Column:
    @F.pandas_udf(MEASURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")

    return measured(text)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What a document fails by, each judged by host on its own.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 10 * F.col("n_dup_lines") > F.col("n_words"),
}


#: Steps of a rate whose middle is looked for: at most so many rows are ordered, however many hosts there are.
STEPS = 10_000


def _middle(bins: DataFrame, name: str) -> DataFrame:
    """rule and the lower median of `bin`, of which there are `c` each."""
    of = W.partitionBy("rule")
    counted = bins.select("rule", "bin", F.sum("c").over(of.orderBy("bin")).alias("upto"), F.sum("c").over(of).alias("all"))
    return counted.filter(2 * F.col("upto") >= F.col("all")).groupBy("rule").agg(F.min("bin").alias(name))


def host_rates(judged: DataFrame, rules: Sequence[str], beyond: float = 3.0, times: float = 2.0, sure: float = 2.0, least: float = 0.01, strongest: float = 100.0) -> DataFrame:
    """host, n, and for each rule its posterior mean rate (rate_<rule>) and whether the host stands out by it (bad_<rule>).

    judged: host and a boolean column for each rule. A rule's beta prior has as its mean m the median of the hosts' own rates, in
    whole steps of 1 / 10,000, or `least` if that is more, and a spread s of 1.4826 times the median distance from that
    median: a + b = m (1 - m) / s^2 - 1, between 1 and `strongest` documents (also where s is 0 or there is one host). A
    host stands out if its shrunken rate, less `sure` standard deviations of its posterior, is more than `beyond` standard
    deviations of the prior above m, and more than `times` m: few documents prove nothing. Of two middle hosts the one with the
    lower rate counts. One row per host.
    """
    counted = judged.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(f"f_{r}") for r in rules])
    hosts = materialize(counted.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("f")) for r in rules])).alias("x")).select("host", "n", "x.*"), "hosts")
    bins = hosts.groupBy("rule", F.floor(F.col("f") * STEPS / F.col("n")).alias("bin")).agg(F.count("*").alias("c"))
    medians = _middle(bins, "median")
    apart = bins.join(F.broadcast(medians), "rule").groupBy("rule", F.abs(F.col("bin") - F.col("median")).alias("bin")).agg(F.sum("c").alias("c"))
    prior = medians.join(_middle(apart, "apart"), "rule")
    m, s = F.greatest(F.col("median") / STEPS, F.lit(least)), 1.4826 * F.col("apart") / STEPS
    strength = F.when(F.col("apart") > 0, F.least(F.greatest(m * (1 - m) / (s * s) - 1, F.lit(1.0)), F.lit(strongest))).otherwise(strongest)
    joined = hosts.join(F.broadcast(prior.select("rule", m.alias("m"), strength.alias("strength"))), "rule")
    judged_hosts = joined.withColumn("rate", (F.col("f") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength")))
    rate = F.col("rate")
    surely = rate - sure * F.sqrt(rate * (1 - rate) / (F.col("n") + F.col("strength") + 1))
    bad = (surely > F.col("m") + beyond * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("strength") + 1))) & (surely > times * F.col("m"))
    own = [F.max(F.when(F.col("rule") == r, x)).alias(f"{name}_{r}") for r in rules for name, x in (("rate", rate), ("bad", bad))]
    return judged_hosts.groupBy("host").agg(F.max("n").alias("n"), *own)


def judge(docs: DataFrame, beyond: float = 3.0, times: float = 2.0, host_col: str = "source") -> DataFrame:
    """doc_id, host, the five measures, base_failed, the host's rates and kept for every row of docs.

    kept: the row itself passes, and its host stands out by no rule; see host_rates. Null and empty texts have no words
    and fail. Rows without a host are judged together as one. Repeated rows count each time; an empty table gives an
    empty result. Other columns of docs are not read.
    """
    names = list(RULES)
    found = docs.select("doc_id", F.col(host_col).alias("host"), measures(F.col("text")).alias("f")).select("doc_id", "host", "f.*")
    rows = materialize(found.withColumn("base_failed", base_failed()), "measures")
    failed = rows.select("host", *[rule().alias(r) for r, rule in RULES.items()])
    rates = host_rates(failed, names, beyond, times)
    bad = F.lit(False)
    for r in names:
        bad = bad | F.col(f"bad_{r}")
    place = F.when(F.col("host").isNull(), "").otherwise(F.concat(F.lit("="), "host"))
    keyed = materialize(rates.select(place.alias("place"), "n", bad.alias("bad"), *[f"rate_{r}" for r in names]), "hosts")
    return spread_join(rows.withColumn("place", place), keyed, "place").withColumn("kept", ~F.col("base_failed") & ~F.col("bad")).drop("place", "bad")
