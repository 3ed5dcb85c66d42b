"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose candidate spans. Labelers vote on each: its pattern's own checks, its shape, a gazetteer of
endings, calling codes and issuers, the words before it, and the characters around it. Expectation-maximisation
over the counts of vote patterns (at most 3^5 by 4 kinds, aggregated before they are shuffled) estimates how
reliable each labeler is. The posteriors train a naive Bayes classifier of spans by kind, votes, number of digits and
separators. Spans that pass their pattern's checks always stay; the classifier adds others that overlap none. A failed check
(an address part above 255, a wrong Luhn sum, too few digits) is proof: such spans are the false ones to learn from
and are never added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that Java matches each in time linear in the text. A match
#: starts where a run does, or where the last match ended; possessive parts are followed by what they can't hold.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: 13 to 19 digits; of the contract's maximal matches those with fewer or more can't pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.)-])(?<![0-9][\x20])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])"
#: Gazetteers and context words: fixed values.
ENDINGS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "eu", "io", "info")
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CONTEXT = r"(?i)\b(?:mail|email|e-mail|contact|kontakt|contacto|courriel|correo|tel|tél|phone|telefon|teléfono|téléphone|call|fax|mobile|card|karte|carte|tarjeta|visa|ip|host|server|address|adresse|dirección)\b[^A-Za-z0-9]{0,12}\z"
AGAINST = r"(?i)(?:\b(?:version|id|ref|isbn|order|token|hash|key|secret)\b[^A-Za-z0-9]{0,6}|[=#/_][\"']?)\z"
LABELERS, ROUNDS, LEAST = 5, 25, 0.9
DIGITS, SEPARATORS, SIDES = 21, 5, 3


def _with(value: Column, use) -> Column:
    """use(value), computed once: an expression within a lambda is evaluated for every element, this one is an element."""
    return F.get(F.transform(F.array(value), use), 0)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _matches(text: Column, pattern: str, present: Column) -> Column:
    """array<struct<start, end, m, before, after>> of a pattern's matches, in code points.

    The pieces between the matches give the places: the sum of all before, in blocks of about the square root of their
    number, so that no match adds up more than two short runs. A text without what `present` looks for is not searched.
    """
    kind = "array<struct<start:int,end:int,m:string,before:string,after:string>>"

    def blocks(once: Column) -> Column:
        sizes = F.transform(once["hits"], lambda m, i: F.length(m) + F.length(F.get(once["gaps"], i)))
        return F.struct(once["gaps"].alias("gaps"), once["hits"].alias("hits"), sizes.alias("sizes"), F.ceil(F.sqrt(F.size(sizes) + 1)).cast("int").alias("b"))

    def sums(x: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.floor(F.size(x["sizes"]) / x["b"]).cast("int")), lambda k: _sum(F.slice(x["sizes"], k * x["b"] + 1, x["b"])))
        return F.struct(*[x[c].alias(c) for c in ("gaps", "hits", "sizes", "b")], own.alias("own"))

    def before(x: Column) -> Column:
        ahead = F.transform(x["own"], lambda _, k: _sum(F.slice(x["own"], F.lit(1), k)))
        return F.struct(*[x[c].alias(c) for c in ("gaps", "hits", "sizes", "b")], ahead.alias("ahead"))

    def spans(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            k = F.floor(i / x["b"]).cast("int")
            start = F.get(x["ahead"], k) + _sum(F.slice(x["sizes"], k * x["b"] + 1, i % x["b"])) + F.length(F.get(x["gaps"], i))
            return _with(start, lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("m"), F.right(F.get(x["gaps"], i), F.lit(30)).alias("before"), F.left(F.get(x["gaps"], i + 1), F.lit(1)).alias("after")))

        return F.transform(x["hits"], one)

    split = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("hits"))
    return F.when(present, _with(_with(_with(_with(split, blocks), sums), before), spans)).otherwise(F.array().cast(kind))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _part(n: int) -> str:
    return r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?|(?<=0))" + (r"\." if n < 3 else "")


IP_PARTS = "^" + "".join(map(_part, range(4))) + r"\z"


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return (v if no is None else v.when(no, -1)).otherwise(0)


def _described(kind: int, found: Column, strict, check, gazetteer, shape) -> Column:
    """The candidates of a kind with their votes and features; strict, check, gazetteer and shape are made of the match."""

    def one(x: Column) -> Column:
        m, before, after = x["m"], x["before"], x["after"]
        seps = F.translate(m, "0123456789", "")
        votes = (
            check(m),
            _vote(shape(m)),
            _vote(gazetteer(m), ~gazetteer(m)),
            _vote(before.rlike(CONTEXT), before.rlike(AGAINST)),
            _vote(~before.rlike(r"[A-Za-z0-9]\z") & ~after.rlike("[A-Za-z0-9]"), before.rlike(r"[A-Za-z0-9]\z") | after.rlike("[A-Za-z0-9]")),
        )
        style = F.when(seps == "", 0).when(seps.rlike(r"^\x20+\z"), 1).when(seps.rlike(r"^-+\z"), 2).when(seps.rlike(r"^\.+\z"), 3).otherwise(4)
        side = F.when(before == "", 0).when(before.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(2)
        return F.struct(
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            strict(m).alias("strict"),
            F.array(*votes).alias("votes"),
            F.least(F.length(_digits(m)), F.lit(DIGITS - 1)).alias("digits"),
            style.alias("style"),
            side.alias("side"),
        )

    return F.transform(found, one)


def candidates(text: Column) -> Column:
    """All candidate spans of a text; those with `strict` are the ones that pass their pattern's checks."""
    t = F.coalesce(text, F.lit(""))
    number = t.rlike("[0-9]")
    no, unchecked = lambda m: F.lit(False), lambda m: F.lit(0)
    sixteen = lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    return F.concat(
        _described(0, _matches(t, EMAIL, F.instr(t, "@") > 0), lambda m: F.lit(True), lambda m: F.lit(1), lambda m: F.lower(F.substring_index(m, ".", -1)).isin(*ENDINGS), lambda m: m.rlike(r"^[A-Za-z]")),
        _described(0, _matches(t, LOOSE_EMAIL, t.rlike(r"[\[(]at[\])]")), no, unchecked, lambda m: F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)\z", 1)).isin(*ENDINGS), lambda m: m.rlike(r"^[A-Za-z]")),
        _described(1, _matches(t, IP, t.rlike(r"[0-9]\.[0-9]")), lambda m: m.rlike(IP_PARTS), lambda m: _vote(m.rlike(IP_PARTS), ~m.rlike(IP_PARTS)), lambda m: ~m.rlike(r"^0*(?:0|127|255)\."), lambda m: m.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}\z")),
        _described(2, _matches(t, CARD, number), sixteen, lambda m: _vote(luhn(_digits(m)), ~luhn(_digits(m))), lambda m: _digits(m).rlike(ISSUERS), lambda m: m.rlike(r"^(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})\z")),
        _described(3, _matches(t, PHONE, F.instr(t, "+") > 0), lambda m: F.length(_digits(m)).between(8, 15), lambda m: F.when(F.length(_digits(m)).between(8, 15), 1).otherwise(-1), lambda m: m.rlike(CALLING_CODES), lambda m: m.rlike(r"[\x20().-]")),
        _described(3, _matches(t, LOOSE_PHONE, number), no, unchecked, lambda m: ~m.rlike(r"^\(?[01]"), lambda m: m.rlike(r"^\([0-9]{3}\)[\x20][0-9]{3}-|^[0-9]{3}([.-])[0-9]{3}\1")),
    )


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[list[list[float]]]]:
    """Share of true spans, and for each labeler and class (false, true) the odds of votes -1, 0 and 1.

    patterns: (votes, n), one row per pattern of votes. Each round is one aggregate of the bounded table to one
    row; pseudo-counts say that labelers are right more often than not, so a corpus without any false candidates
    doesn't turn them around.
    """
    share, odds = 0.5, [[[0.6, 0.2, 0.2], [0.2, 0.2, 0.6]] for _ in range(LABELERS)]
    prior = [[4.0, 1.0, 1.0], [1.0, 1.0, 4.0]]
    for _ in range(rounds):
        p = posterior(F.col("votes"), share, odds)
        sums = [F.sum(F.col("n") * p).alias("true"), F.sum("n").alias("all")]
        sums += [F.sum(F.when(F.get("votes", j) == v, F.col("n") * (p if c else 1 - p)).otherwise(0.0)).alias(f"s{j}_{c}_{v + 1}") for j in range(LABELERS) for c in (0, 1) for v in (-1, 0, 1)]
        row = patterns.agg(*sums).first()
        if not row["all"]:
            break
        new = (row["true"] + 2) / (row["all"] + 4)
        fresh = [[[row[f"s{j}_{c}_{v}"] + prior[c][v] for v in range(3)] for c in (0, 1)] for j in range(LABELERS)]
        odds = [[[x / sum(side) for x in side] for side in labeler] for labeler in fresh]
        done, share = abs(new - share) < 1e-6, new
        if done:
            break
    return share, odds


def posterior(votes: Column, share: float, odds: list[list[list[float]]]) -> Column:
    logit = F.lit(math.log(share / (1 - share)))
    for j, (false, true) in enumerate(odds):
        logit = logit + F.get(F.array(*[F.lit(math.log(t / f)) for f, t in zip(false, true, strict=True)]), F.get(votes, j) + 1)
    return F.when(F.get(votes, 0) == -1, 0.0).otherwise(1 / (1 + F.exp(-logit)))


FEATURES = {"kind": len(KINDS), "digits": DIGITS, "style": SEPARATORS, "side": SIDES} | {f"vote{j}": 3 for j in range(LABELERS)}


def _feature(span: Column, name: str) -> Column:
    return F.get(span["votes"], int(name[4:])) + 1 if name.startswith("vote") else span[name]


def train(spans: DataFrame, share: float, odds: list[list[list[float]]]) -> dict:
    """Naive Bayes log odds of every feature's values, from the posteriors; spans: a column `span`, one row each."""
    p = posterior(F.col("span")["votes"], share, odds)
    table = spans.select(p.alias("p"), *[_feature(F.col("span"), f).alias(f) for f in FEATURES])
    sums = [F.sum(F.when(F.col(f) == v, w).otherwise(0.0)).alias(f"{f}_{v}_{c}") for f, n in FEATURES.items() for v in range(n) for c, w in ((1, F.col("p")), (0, 1 - F.col("p")))]
    row = table.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("true"), F.coalesce(F.sum(1 - F.col("p")), F.lit(0.0)).alias("false"), *sums).first()
    weights = {}
    for f, n in FEATURES.items():
        each = [((row[f"{f}_{v}_1"] or 0) + 0.5, (row[f"{f}_{v}_0"] or 0) + 0.5) for v in range(n)]
        t, u = sum(a for a, _ in each), sum(b for _, b in each)
        weights[f] = [math.log(a / t * u / b) for a, b in each]
    return {"prior": math.log((row["true"] + 1) / (row["false"] + 1)), "weights": weights}


def probability(span: Column, model: dict) -> Column:
    logit = F.lit(model["prior"])
    for f, values in model["weights"].items():
        logit = logit + F.get(F.array(*map(F.lit, values)), _feature(span, f))
    return 1 / (1 + F.exp(-logit))


def _listed(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end, ...) for every row of docs.

    base holds what passes its pattern's checks; spans adds candidates of at least `least` probability that
    overlap no span of base. Null texts are empty. Repeated rows stay repeated; an empty table gives an empty
    result. Only doc_id and text are read.
    """
    found = materialize(docs.select("doc_id", candidates(F.col("text")).alias("found")), "spans")
    spans = found.select(F.explode("found").alias("span"))
    patterns = materialize(spans.groupBy(F.col("span.votes").alias("votes")).agg(F.count("*").alias("n")), "votes")
    model = train(spans, *estimate(patterns))
    base = F.filter("found", lambda s: s["strict"])
    rows = found.withColumn("base", base)
    likely = F.filter("found", lambda s: ~s["strict"] & (F.get(s["votes"], 0) >= 0) & (probability(s, model) >= least))
    added = F.filter(likely, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "base", F.concat("base", added).alias("spans"))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans (kind:start:end) for every row of docs; see detect."""
    rows = detect(docs, least)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
