"""SimHash near-duplicate detection with pigeonhole blocks.

A text's fingerprint has bit b set if more than half of its word-shingle hashes have it set. Fingerprints that
differ in at most `radius` bits agree on `blocks - radius` whole blocks at least, so each distinct fingerprint is
keyed by every choice of that many blocks, joined on the keys, and each candidate is verified by its Hamming
distance. Copies of a text share one fingerprint and meet before any join.

Buckets of more than `bucket` fingerprints aren't paired. Two fingerprints within the radius have a common
midpoint at most radius // 2 flips from one and ceil(radius / 2) from the other, so each member of such a bucket is
keyed by the points that near to it; those under one key link to the least of those within radius // 2 of it. This is
linear in the bucket and keeps every component whole: both of a close pair link to the least one at their midpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, each, materialize, passing, sized_join, spread_join
from .components import connected_components
from .minhash import likeliest

SEED = 42
#: Fingerprints of a text's words, places of its bitmap of shingles, hashes whose least values are kept, and texts that
#: are compared at a time.
PRINTS, PLACES, HASHES, CHUNK = 3, 1024, 8, 128
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Candidates of each component that are listed and verified in each round, then all that are left.
ROUNDS = (1, 8, None)


def shingles(text: str, width: int) -> list[bytes]:
    """Word shingles with repeats of a text whose A-Z are lower-cased; the whole sequence if it is shorter."""
    words = text.encode().lower().split()  # bytes: lowers A-Z alone, splits at ASCII white space alone
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def _hashed(features: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(g, SEED) for g in features], dtype="<u8")


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several hashes that are made of one."""
    if k:
        hashes = (hashes ^ (hashes >> np.uint64(31))) * FACTORS[k]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * FACTORS[-k]
        hashes = hashes ^ (hashes >> np.uint64(32))
    return hashes


def _majority(hashes: np.ndarray) -> int:
    """The signed fingerprint of features with these hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for null and for texts without words."""
    return _majority(_hashed(shingles(text or "", width)))


def fingerprint_column(text: Column, width: int) -> Column:
    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, width) for t in each(texts)], pa.int64())

    return prints(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask of bits for every choice of blocks - radius of the blocks that 64 bits are split into."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(parts, blocks - radius)]


def _near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def hamming_links(prints: DataFrame, radius: int = 2, blocks: int = 4, bucket: int = 32) -> DataFrame:
    """Links (u, v) between distinct fingerprints at most radius bits apart, enough to keep components whole.

    prints: a column fp of distinct longs, written already (it is read several times).
    """
    if not 0 < radius <= 4 or blocks <= radius:
        raise ValueError("radius must be 1 to 4, and blocks more than the radius")
    masks = block_masks(radius, blocks)
    keys = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("b")).select("fp", "b.m", "b.k")
    shared = materialize(keys.groupBy("m", "k").agg(F.count("*").alias("n")).filter("n > 1"), "blocks")
    members = keys.join(shared.filter(F.col("n") <= bucket), ["m", "k"]).select("m", "k", "fp")
    other = members.withColumnRenamed("fp", "fq")
    paired = members.join(other, ["m", "k"]).filter("fp < fq").filter(_near("fp", "fq", radius)).select("fp", "fq")

    crowded = keys.join(shared.filter(F.col("n") > bucket).select("m", "k"), ["m", "k"], "left_semi").select("fp").distinct()
    near = radius // 2
    around = crowded.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), _flipped(n).alias("points")) for n in range(radius - near + 1)])).alias("by")).select("fp", "by.n", F.explode("by.points").alias("p"))
    hubs = around.groupBy("p").agg(F.min(F.when(F.col("n") <= near, F.col("fp"))).alias("fq"), F.count("*").alias("members")).filter("members > 1 and fq is not null").select("p", "fq")
    starred = around.join(hubs, "p").filter("fp <> fq").filter(_near("fp", "fq", radius)).select("fp", "fq")
    return paired.union(starred).select(F.col("fp").alias("u"), F.col("fq").alias("v")).distinct()


def _flipped(n: int, point: Column | None = None, first: Column | None = None) -> Column:
    """All points that differ from one in just n bits."""
    point = F.col("fp") if point is None else point
    if not n:
        return F.array(point)
    places = F.sequence(F.lit(0) if first is None else first, F.lit(64 - n))
    return F.flatten(F.transform(places, lambda i: _flipped(n - 1, point.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)), i + 1)))


def words_key(text: Column) -> Column:
    """A digest of a text's words in order, A-Z lower-cased; that of the empty string without any."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.md5(F.regexp_replace(F.regexp_replace(lower, f"{SPACE}+", " "), r"^ | \z", "").cast("binary"))


def sketch(text: str | None, width: int) -> tuple[list[int], int, bytes, list[int]]:
    """Of a text: the fingerprints of its distinct words by several hashes, the number of its distinct shingles, a
    bitmap of how many are odd at a place, and the least values of some hashes of them.

    Two bitmaps differ in at most as many places as the sets of shingles do in elements.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return [0] * PRINTS, 0, bytes(PLACES // 8), []
    distinct = list(set(words))
    hashes = _hashed(distinct)
    at = np.fromiter(map(dict(zip(distinct, range(len(distinct)), strict=True)).__getitem__, words), np.int64, len(words))
    last = max(1, len(words) - width + 1)
    grams = np.zeros(last, dtype=np.uint64)
    for i in range(min(width, len(words))):
        grams = (grams ^ (grams >> np.uint64(32))) * FACTORS[0] + hashes[at[i : i + last]]
    grams = np.unique(_mixed(grams, 1))
    odd = np.bincount((grams % PLACES).astype(np.int64), minlength=PLACES) & 1
    least = [int((grams * f).min().view(np.int64)) for f in FACTORS]
    return [_majority(_mixed(hashes, k)) for k in range(PRINTS)], len(grams), np.packbits(odd.astype(np.uint8)).tobytes(), least


def similarity(a: str | None, b: str | None, width: int) -> float:
    """Jaccard similarity of two texts' sets of word shingles; two texts without words are alike."""
    x, y = set(shingles(a or "", width)), set(shingles(b or "", width))
    return len(x & y) / len(x | y) if x or y else 1.0


def similar_links(links: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The links (u, v), written, whose texts are similar enough; texts: key and text. One text stands for a key."""

    @F.arrow_udf("double")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(x, y, width) for x, y in zip(each(a), each(b), strict=True)], pa.float64())

    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("key"), F.lit(1).alias("u")), F.struct(F.col("v").alias("key"), F.lit(0).alias("u")))).alias("e")).groupBy("e.key").agg(F.sum("e.u").alias("us"), F.sum(1 - F.col("e.u")).alias("vs"))
    own = materialize(sized_join(texts.select("key", "text"), materialize(ends, "ends"), "key").groupBy("key", "us", "vs").agg(F.min("text").alias("text")), "texts")
    first = materialize(spread_join(links, own.filter("us > 0").select(F.col("key").alias("u"), F.col("text").alias("a"), F.col("us").alias("n")), "u"), "first")
    both = spread_join(first, own.filter("vs > 0").select(F.col("key").alias("v"), F.col("text").alias("b"), F.col("vs").alias("n")), "v")
    return materialize(both.filter(similar("a", "b") >= least - 1e-12).select("u", "v"), "links")


def _any_near(a: str, b: str, radius: int) -> Column:
    """Whether two arrays of fingerprints have one at the same place within the radius."""
    return F.exists(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda p: F.bit_count(p["x"].bitwiseXOR(p["y"])) <= radius)


def hub_links(texts: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) from texts to the first of those that share a fingerprint or the least value of a hash.

    texts: fp (array), key and least. Linear in the texts; only fingerprints within the radius are linked.
    """
    marks = F.concat(F.transform("fp", lambda x, i: F.struct((-1 - i).alias("i"), x.alias("x"))), F.transform("least", lambda x, i: F.struct(i.alias("i"), x.alias("x"))))
    marked = texts.select("fp", "key", F.explode(marks).alias("m")).select("fp", "key", F.xxhash64("m.i", "m.x").alias("mark"))
    hubs = marked.groupBy("mark").agg(F.min(F.struct("key", "fp")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    hubs = materialize(hubs.select("mark", F.col("hub.key").alias("v"), F.col("hub.fp").alias("fq"), "n"), "hubs")
    return spread_join(marked, hubs, "mark").filter("key <> v").filter(_any_near("fp", "fq", radius)).select(F.col("key").alias("u"), "v").distinct()


def crossing_pairs(texts: DataFrame, guaranteed: int, blocks: int, radius: int, least: float, chunk: int = CHUNK, most: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """(m, k, u, v, differ, cu, cv): pairs of texts of different components cu and cv that may be similar enough, and how many
    places differ.

    texts: fp (array), key, component, n and bits, written already. Texts meet if one of their fingerprints agrees in
    blocks - guaranteed blocks, and fingerprints within the radius count. The members of a bucket are dealt to chunks of
    about `chunk` texts, and chunks are compared with chunks, so a large bucket is spread over tasks whatever its size. A
    pair comes from the first bucket it shares. It is left out only if its bitmaps show that the similarity is below `least`,
    or, where `most` is given, if it isn't among the `most` likeliest pairs of one of its components in these two chunks: a row
    without u and v then names the bucket. Only the buckets (m, k) of `only`, written, are looked into, if that is given.
    """
    masks = np.array(block_masks(guaranteed, blocks), dtype=np.int64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"m": [], "k": [], "u": [], "v": [], "differ": [], "cu": [], "cv": []}
            for r in range(len(batch)):  # only one pair of chunks is Python objects at a time
                m, k, same, *columns = (column[r].as_py() for column in batch.columns)
                (fa, ka, ca, na, ba), (fb, kb, cb, nb, bb) = columns[:5], columns[:5] if same else columns[5:]
                names = {c: i for i, c in enumerate({*ca, *cb})}
                pa_, pb = (np.array([names[c] for c in x]) for x in (ca, cb))
                apart = pa_[:, None] != pb
                i, j = np.nonzero(apart & (np.triu(np.ones(apart.shape, bool), 1) if same else True))
                if not len(i):
                    continue
                # x[p]: where the p-th fingerprints of the pairs differ.
                x = np.stack(fa).astype(np.int64).T[:, i] ^ np.stack(fb).astype(np.int64).T[:, j]
                met = np.bitwise_count(x.view(np.uint64)) <= radius
                new = met[m // len(masks)]
                for earlier in range(m):
                    p, mask = divmod(earlier, len(masks))
                    new &= ~(met[p] & ((x[p] & masks[mask]) == 0))
                i, j = i[new], j[new]
                if len(i):
                    bits = [np.frombuffer(b"".join(b), np.uint64).reshape(len(b), -1) for b in (ba, bb)]
                    differ = np.bitwise_count(bits[0][i] ^ bits[1][j]).sum(axis=1, dtype=np.int64)
                    both = np.asarray(na, np.int64)[i] + np.asarray(nb, np.int64)[j]
                    like = (both - differ) / 2 >= least / (1 + least) * both - 1e-6
                    i, j, differ = i[like], j[like], differ[like]
                    if most:
                        kept = likeliest(differ, pa_[i], pb[j], most)
                        cut = not kept.all()
                        i, j, differ = i[kept], j[kept], differ[kept]
                    else:
                        cut = False
                    none = [None] * cut
                    found["m"] += [m] * (len(i) + cut)
                    found["k"] += [k] * (len(i) + cut)
                    for name, values in (("u", [ka[t] for t in i]), ("v", [kb[t] for t in j]), ("differ", differ.tolist()), ("cu", [ca[t] for t in i]), ("cv", [cb[t] for t in j])):
                        found[name] += values + none
            kinds = {"m": pa.int32(), "k": pa.int64(), "differ": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in found.items()], list(found))

    choices = [F.struct(F.lit(p * len(masks) + i).alias("m"), F.get("fp", p).bitwiseAND(F.lit(int(mask))).alias("k")) for p in range(PRINTS) for i, mask in enumerate(masks)]
    keyed = texts.select("fp", "key", "component", "n", "bits", F.explode(F.array(*choices)).alias("b")).select("*", "b.m", "b.k").drop("b")
    if only is not None:
        keyed = sized_join(keyed, only, ["m", "k"], "left_semi")
    place = F.xxhash64("component")
    sizes = keyed.groupBy("m", "k").agg(F.count("*").alias("size"), F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo < hi")
    shared = materialize(sizes.select("m", "k", F.ceil(F.col("size") / chunk).cast("int").alias("parts")), "blocks")
    dealt = sized_join(keyed, shared, ["m", "k"]).withColumn("c", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    chunks = materialize(dealt.groupBy("m", "k", "parts", "c").agg(F.collect_list(F.struct("fp", "key", "component", "n", "bits")).alias("s")), "chunks")
    alone = chunks.filter("parts = 1").select("m", "k", F.lit(True).alias("same"), F.col("s").alias("a"), F.expr("slice(s, 1, 0)").alias("b"))
    left = chunks.filter("parts > 1").select("m", "k", "c", F.col("s").alias("a"), F.explode(F.sequence(F.col("c"), F.col("parts") - 1)).alias("d"))
    right = chunks.filter("parts > 1").select("m", "k", F.col("c").alias("d"), F.col("s").alias("b"))
    met = alone.union(left.join(right.hint("merge"), ["m", "k", "d"]).select("m", "k", (F.col("c") == F.col("d")).alias("same"), "a", F.when(F.col("c") == F.col("d"), F.expr("slice(b, 1, 0)")).otherwise(F.col("b")).alias("b")))
    fields = [F.col(f"{side}.{f}").alias(f"{side}_{f}") for side in "ab" for f in ("fp", "key", "component", "n", "bits")]
    return met.select("m", "k", "same", *fields).mapInArrow(compare, "m int, k long, u string, v string, differ long, cu string, cv string")


def keep_first(docs: DataFrame, guaranteed: int = 3, blocks: int = 5, radius: int = 8, verify_width: int = 5, least: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """docs with one row of each group of near duplicates: the one of the least id.

    Texts of the same words in the same order, A-Z lower-cased, are copies; so are all texts without words. A text has
    three fingerprints of its distinct words, which a changed word moves far less than those of shingles. Two texts are
    candidates if in any of these they share blocks - guaranteed of the blocks, which all within `guaranteed` bits do,
    and are within `radius` bits; they link if their `verify_width`-word shingles are similar enough. Texts are first
    linked to hubs, which joins most of a large group in linear time. Then the likeliest candidates of each component are
    listed and verified, a few more in each round, so that a group grows together before its pairs are listed; the last round
    takes all that still have their texts in different components. Later rounds look only into buckets of which pairs were
    left out. A row without an id stays only where its group has no id. Of repeated rows one
    stays. The columns are those of docs, whatever their names. docs is read several times and should be written.
    """

    @F.arrow_udf("struct<fp:array<long>,n:int,bits:binary,least:array<long>>")
    def prints(texts: pa.Array) -> pa.Array:
        columns = zip(*[sketch(t, verify_width) for t in each(texts)], strict=True) if len(texts) else [[]] * 4
        kinds = {"fp": pa.list_(pa.int64()), "n": pa.int32(), "bits": pa.binary(), "least": pa.list_(pa.int64())}
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    def renamed(placed: DataFrame, links: DataFrame) -> DataFrame:
        """placed after components that links (u, v) join have become one."""
        parts = materialize(connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("to")), "parts")
        joined = sized_join(placed, parts, "component", "left").withColumn("component", F.coalesce("to", "component"))
        return materialize(joined.select("first_id", "fp", "key", "component", "n", "bits"), "placed", keep=True)

    # Rows are read from docs again rather than written a second time; only what is small about them is.
    held = docs.select(F.struct(*docs.columns).alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), words_key(F.col("row.text")).alias("key"))
    with passing(docs.sparkSession):
        printed = materialize(held.select("doc_id", "key", prints(F.col("text")).alias("print")), "prints")
        texts = materialize(printed.groupBy("key").agg(F.min("doc_id").alias("first_id"), *[F.first(f"print.{c}").alias(c) for c in ("fp", "n", "bits", "least")]), "distinct")
        with passing(docs.sparkSession):  # the tables of a round go at its end, but for what the next one reads
            links = similar_links(materialize(hub_links(texts, radius), "near"), held, verify_width, least)
            placed = renamed(texts.withColumn("component", F.col("key")), links)
        only, tried = None, None
        for most in ROUNDS:
            with passing(docs.sparkSession):
                listed = materialize(crossing_pairs(placed, guaranteed, blocks, radius, least, chunk, most, only), "crossing")
                now = listed.filter("u is not null")
                if most:
                    sides = now.withColumn("c", F.explode(F.array("cu", "cv")))
                    now = sides.withColumn("rank", F.row_number().over(W.partitionBy("c").orderBy("differ", "u", "v"))).filter(F.col("rank") <= most)
                now = materialize(now.select("u", "v", "cu", "cv").distinct(), "likeliest", keep=True)
                only = materialize(listed.join(now, ["u", "v"], "left_anti").select("m", "k").distinct(), "left", keep=True)
                fresh = materialize(now.join(tried, ["u", "v"], "left_anti") if tried else now, "fresh")
                tried = tried.union(now.select("u", "v")) if tried else now.select("u", "v")
                if not fresh.isEmpty():
                    more = similar_links(fresh.select("u", "v"), held, verify_width, least)
                    if not more.isEmpty():
                        links = fresh.join(more, ["u", "v"]).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
                        placed = renamed(placed, links)
            if only.isEmpty():
                break
        names = placed.select("key", "component")
        final = texts.join(names.hint("merge"), "key")
        kept = final.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("k")).select(F.col("k.first_id").alias("kept_id"), F.col("k.key").alias("kept_key"))
        same = (F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
        chosen = materialize(kept.join(printed.groupBy("key", "doc_id").agg(F.count("*").alias("n")).hint("merge"), same).select("kept_id", "kept_key", "n"), "kept", keep=True)
    once = held.join(chosen.filter("n = 1").hint("merge"), same, "left_semi").select("row")
    twice = held.join(chosen.filter("n > 1").hint("merge"), same, "left_semi").groupBy("key", "doc_id").agg(F.min("row").alias("row")).select("row")
    return once.union(twice).select("row.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """doc_id, fp (signed fingerprint), fingerprint (16 hex digits) and component_id for every row of docs.

    component_id is the least id that is reachable over links of at most radius bits, the row's own included.
    Null and empty texts have fingerprint zero and are linked like any other. Null ids stay as rows and never
    name a component unless all ids of it are null. Repeated rows stay repeated. Other columns of docs are not read.
    """
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), width).alias("fp")), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    parts = connected_components(hamming_links(distinct.select("fp"), radius, blocks)).withColumnRenamed("node", "fp")
    placed = materialize(distinct.join(parts.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed")
    # A component's least id, without gathering its fingerprints: one partial aggregate, joined back on the label.
    least = materialize(placed.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "least")
    named = materialize(spread_join(placed.withColumnRenamed("n", "rows"), least, "component").select("fp", "component_id", F.col("rows").alias("n")), "named")
    return spread_join(prints, named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
