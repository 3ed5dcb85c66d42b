"""MinHash near-duplicate detection by a multi-index Hamming join over b-bit signatures.

A text's set holds its distinct word shingles as 64-bit hashes. Its signature has SLOTS slots of 16 bits, each taken from
the least shingle under another hash, so a slot of two texts is equal with the probability of their similarity. The slots
are split into CHUNKS chunks. Signatures that differ in at most 2 * CHUNKS - 1 slots have a chunk in which at most one
differs, so each signature is keyed by every chunk with each of its slots left out, and all of these pairs meet under a
key. Two texts of similarity 0.85 miss all keys with a probability of 2e-8; more similar ones less. Every link is
confirmed on the full sets.

Texts of the same set are one class, and only classes are compared. Under each key, classes are first linked to the
least one, of which each keeps its likeliest; this is linear, and settles most of a group of near copies whatever its size. Then
only keys that still hold several components are looked into: their members are dealt to chunks of bounded size that are
compared with each other within tasks, and pairs of different components come out only if neither their sizes, their signatures
nor their bitmaps rule the similarity out, each pair under the first key it shares. Each component's likeliest pairs are listed and
confirmed first, a few more in each round, so that a group of near copies grows together before its pairs are listed; the last
round takes all pairs of components that are still apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import each, few_join, materialize, passing, sized_join, spread_join
from .components import connected_components

SEED = 42
#: Slots of a signature, chunks of slots, bytes of a slot, and places of a set's bitmap.
CHUNKS, CHUNK_SLOTS, SLOT_BYTES, PLACES = 10, 5, 2, 1024
SLOTS = CHUNKS * CHUNK_SLOTS
#: A pair that differs in more slots isn't taken for a candidate: 0.85 similar ones do so once in 10**10 times.
MOST_APART = 26
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Candidates of each component that are listed and confirmed in each round, then all that are left.
ROUNDS = (1, 4, None)
#: A key's lowest bits tell its chunk and the slot left out.
INDEX = 63


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The ordered distinct hashes of a text's word shingles, A-Z lower-cased; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z alone, splits at ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    distinct = list(dict.fromkeys(words))
    at = np.fromiter(map(dict(zip(distinct, range(len(distinct)), strict=True)).__getitem__, words), np.int64, len(words))
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in distinct], np.uint64)
    last = max(1, len(words) - width + 1)
    grams = np.full(last, min(width, len(words)), np.uint64)
    for i in range(min(width, len(words))):
        grams = (grams ^ (grams >> np.uint64(32))) * FACTORS[0] + hashes[at[i : i + last]]
    grams = (grams ^ (grams >> np.uint64(31))) * FACTORS[1]
    return np.unique(grams ^ (grams >> np.uint64(29)))


def sketch(text: str | None, width: int) -> tuple[int, str | None, bytes, bytes]:
    """Of a text's set: its size, a digest (null for an empty one), the signature, and a bitmap of which places hold an
    odd number of hashes. Two bitmaps differ in at most as many places as the sets do in elements."""
    grams = shingle_set(text, width)
    if not len(grams):
        return 0, None, b"", b""
    slots = np.array([(grams * f).min() for f in FACTORS])
    odd = np.bincount((grams % np.uint64(PLACES)).astype(np.int64), minlength=PLACES) & 1
    return len(grams), hashlib.md5(grams.tobytes()).hexdigest(), slots.astype("<u2").tobytes(), np.packbits(odd.astype(np.uint8)).tobytes()


def sketches(text: Column, width: int) -> Column:
    @F.arrow_udf("struct<n:int,digest:string,sig:binary,bits:binary>")
    def sketched(texts: pa.Array) -> pa.Array:
        columns = zip(*[sketch(t, width) for t in each(texts)], strict=True) if len(texts) else [[]] * 4
        kinds = {"n": pa.int32(), "digest": pa.string(), "sig": pa.binary(), "bits": pa.binary()}
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    return sketched(text)


def chunk_keys(sig: Column) -> Column:
    """A key for every chunk of a signature and each of its slots left out."""
    wide = CHUNK_SLOTS * SLOT_BYTES
    keys = []
    for c in range(CHUNKS):
        for s in range(CHUNK_SLOTS):
            before = F.substring(sig, c * wide + 1, s * SLOT_BYTES)
            after = F.substring(sig, c * wide + (s + 1) * SLOT_BYTES + 1, wide - (s + 1) * SLOT_BYTES)
            n = c * CHUNK_SLOTS + s
            keys.append(F.xxhash64(F.lit(n), before, after).bitwiseAND(F.lit(~INDEX)).bitwiseOR(F.lit(n)))
    return F.array(*keys)


def _rows(values: list[bytes], kind: str | type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def first_shared(siga: list[bytes], sigb: list[bytes]) -> np.ndarray:
    """The place among chunk_keys of the first key that pairs of signatures share; -1 if they share none."""
    if not siga:
        return np.zeros(0, np.int64)
    unequal = (_rows(siga, "<u2") != _rows(sigb, "<u2")).reshape(-1, CHUNKS, CHUNK_SLOTS)
    shared = unequal.sum(axis=2) <= 1
    chunk = shared.argmax(axis=1)
    slot = unequal[np.arange(len(chunk)), chunk].argmax(axis=1)  # the only unequal one, or the first of five that may be left out
    return np.where(shared.any(axis=1), chunk * CHUNK_SLOTS + slot, -1)


def likeliest(differ: np.ndarray, pa_: np.ndarray, pb: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the `most` of least difference of one of their two components."""
    order = np.argsort(differ, kind="stable")
    ends = np.concatenate((pa_[order], pb[order]))
    at = np.tile(np.arange(len(order)), 2)
    by = np.lexsort((at, ends))
    first = np.flatnonzero(np.r_[True, ends[by][1:] != ends[by][:-1]]) if len(by) else np.zeros(0, np.int64)
    place = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
    kept = np.zeros(len(order), bool)
    kept[order[at[by[place < most]]]] = True
    return kept


def _apart(na: np.ndarray, siga: list[bytes], bitsa: list[bytes], nb: np.ndarray, sigb: list[bytes], bitsb: list[bytes], percent: int) -> np.ndarray:
    """How many bits of their bitmaps pairs of sets differ in; -1 if they can't or hardly can be similar enough."""
    if not len(na):
        return np.zeros(0, np.int64)
    slots = (_rows(siga, "<u2") != _rows(sigb, "<u2")).sum(axis=1)
    differ = np.bitwise_count(_rows(bitsa, np.uint64) ^ _rows(bitsb, np.uint64)).sum(axis=1, dtype=np.int64)
    return np.where((slots <= MOST_APART) & may_link(na, nb, differ, percent), differ, -1)


def may_link(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many elements may be `percent` similar.

    With i common elements of a + b, 100 * i >= percent * (a + b - i) means that (100 + percent) times the number of
    differing ones is at most (100 - percent) * (a + b).
    """
    least = np.maximum(differ, np.abs(na - nb))
    return (100 + percent) * least <= (100 - percent) * (na + nb)


def apart(a: str, b: str, percent: int) -> Column:
    """_apart of two struct columns with n, sig and bits."""

    @F.arrow_udf("long")
    def differing(na: pa.Array, sa: pa.Array, ba: pa.Array, nb: pa.Array, sb: pa.Array, bb: pa.Array) -> pa.Array:
        sizes = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (na, nb)]
        return pa.array(_apart(sizes[0], sa.to_pylist(), ba.to_pylist(), sizes[1], sb.to_pylist(), bb.to_pylist(), percent), pa.int64())

    return differing(*[F.col(f"{side}.{c}") for side in (a, b) for c in ("n", "sig", "bits")])


def confirmed(links: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (u, v), written, whose full sets are similar enough, written.

    classes: cid, at (digest of a text of the class) and copies; docs: at and text. Each class's set is made of its text once and
    sent along its links; classes with many links are dealt to parts.
    """

    @F.arrow_udf("binary")
    def full(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, width).tobytes() for t in each(texts)], pa.binary())

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(each(a, 64), each(b, 64), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            found.append(100 * common >= percent * (len(x) + len(y) - common))
        return pa.array(found, pa.bool_())

    sides = F.array(F.struct(F.col("u").alias("cid"), F.lit(1).alias("us")), F.struct(F.col("v").alias("cid"), F.lit(0).alias("us")))
    ends = materialize(links.select(F.explode(sides).alias("e")).groupBy("e.cid").agg(F.sum("e.us").alias("us"), F.sum(1 - F.col("e.us")).alias("vs")), "ends")
    wanted = materialize(sized_join(classes.select("cid", "at", F.col("copies").alias("n")), ends, "cid"), "wanted")
    texts = few_join(docs.select("at", "text"), wanted, "at").groupBy("cid", "us", "vs").agg(F.first("text").alias("text"))
    sets = materialize(texts.select("cid", "us", "vs", full("text").alias("s")), "sets")
    both = spread_join(links, sets.filter("us > 0").select(F.col("cid").alias("u"), F.col("s").alias("a"), F.col("us").alias("n")), "u")
    both = spread_join(both, sets.filter("vs > 0").select(F.col("cid").alias("v"), F.col("s").alias("b"), F.col("vs").alias("n")), "v")
    return materialize(both.filter(similar("a", "b")).select("u", "v"), "links")


def shared_keys(sketched: DataFrame) -> DataFrame:
    """(k, cid, hub), written: the classes under each key that several classes have, with the least of them. sketched: cid and s."""
    keyed = sketched.select("cid", F.explode(chunk_keys(F.col("s.sig"))).alias("k"))
    hubs = keyed.groupBy("k").agg(F.min("cid").alias("hub"), F.max("cid").alias("last"), F.count("*").alias("n")).filter("hub < last")
    return materialize(few_join(keyed, materialize(hubs.select("k", "hub", "n"), "hubs"), "k").select("k", "cid", "hub"), "members")


def likeliest_hubs(members: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """(u, v): for each class the likeliest of the least classes under its keys. members: see shared_keys; sketched: cid and s."""
    met = materialize(members.filter("cid <> hub").select(F.col("cid").alias("u"), F.col("hub").alias("v")).distinct(), "met")
    counts = materialize(met.groupBy("v").agg(F.count("*").alias("n")), "counts")
    hub = sized_join(sketched.select(F.col("cid").alias("v"), F.col("s").alias("b")), counts, "v")
    both = spread_join(met, hub, "v").join(sketched.select(F.col("cid").alias("u"), F.col("s").alias("a")).hint("merge"), "u")
    near = both.select("u", "v", apart("a", "b", percent).alias("differ")).filter("differ >= 0")
    return near.groupBy("u").agg(F.min(F.struct("differ", "v")).alias("best")).select("u", F.col("best.v").alias("v"))


def mixed_members(members: DataFrame, placed: DataFrame, chunk: int) -> DataFrame:
    """k, parts, cid, component, written: the members of keys that hold several components, and how many chunks they make.

    members: k and cid; placed: cid and component, written.
    """
    keyed = members.select("k", "cid").join(placed.select("cid", "component").hint("merge"), "cid")
    mixed = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    mixed = materialize(mixed.select("k", "n", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), "mixed")
    return materialize(few_join(keyed, mixed, "k").select("k", "parts", "cid", "component"), "mixed")


def crossing_pairs(mixed: DataFrame, placed: DataFrame, percent: int, most: int | None) -> DataFrame:
    """(u, v, differ, cu, cv): pairs of classes of different components that share a key and may be similar enough, each once.

    mixed: see mixed_members; placed: cid, component and s, written. Members of a key are dealt to its chunks, which are compared
    pairwise; of each two chunks come only the `most` likeliest pairs of each component, if that is given.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in range(len(batch)):  # only one pair of chunks is Python objects at a time
                k, same, ca, pa_, na, sa, ba, cb, pb, nb, sb, bb = (column[r].as_py() for column in batch.columns)
                if same:
                    cb, pb, nb, sb, bb = ca, pa_, na, sa, ba
                ca, cb, pa_, pb, na, nb = (np.asarray(x, np.int64) for x in (ca, cb, pa_, pb, na, nb))
                far = pa_[:, None] != pb[None]
                if same:
                    far &= np.triu(np.ones(far.shape, bool), 1)
                i, j = np.nonzero(far & may_link(na[:, None], nb[None], 0, percent))
                here = first_shared([sa[x] for x in i], [sb[x] for x in j]) == (k & INDEX)
                i, j = i[here], j[here]
                differ = _apart(na[i], [sa[x] for x in i], [ba[x] for x in i], nb[j], [sb[x] for x in j], [bb[x] for x in j], percent)
                near = differ >= 0
                i, j, differ = i[near], j[near], differ[near]
                if most:
                    near = likeliest(differ, pa_[i], pb[j], most)
                    i, j, differ = i[near], j[near], differ[near]
                u, v, cu, cv = ca[i], cb[j], pa_[i], pb[j]
                found.append(np.stack([np.minimum(u, v), np.maximum(u, v), differ, np.where(u < v, cu, cv), np.where(u < v, cv, cu)]))
            columns = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "differ", "cu", "cv"])

    dealt = mixed.select("k", "parts", "cid", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("c")).join(placed.select("cid", "component", "s").hint("merge"), "cid")
    chunks = materialize(dealt.groupBy("k", "parts", "c").agg(F.collect_list(F.struct("cid", "component", "s")).alias("m")), "chunks")
    alone = chunks.filter("parts = 1").select("k", F.lit(True).alias("same"), F.col("m").alias("a"), F.expr("slice(m, 1, 0)").alias("b"))
    left = chunks.filter("parts > 1").select("k", "c", F.col("m").alias("a"), F.explode(F.sequence(F.col("c"), F.col("parts") - 1)).alias("d"))
    right = chunks.filter("parts > 1").select("k", F.col("c").alias("d"), F.col("m").alias("b"))
    met = left.join(right.hint("merge"), ["k", "d"]).select("k", (F.col("c") == F.col("d")).alias("same"), "a", F.when(F.col("c") == F.col("d"), F.expr("slice(b, 1, 0)")).otherwise(F.col("b")).alias("b"))
    fields = [F.col(f"{side}.{f}").alias(f"{side}_{f.rpartition('.')[2]}") for side in "ab" for f in ("cid", "component", "s.n", "s.sig", "s.bits")]
    return alone.union(met).select("k", "same", *fields).mapInArrow(compare, "u long, v long, differ long, cu long, cv long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85, chunk: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Texts link if 100 * common shingles >= percent * shingles of either. component_id is the least id that is reachable
    over links, the row's own included; kept tells whether it is the row's own. A text without words, null or empty, has no
    shingles and no link: it is its own component. Null ids stay as rows and never name a component unless all ids of it are
    null; they aren't kept, but rows without id and words are. Repeated rows stay repeated, and each of them is kept
    or none. An empty table gives an empty one. Other columns of docs are not read. docs is read more than once.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    located = held.withColumn("at", F.md5(F.col("text").cast("binary")))
    sketched = materialize(located.select("doc_id", "at", sketches(F.col("text"), width).alias("s")).select("doc_id", "at", "s.digest", F.col("s.n").alias("n"), F.struct("s.n", "s.sig", "s.bits").alias("s")), "sketches")
    with passing(docs.sparkSession):
        classes = sketched.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("at").alias("at"), F.count("*").alias("copies"), F.first("s").alias("s"))
        classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        small = classes.select("cid", "s")
        members = shared_keys(small)
        links = confirmed(materialize(likeliest_hubs(members, small, percent), "near"), classes, located, width, percent)

        def renamed(names: DataFrame, links: DataFrame) -> DataFrame:
            """names after components that links (u, v) join have become one."""
            parts = materialize(connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("to")), "parts")
            return materialize(sized_join(names, parts, "component", "left").select("cid", F.coalesce("to", "component").alias("component")), "named")

        names, left, tried = renamed(classes.select("cid", F.col("cid").alias("component")), links), members, None
        for most in ROUNDS:
            placed = materialize(names.join(small.hint("merge"), "cid"), "placed")
            left = mixed_members(left, placed, chunk)  # keys that hold one component go on doing so
            pairs = materialize(crossing_pairs(left, placed, percent, most), "crossing")
            if pairs.isEmpty():
                break
            if most:
                of = W.partitionBy("c").orderBy("differ", "u", "v")
                sides = pairs.withColumn("c", F.explode(F.array("cu", "cv")))
                pairs = sides.withColumn("place", F.row_number().over(of)).filter(F.col("place") <= most)
            now = pairs.select("u", "v", "cu", "cv").distinct()
            now = materialize(now.join(tried, ["u", "v"], "left_anti") if tried else now, "now")
            tried = tried.union(now.select("u", "v")) if tried else now.select("u", "v")
            if now.isEmpty():
                continue
            more = confirmed(now.select("u", "v"), classes, located, width, percent)
            if not more.isEmpty():
                names = renamed(names, materialize(now.join(more, ["u", "v"]).select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "links"))
        placed = materialize(classes.join(names.hint("merge"), "cid").select("digest", "first_id", "copies", "component"), "placed")
        least = materialize(placed.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "least")
        named_classes = materialize(spread_join(placed, least, "component").select("digest", "component_id", F.col("copies").alias("n")), "components", keep=True)
    own = sketched.filter("digest is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = spread_join(sketched.filter("digest is not null").select("doc_id", "digest", F.col("n").alias("shingles")), named_classes, "digest")
    return own.union(linked.select("doc_id", F.col("shingles").cast("long"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
