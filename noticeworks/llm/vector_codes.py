"""Product codes of vectors, with codebooks learned by Yinyang Lloyd rounds.

A vector is cut into equal consecutive parts, and each part position has a codebook. The entries of a codebook are
clustered into groups once. For each part of a vector the state of a round keeps its entry and one lower bound a group:
no entry of that group, its own left out, is nearer. After the codebook has moved, a bound falls by the largest drift
of its group's entries, and only groups whose bound is no longer above the exact distance to the part's own entry are
scanned. Distances are exact integers and ties go to the lower index; the bounds are rounded down, so that they only
ever cause a scan more. The codes are therefore those of Lloyd's rounds without any bound.

The state is a table with a row for each vector, written to the shared folder once a round, after which the one before
is deleted. What a round gathers is a sum for each part, entry and place, first added up within each task; it and the
codebooks are the only things that pass through the driver, parts x entries x part length integers at any input size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, scratch_path, spread_join

#: Entries of a codebook for each group, and Lloyd rounds over a codebook's entries that make the groups.
PER_GROUP, GROUPING_ROUNDS = 16, 5
#: Relative error that rounding a square root, a drift or a difference of them may have, with room to spare.
SLACK = 1e-9


def integer_parts(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null, or a component isn't finite."""
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def grouped(book: np.ndarray) -> np.ndarray:
    """The group of each entry of a codebook: a few Lloyd rounds over the entries, from evenly spaced ones."""
    n = max(1, len(book) // PER_GROUP)
    points, centers = book.astype(float), book[np.arange(n) * len(book) // n].astype(float)
    for _ in range(GROUPING_ROUNDS):
        nearest = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(nearest):
            centers[g] = points[nearest == g].mean(axis=0)
    return nearest


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries: in floats while all sums stay below 2**53, else in longs."""
    largest = int(max(np.abs(x, dtype=np.int64).max(initial=0), np.abs(book).max(initial=0)))
    bound = x.shape[1] * (2 * largest) ** 2
    if bound >= 1 << 63:
        raise OverflowError(f"squared distances of components up to {largest} don't fit into a long")
    x, book = (v.astype(np.float64 if bound < 1 << 53 else np.int64) for v in (x, book))
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)).astype(np.int64)


def reassign(x: np.ndarray, book: np.ndarray, groups: np.ndarray, own: np.ndarray | None, bounds: np.ndarray | None, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, its squared distance, the new lower bounds and how many distances were computed.

    own, bounds: of the round before, None in the first one; drift: how far each entry has moved since.
    """
    rows, n = np.arange(len(x)), int(groups.max(initial=0)) + 1
    if own is None:
        at, least = np.full(len(x), -1), np.full(len(x), np.iinfo(np.int64).max)
        low, fails = np.zeros((len(x), n)), np.ones((len(x), n), bool)
    else:
        at = own.astype(np.int64)
        apart = x.astype(np.int64) - book[at]
        least = (apart * apart).sum(axis=1)
        moved = np.array([drift[groups == g].max(initial=0) for g in range(n)]) * (1 + SLACK)
        low = bounds - moved - SLACK
        fails = low <= (np.sqrt(least) * (1 + SLACK))[:, None]
    was, before, scanned, computed = at.copy(), least.copy(), [], 0
    for g in range(n):
        of = np.flatnonzero(fails[:, g])
        entries = np.flatnonzero(groups == g)
        if not len(of) or not len(entries):
            continue
        d = squared(x[of], book[entries])
        computed += d.size
        place = d.argmin(axis=1)
        first, best = d[np.arange(len(of)), place], entries[place]
        d[np.arange(len(of)), place] = np.iinfo(np.int64).max
        scanned.append((g, of, best, first, d.min(axis=1)))
        better = (first < least[of]) | (first == least[of]) & ((best < at[of]) | (at[of] < 0))
        at[of[better]], least[of[better]] = best[better], first[better]
    for g, of, best, first, second in scanned:
        low[of, g] = np.sqrt(np.where(at[of] == best, second, first))
    left = rows[(at != was) & (was >= 0)]
    low[left, groups[was[left]]] = np.minimum(low[left, groups[was[left]]], np.sqrt(before[left]))
    return at, least, np.nextafter((low * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), computed


def _matrix(lists: pa.Array, kind: str) -> np.ndarray:
    """A list column whose lists are equally long as rows of numbers."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(lists), -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def assign(state: DataFrame, books: np.ndarray, groups: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The state after one round: id, label, c, own, low and error; the first one has only id, label and c."""
    first, parts = "own" not in state.columns, len(books)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["c"], "int64").reshape(len(batch), parts, -1)
            own, low = (None, None) if first else (_matrix(batch["own"], "int64"), _matrix(batch["low"], "float64").reshape(len(batch), parts, -1))
            found = [reassign(x[:, p], books[p], groups[p], None if first else own[:, p], None if first else low[:, p, : groups[p].max(initial=0) + 1], drift[p]) for p in range(parts)]
            most = int(groups.max(initial=0)) + 1
            bounds = np.stack([np.pad(f[2], ((0, 0), (0, most - f[2].shape[1]))) for f in found], axis=1).reshape(len(batch), -1)
            columns = [batch["id"], batch["label"], batch["c"], _lists(np.stack([f[0] for f in found], axis=1), pa.int16()), _lists(bounds, pa.float32()), pa.array(sum(f[1] for f in found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "c", "own", "low", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    return state.mapInArrow(moved, f"id {kinds['id']}, label {kinds['label']}, c array<int>, own array<smallint>, low array<float>, error bigint")


def entry_sums(state: DataFrame, parts: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each entry has, and their sums: (parts, entries) and (parts, entries, part length)."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sums = None
        for batch in batches:
            if len(batch):
                x, own = _matrix(batch["c"], "int64").reshape(len(batch), parts, -1), _matrix(batch["own"], "int64")
                if sums is None:
                    counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, x.shape[2]), np.int64)
                for p in range(parts):
                    order = np.argsort(own[:, p], kind="stable")
                    used, starts = np.unique(own[order, p], return_index=True)
                    sums[p, used] += np.add.reduceat(x[order, p], starts, axis=0)
                    counts[p, used] += np.diff(np.append(starts, len(batch)))
        if sums is not None:
            part, entry = np.nonzero(counts)
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), _lists(np.concatenate([counts[part, entry][:, None], sums[part, entry]], axis=1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "s"])

    added_up = state.select("c", "own").mapInArrow(added, "part int, entry int, s array<bigint>").select("part", "entry", F.posexplode("s").alias("place", "s"))
    rows = added_up.groupBy("part", "entry", "place").agg(F.sum("s").alias("s")).collect()
    found = np.zeros((parts, entries, max((r.place for r in rows), default=0) + 1), np.int64)
    for r in rows:
        found[r.part, r.entry, r.place] = r.s
    return found[:, :, 0], found[:, :, 1:]


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every vector kept, and the codebooks as (parts, entries, part length) integers.

    Vectors that are null or have null or non-finite components are dropped. A component x becomes floor(scale * x).
    Each codebook starts as that part of the `entries` smallest ids (of repeated ids the smaller vectors first; rows
    without an id are coded but start no codebook); with fewer vectors, it has as many entries. Each round assigns
    every part to its nearest entry, ties to the lower index, and replaces an entry by floor(sum / count) of its parts;
    unused entries stay. Then all parts are assigned again. code: two hex digits for each part; error: its squared
    distances added up. Repeated rows stay repeated, and columns not named are not read. An empty table, or one in which
    no row has an id, gives an empty table. Raises ValueError if kept vectors differ in length or `parts` doesn't divide
    it, and OverflowError if distances don't fit into a long.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), integer_parts(F.col(vector_col), scale).alias("c")).filter("c is not null")
    path = scratch_path(spark, "vectors")
    named.write.parquet(path)
    kept = state = spark.read.schema(named.schema).parquet(path)
    sizes = kept.agg(F.min(F.size("c")).alias("least"), F.max(F.size("c")).alias("most")).first()
    if sizes.least != sizes.most or (sizes.most or 0) % parts:
        raise ValueError(f"vectors of {sizes.least} to {sizes.most} components can't be cut into {parts} equal parts")
    seeds = kept.filter("id is not null").orderBy("id", "c").limit(entries).select("c").collect()
    if not seeds:
        remove(spark, path)
        schema = f"id {named.schema['id'].dataType.simpleString()}, label {named.schema['label'].dataType.simpleString()}, code string, error bigint"
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    books = np.array([r.c for r in seeds], np.int64).reshape(len(seeds), parts, -1).swapaxes(0, 1)
    groups, drift = np.stack([grouped(b) for b in books]), np.zeros(books.shape[:2])
    for i in range(rounds + 1):
        was, path = path, scratch_path(spark, "assigned")
        step = assign(state, books, groups, drift)
        step.write.parquet(path)
        remove(spark, was)
        state = spark.read.schema(step.schema).parquet(path)
        if i < rounds:
            counts, sums = entry_sums(state, parts, len(seeds))
            new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
            drift, books = np.sqrt(((new - books).astype(float) ** 2).sum(axis=2)), new
    code = F.array_join(F.transform("own", lambda e: F.lower(F.lpad(F.hex(e.cast("long")), 2, "0"))), "")
    return state.select("id", "label", code.alias("code"), "error"), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, **options: int) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector kept; see product_codes.

    label_error is the error added up over all vectors of an equal label; those without one are taken together. The
    sums are joined back with the rows of frequent labels dealt to parts.
    """
    codes, books = product_codes(vectors, **options)
    codes = materialize(codes.withColumn("same", F.to_json(F.struct("label"))).drop("label"), "codes")
    sums = materialize(codes.groupBy("same").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    return spread_join(codes, sums, "same").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
