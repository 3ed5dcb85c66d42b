"""Benchmark decontamination by SimHash over windows as long as each benchmark item.

Every window of a document that has an item's number of words is compared with it. A window whose weighted
five-word shingles are similar enough has to share most of them with the item, so only windows with that many
shared shingles are fingerprinted. A fingerprint's candidates come from a multi-index over the items' ones: eight
blocks, each looked up within distance radius // 8, which returns every fingerprint within the radius. Candidates
are then verified by the exact similarity of shingle counts: sum of minima over sum of maxima.

At a similarity of 0.8 a bit differs with probability arccos(0.89) / pi = 0.15, so about 10 of 64 do; the radius of
23 is almost five standard deviations above that.

The items are a query set: they go to the executors in blocks of bounded size, each block against all documents.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import resident
from .simhash import SEED, fingerprint, shingles

WIDTH, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
#: A block of items that is sent to the executors has at most so many items and so many characters.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
SCHEMA = "doc_id long, item_id long, start long, distance int, similarity double"
U64 = (1 << 64) - 1


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _hashes(grams: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ordered array."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class ItemIndex:
    """The items of one block, by their number of words."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.vocabulary: dict[bytes, int] = {}
        self.sizes: dict[int, dict] = {}
        for item_id, text in items:
            words = (text or "").encode().lower().split()
            if words:
                for w in words:
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                self.sizes.setdefault(len(words), {"ids": [], "grams": [], "prints": []})
                own, grams = self.sizes[len(words)], shingles(text, WIDTH)
                own["ids"].append(item_id)
                own["grams"].append(Counter(grams))
                own["prints"].append(fingerprint(text, WIDTH) & U64)
        self.known: dict[int, list[np.ndarray]] = {}
        for words, own in self.sizes.items():
            own["width"] = min(WIDTH, words)
            keys = [self._keys(np.array([self.vocabulary[w] for w in b" ".join([g]).split()], dtype=np.uint64), own["width"]) for c in own["grams"] for g in c]
            own["keys"] = np.unique(np.concatenate(keys))
            self.known.setdefault(own["width"], []).append(own["keys"])
            own["table"] = self._blocks(own["prints"])
        self.all_keys = {w: np.unique(np.concatenate(k)) for w, k in self.known.items()}

    @staticmethod
    def _keys(ids: np.ndarray, width: int) -> np.ndarray:
        """One number for each run of width word ids; equal runs have equal ones. Only a filter: others may too."""
        last = len(ids) - width + 1
        keys = ids[:last].copy()
        for i in range(1, width):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + last]
        return keys

    def _blocks(self, prints: list[int]) -> list[list[int]]:
        """table[b][v]: as the bits of an integer, the items whose block b is within radius // BLOCKS of v."""
        table = [[0] * 256 for _ in range(BLOCKS)]
        near = [v for v in range(256) if v.bit_count() <= self.radius // BLOCKS]
        for i, p in enumerate(prints):
            for b in range(BLOCKS):
                for flip in near:
                    table[b][(p >> 8 * b & 255) ^ flip] |= 1 << i
        return table

    def _candidates(self, own: dict, print_: int) -> Iterator[tuple[int, int]]:
        mask = 0
        for b in range(BLOCKS):
            mask |= own["table"][b][print_ >> 8 * b & 255]
        while mask:
            i = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            if (d := (own["prints"][i] ^ print_).bit_count()) <= self.radius:
                yield i, d

    def find(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item_id, first word of the window, distance, similarity) of each item's best window, the earliest of equals."""
        words = (text or "").encode().lower().split()
        if not words:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), dtype=np.uint64, count=len(words))
        found: dict[tuple[int, int], tuple[int, int, int, float]] = {}
        for width, keys in self.all_keys.items():
            if len(words) < width:
                continue
            full = np.concatenate(([0], np.cumsum(ids > 0)))
            starts = np.flatnonzero(full[width:] - full[:-width] == width)
            if not len(starts):
                continue
            made = self._keys(ids, width)
            at = starts[_among(made[starts], keys)]
            if not len(at):
                continue
            grams = hashes = None
            for n, own in self.sizes.items():
                if own["width"] != width:
                    continue
                hits = np.zeros(len(words) - width + 2, dtype=np.int64)
                hits[at[_among(made[at], own["keys"])] + 1] = 1
                hits = np.cumsum(hits)
                long = min(n, len(words)) - width + 1  # shingles of a window
                # Shared shingles s of window and item make s / (long + item - s), which has to reach the similarity.
                least = self.similarity / (1 + self.similarity) * (long + n - width + 1)
                windows = np.flatnonzero(hits[long:] - hits[:-long] >= least - 1e-9)
                if not len(windows):
                    continue
                if grams is None:
                    grams = shingles(text, width)
                    hashes = _hashes(grams)
                for part in self._parts(windows):
                    first = int(part[0])
                    sums = np.concatenate((np.zeros((1, 64), dtype=np.int32), np.cumsum(_bits(hashes[first : int(part[-1]) + long]), axis=0, dtype=np.int32)))
                    prints = np.packbits(2 * (sums[part - first + long] - sums[part - first]) > long, axis=1, bitorder="little").view("<u8").ravel().tolist()
                    for start, p in zip(part.tolist(), prints, strict=True):
                        counts = None
                        for i, distance in self._candidates(own, p):
                            counts = counts or Counter(grams[start : start + long])
                            shared = (counts & own["grams"][i]).total()
                            similarity = shared / (long + own["grams"][i].total() - shared)
                            if similarity >= self.similarity - 1e-12 and ((n, i) not in found or similarity > found[n, i][3]):
                                found[n, i] = (own["ids"][i], start, distance, similarity)
        return sorted(found.values(), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    def _parts(self, windows: np.ndarray, span: int = 20_000) -> list[np.ndarray]:
        """The windows in parts that begin within `span` words of each other, so that sums are held for one part alone."""
        return np.split(windows, np.flatnonzero(np.diff((windows - windows[0]) // span)) + 1)


def _index(items: Broadcast, similarity: float, radius: int) -> ItemIndex:
    """Built once for each Python worker and block."""
    return resident(("items", items.value["token"], similarity, radius), lambda: ItemIndex(items.value["items"], similarity, radius))


def item_blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of bounded size; the driver holds one block and one row more."""
    block, chars = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        if block and (len(block) >= block_items or chars + len(r.text or "") > block_chars):
            yield block
            block, chars = [], 0
        block.append((r.item_id, r.text))
        chars += len(r.text or "")
    if block:
        yield block


def _broadcasts(benchmark: DataFrame, block_items: int, block_chars: int) -> list[Broadcast]:
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast({"token": uuid.uuid4().hex, "items": b}) for b in item_blocks(benchmark, block_items, block_chars)]


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, distance, similarity): one row per document and item that it holds.

    A-Z are lower-cased and words are what stands between ASCII white space. Items and windows of fewer than five
    words are one shingle, the whole sequence. A document shorter than an item is one window. Null or empty texts,
    of items or documents, match nothing. Each row of docs gives the best window of each row of benchmark, so repeated
    rows of either give repeated rows, whatever the blocks. Null ids are carried. Empty tables give an empty result.
    Only doc_id and text, item_id and text are read. Each further block of items reads docs once more.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], SCHEMA)
    for items in _broadcasts(benchmark, block_items, block_chars):

        def search(batches: Iterator[pd.DataFrame], items: Broadcast = items) -> Iterator[pd.DataFrame]:
            index = _index(items, similarity, radius)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch["doc_id"].array, batch["text"].array, strict=True) for m in index.find(t)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "distance", "similarity"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        found = found.union(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(search, SCHEMA))
    return found


def is_contaminated(text: Column, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> Column:
    """Whether a text holds any item of the benchmark; false for null and empty texts."""
    flagged = F.lit(False)
    for items in _broadcasts(benchmark, block_items, block_chars):
        flagged = flagged | _holds(text, items, similarity, radius)
    return flagged


def _holds(text: Column, items: Broadcast, similarity: float, radius: int) -> Column:
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        index = _index(items, similarity, radius)
        return pd.Series([bool(index.find(t)) for t in texts], dtype=bool)

    return holds(text)
