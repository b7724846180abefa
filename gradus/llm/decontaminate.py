"""Benchmark decontamination: documents that hold a benchmark item.

Where a document has a shingle of some item, windows of the item's size around it get a SimHash fingerprint. Items are
indexed by blocks of their fingerprints: two fingerprints within RADIUS bits differ by at most RADIUS / BLOCKS in some
block, so looking up every item under all block values that near finds all within the radius. Candidates are then
verified by the weighted Jaccard similarity of their shingles, each weighing as often as it occurs. A window without
any of an item's shingles has similarity 0, so no window is lost by starting from shared shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_words, shingle_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: A window and an item of similarity 0.8 differ in 10 bits on average; the tests measure the recall.
RADIUS = 17
#: Bits of each block of a 64-bit fingerprint.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Items and characters of items matched at once; a longer benchmark takes several passes over the documents.
BATCH_ITEMS = 10_000
BATCH_BYTES = 8_000_000
_BITS = np.arange(64, dtype=np.uint64)


def _signs(hashes: np.ndarray) -> np.ndarray:
    return ((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


def _near(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], np.int64)


class ItemIndex:
    """Items as shingle multisets with fingerprints, indexed by shingle and by fingerprint blocks."""

    def __init__(self, ids: list[int], texts: list[str], radius: int = RADIUS):
        import pyarrow as pa

        self.radius = radius
        words = [np.zeros(0, np.uint64)] * len(ids)
        for first, hashes, at in document_words(pa.array(texts, pa.large_string()), punctuation=True):
            for i in range(len(at) - 1):
                words[first + i] = hashes[at[i] : at[i + 1]]
        kept = [i for i, w in enumerate(words) if len(w)]
        self.ids = np.array([ids[i] for i in kept], np.int64)
        self.sizes = np.array([len(words[i]) for i in kept], np.int64)
        self.widths = np.minimum(self.sizes, SHINGLE)
        self.shingles = [shingle_hashes(words[i], SHINGLE) for i in kept]
        self.counts = [np.unique(s, return_counts=True) for s in self.shingles]
        self.prints = np.concatenate([_fingerprints(_signs(s).sum(0, keepdims=True)) for s in self.shingles]) if kept else np.zeros(0, np.uint64)
        self.owner = {}
        for width in np.unique(self.widths):
            mine = np.flatnonzero(self.widths == width)
            token = np.concatenate([self.counts[i][0] for i in mine])
            item = np.repeat(mine, [len(self.counts[i][0]) for i in mine])
            order = np.argsort(token, kind="stable")
            quick = np.zeros(1 << 16, bool)
            quick[(token & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.owner[int(width)] = token[order], item[order], quick
        self.blocks = []
        start = 0
        for bits in BLOCKS:
            value = ((self.prints >> np.uint64(start)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            near = (value[:, None] ^ _near(bits, radius // len(BLOCKS))).ravel()
            item = np.repeat(np.arange(len(value)), len(near) // max(1, len(value)))
            order = np.argsort(near, kind="stable")
            self.blocks.append((start, bits, np.searchsorted(near[order], np.arange((1 << bits) + 1)), item[order]))
            start += bits

    def candidates(self, prints: np.ndarray) -> np.ndarray:
        """(window, item) pairs within the radius."""
        found = []
        for start, bits, begin, item in self.blocks:
            value = ((prints >> np.uint64(start)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            size = begin[value + 1] - begin[value]
            window = np.repeat(np.arange(len(prints)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[value], size)
            near = item[at]
            good = np.bitwise_count(prints[window] ^ self.prints[near]) <= self.radius
            found.append(np.stack([window[good], near[good]], 1))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, words: np.ndarray, threshold: float) -> dict[int, tuple[float, int]]:
        """Item -> (highest similarity, first word of its window) for the items found in a document."""
        best: dict[int, tuple[float, int]] = {}
        for width, (token, owner, quick) in self.owner.items():
            if len(words) < width:
                continue
            shingles = shingle_hashes(words, width)
            hit = np.flatnonzero(quick[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
            low = np.searchsorted(token, shingles[hit])
            high = np.searchsorted(token, shingles[hit], "right")
            keep = high > low
            hit, low, high = hit[keep], low[keep], high[keep]
            if not len(hit):
                continue
            sizes = {}
            for h, a, b in zip(hit, low, high, strict=True):
                for i in set(self.sizes[owner[a:b]]):
                    sizes.setdefault(int(i), []).append(h)
            for size, at in sizes.items():
                span = min(size, len(words))
                inner = span - width + 1
                at = np.unique(at)
                starts = np.unique((at[:, None] - np.arange(inner)).ravel())
                starts = starts[(starts >= 0) & (starts + span <= len(words))]
                # sums over windows from running sums over the stretches that have any
                low_at, high_at = starts.min(), starts.max() + inner
                run = np.zeros((high_at - low_at + 1, 64), np.int32)
                np.cumsum(_signs(shingles[low_at:high_at]), axis=0, out=run[1:])
                prints = _fingerprints(run[starts - low_at + inner] - run[starts - low_at])
                for window, item in self.candidates(prints):
                    if self.widths[item] != width:
                        continue
                    start = int(starts[window])
                    similarity = self._weighted(item, shingles[start : start + inner])
                    if similarity >= threshold and similarity > best.get(item, (0.0, 0))[0]:
                        best[int(item)] = similarity, start
        return best

    def _weighted(self, item: int, window: np.ndarray) -> float:
        a, x = self.counts[item]
        b, y = np.unique(window, return_counts=True)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        both = int(np.minimum(x[i], y[j]).sum())
        return both / (int(x.sum()) + int(y.sum()) - both)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): the items that each row of ``docs`` holds, with the best window of each.

    Words are lower-cased runs of letters and digits. Items of fewer words than a shingle are one shingle of all their
    words; items and documents without words (null, empty) match nothing; a document shorter than an item is one
    window. Rows of one doc_id have the matches of each of their texts, equal matches once; repeated items of one id count once.
    """

    def run_with(index):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                out = {"at": [], "item_id": [], "similarity": [], "start_word": []}
                for first, words, at in document_words(batch.column("text"), punctuation=True):
                    for i in _with_hits(index, words, at):
                        for item, (similarity, start) in index.matches(words[at[i] : at[i + 1]], threshold).items():
                            for name, value in zip(out, (first + i, int(index.ids[item]), similarity, start), strict=True):
                                out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(out["at"], pa.int64())), pa.array(out["item_id"], pa.int64()), pa.array(out["similarity"], pa.float64()), pa.array(out["start_word"], pa.int64())],
                    names=["doc_id", "item_id", "similarity", "start_word"],
                )

        return run

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, similarity double, start_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(benchmark):
        found = found.union(docs.mapInArrow(run_with(index), schema))
    return found.dropDuplicates(["doc_id", "item_id", "similarity", "start_word"])


def _indexes(benchmark: DataFrame):
    """The items in indexes of at most BATCH_ITEMS items and about BATCH_BYTES of text each, one at a time in the driver."""
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id", "text").count()
    batch, size = [], 0
    for r in items.toLocalIterator():
        if batch and (len(batch) == BATCH_ITEMS or size + len(r["text"]) > BATCH_BYTES):
            yield ItemIndex([x["item_id"] for x in batch], [x["text"] for x in batch])
            batch, size = [], 0
        batch.append(r)
        size += len(r["text"])
    if batch:
        yield ItemIndex([x["item_id"] for x in batch], [x["text"] for x in batch])


def _with_hits(index: ItemIndex, words: np.ndarray, at: np.ndarray):
    """Documents of a run with some item's shingle, or one too short to tell here."""
    found = np.zeros(len(at) - 1, bool)
    for width, (token, _, quick) in index.owner.items():
        if len(words) >= width:
            shingles = shingle_hashes(words, width)
            hit = np.flatnonzero(quick[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
            hit = hit[np.isin(shingles[hit], token)]
            found[np.searchsorted(at, hit, "right") - 1] = True
    return np.flatnonzero(found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, same columns, without the rows that hold an item.

    Each row is judged by its text alone where it lies, so nothing is shuffled: rows with a null doc_id or that repeat
    one are judged like others, null and empty texts stay, columns of any name stay as they are.
    """

    def run_with(index):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, words, at in document_words(batch.column("text"), punctuation=True):
                    for i in _with_hits(index, words, at):
                        clean[first + i] = not index.matches(words[at[i] : at[i + 1]], threshold)
                yield batch.filter(pa.array(clean))

        return run

    for index in _indexes(benchmark):
        docs = docs.mapInArrow(run_with(index), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    out = benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("start_word"))
