"""Suffix-array deduplication: removal of every byte that a long repeated string covers.

A start is repeated if its ``length`` bytes also start anywhere else. All starts whose window has the same minimum of
64-byte hashes meet in one part of the work (equal windows have equal minima), with just the bytes around them.
Documents of equal text are one; equal stretches around a minimum are one as well.

In a part, the stretches are laid end to end and sorted by suffix to the depth needed; their Burrows-Wheeler transform
is searched by threshold-bounded interval expansion: from the interval of all suffixes, intervals are extended
backwards by one symbol, breadth first. The end of each new interval found at level v has a common prefix of v with
its neighbour; the expansion stops at ``length``, and the neighbours whose common prefix was not found by then share
at least that many bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, numbered, staged, string_buffers

LENGTH = 400
GRAM = 64
#: Bytes of stretches in a part.
PART_BYTES = 3_000_000
#: Intervals up to this size are expanded element by element.
SMALL = 24


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place."""
    h, step = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15
    width = 1
    while width < GRAM:
        h = h[: len(h) - width] * np.uint64(step) + h[width:]
        step = step * step % (1 << 64)
        width *= 2
    return mix64(h)


def _window_minimum(h: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[: len(h) - done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if done < width else h


def _profiles(length: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for first, last in chunks(offsets):
                part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                grams = _gram_hashes(part) if len(part) >= length else np.zeros(0, np.uint64)
                least = _window_minimum(grams, length - GRAM + 1) if len(part) >= length else grams
                keys, starts, again, high, low = [], [], [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    digest = xxhash.xxh3_128_intdigest(part[a:b].tobytes())
                    high.append((digest >> 64) - (1 << 63))
                    low.append((digest & (1 << 64) - 1) - (1 << 63))
                    mine = least[a : max(a, b - length + 1)]
                    new = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, int)
                    keys.append(mine[new].view(np.int64))
                    starts.append(new)
                    # a minimum at two places may have equal windows within one run
                    ends = np.append(new[1:], len(mine)) + length - GRAM
                    again.append([int(np.count_nonzero(grams[a + f : a + e] == mine[f])) > 1 for f, e in zip(new.tolist(), ends.tolist(), strict=False)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(np.diff(at), pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())), pa.array(again, pa.list_(pa.bool_()))],
                    names=["doc_id", "n_bytes", "d1", "d2", "keys", "starts", "again"],
                )

    return run


def _stretches(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            out = {"key": [], "doc_id": [], "start": [], "n_starts": [], "bytes": []}
            for i, (doc, runs) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                for r in runs:
                    for name, value in zip(out, (r["key"], doc, r["start"], r["stop"] - r["start"], text[r["start"] : r["stop"] + length - 1].tobytes()), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_starts", pa.int64()), ("bytes", pa.binary())]))

    return run


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``symbols`` (below 512) by their suffixes, right to ``depth``."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key <<= np.uint64(9)
        key[: max(0, n - j)] |= symbols[j:].astype(np.uint64)
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = first + 1
    done = 7
    while done < depth:
        alone = new & np.concatenate([new[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        places = order[slots]
        after = rank[np.minimum(places + done, n)]
        key = rank[places] << 32 | after
        by = np.argsort(key)
        places, key = places[by], key[by]
        order[slots] = places
        changed = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = changed
        rank[places] = slots[np.maximum.accumulate(np.where(changed, np.arange(len(slots)), 0))] + 1
        done *= 2
    return order


def long_neighbours(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in ``order``, whether its suffix shares ``length`` symbols with the one before.

    Symbol 0 ends a stretch: prefixes are not extended over it.
    """
    n = len(symbols)
    bwt = symbols[order - 1]
    by = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int64)
    forward[by] = np.arange(n)
    bounds = np.searchsorted(bwt[by], np.arange(int(symbols.max(initial=0)) + 2))
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    left, right = np.array([0]), np.array([n])
    source = np.zeros(n, np.int64)
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True
    for level in range(length):
        size = right - left
        found = []
        large = np.flatnonzero(size > SMALL)
        if len(large):
            for c in range(0 if level == 0 else 1, len(bounds) - 1):
                places = by[bounds[c] : bounds[c + 1]]
                if len(places):
                    a = np.searchsorted(places, left[large])
                    b = np.searchsorted(places, right[large])
                    some = b > a
                    found.append((bounds[c] + a[some], bounds[c] + b[some]))
        small = np.flatnonzero(size <= SMALL)
        if len(small):
            count = size[small]
            owner = np.repeat(np.arange(len(small)), count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left[small], count)
            if level:
                keep = bwt[place] > 0
                owner, place = owner[keep], place[keep]
            # elements of one interval with one symbol go to neighbours
            target = forward[place]
            source[target] = owner
            target.sort()
            owner = source[target]
            begins = np.ones(len(target), bool)
            begins[1:] = (target[1:] != target[:-1] + 1) | (owner[1:] != owner[:-1]) | opens[target[1:]]
            at = np.flatnonzero(begins)
            if len(at):
                found.append((target[at], target[np.append(at[1:], len(target)) - 1] + 1))
        if not found:
            break
        left = np.concatenate([a for a, _ in found])
        right = np.concatenate([b for _, b in found])
        fresh = ~known[right]
        left, right = left[fresh], right[fresh]  # intervals of one level are disjoint
        if not len(right):
            break
        known[right] = True
    return ~known[:n]


def _repeated(length: int):
    def run(key, table):
        import pyarrow as pa

        texts = table.column("bytes").to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        symbols = np.zeros(int(base[-1]), np.int16)
        for b, t in zip(base[:-1], texts, strict=True):
            symbols[b : b + len(t)] = np.frombuffer(t, np.uint8).astype(np.int16) + 1
        n_starts, several = table.column("n_starts").to_numpy(), table.column("members").to_numpy() > 1
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        own = (np.arange(len(symbols)) - base[owner]) < n_starts[owner]
        order = suffix_order(symbols, length)
        long = long_neighbours(symbols, order, length)
        group = np.cumsum(~long) - 1
        starts = np.flatnonzero(own[order])
        many = np.bincount(group[starts], minlength=int(group[-1]) + 1 if len(group) else 0)
        place = order[starts[many[group[starts]] > 1]]
        hit = np.zeros(len(symbols) + 1, bool)
        hit[place] = True
        whole = own & several[owner]
        hit[:-1] |= whole
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        i = owner[a]
        # a run of hits stays within its stretch: the bytes after the starts are none
        return pa.table({"key": table.column("key").take(pa.array(i)), "d1": table.column("d1").take(pa.array(i)), "d2": table.column("d2").take(pa.array(i)), "first": pa.array(a - base[i]), "stop": pa.array(b - base[i])})

    return run


def removed_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, spans) of documents with repeated starts, and (doc_id) of those that equal another as a whole."""
    kind = "doc_id long, n_bytes long, d1 long, d2 long, keys array<long>, starts array<long>, again array<boolean>"
    profiles = staged(docs.mapInArrow(_profiles(length), kind).where(F.col("n_bytes") >= length))
    equal = ["n_bytes", "d1", "d2"]
    texts = profiles.groupBy(*equal).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    texts = staged(texts)
    whole = profiles.select("doc_id", *equal).join(texts.where("copies > 1"), equal).select("doc_id")
    stops = F.transform("starts", lambda s, i: F.coalesce(F.get("starts", i + 1), F.col("n_bytes") - length + 1))
    runs = profiles.join(texts.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    runs = runs.select("doc_id", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("starts").alias("start"), stops.alias("stop"), F.col("again"))).alias("r")).select("doc_id", "r.key", "r.start", "r.stop", "r.again")
    shared = runs.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("again")).where("c > 1 or again").select("key")
    wanted = staged(runs.drop("again").join(shared, "key"))
    total = wanted.agg(F.sum(F.col("stop") - F.col("start") + length)).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    grouped = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "stop")).alias("runs"))
    found = docs.join(grouped, "doc_id").mapInArrow(_stretches(length), "key long, doc_id long, start long, n_starts long, bytes binary")
    found = staged(found.withColumn("d1", F.xxhash64("bytes", "n_starts")).withColumn("d2", F.hash("bytes").cast("long")))
    one = found.groupBy("key", "d1", "d2").agg(F.first("bytes").alias("bytes"), F.first("n_starts").alias("n_starts"), F.count(F.lit(1)).alias("members"))
    hits = one.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").applyInArrow(_repeated(length), "key long, d1 long, d2 long, first long, stop long")
    spans = found.drop("bytes").join(hits, ["key", "d1", "d2"]).select("doc_id", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("stop") - 1 + length).alias("stop"))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "stop")).alias("spans")), whole


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``docs`` with an id (doc_id, text).

    Texts are UTF-8 bytes, null is empty; ``kept`` are the remaining bytes. Strings are judged on the input and do not
    cross documents. Texts shorter than ``length`` lose nothing. Rows that repeat a doc_id are documents like others,
    each with its row; those that repeat a whole row are copies of each other. Rows with a null doc_id take no part,
    other columns are ignored, an empty table gives no rows.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = numbered(docs)
        out = _without_repeats(rows.select(F.col("_row").alias("doc_id"), "text"), length).withColumnRenamed("doc_id", "_row")
        return out.join(rows.select("_row", "doc_id"), "_row").select("doc_id", *[c for c in out.columns if c != "_row"])
    return _without_repeats(docs, length)


def _without_repeats(docs: DataFrame, length: int) -> DataFrame:
    """``remove_repeats`` of rows (doc_id, text) whose ids are neither null nor repeated."""
    spans, whole = removed_spans(docs, length)
    notes = spans.join(whole.distinct().withColumn("whole", F.lit(True)), "doc_id", "full")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            out = {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(offsets), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for i, (spans, whole) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("whole").to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                change = np.zeros(len(text) + 1, np.int64)
                for s in [{"first": 0, "stop": len(text)}] if whole else spans or []:
                    change[s["first"]] += 1
                    change[s["stop"]] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = text[~gone].tobytes()
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return docs.join(notes, "doc_id", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


SQL = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), starts AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 399, 0))) AS i FROM bytes)
), repeated AS (
  SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY w) > 1
), edges AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM repeated
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edges) GROUP BY doc_id, g
), kept AS (
  SELECT b.doc_id, b.n, s.k, s.a, s.b, b.h FROM bytes b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM spans) s USING (doc_id)
), pieces AS (
  SELECT doc_id, n, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (coalesce(a, n) - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS piece, a AS place, h FROM kept
), tails AS (
  SELECT doc_id, substr(any_value(h), 2 * max(b) + 1) AS tail FROM kept WHERE b IS NOT NULL GROUP BY doc_id
)
SELECT p.doc_id, any_value(n)::BIGINT AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a)::BIGINT AS n_spans,
  sha256(unhex(string_agg(piece, '' ORDER BY place) || coalesce(any_value(tail), ''))) AS kept_sha256
FROM pieces p LEFT JOIN tails t USING (doc_id) GROUP BY p.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
