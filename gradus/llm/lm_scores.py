"""Stupid-backoff scores of every document under a bigram model of the whole corpus.

S(w | v) = count(v w) / count(v) where the pair was seen at least ``MIN_COUNT`` times, else ALPHA * count(w) / N; a
document's first word scores ALPHA * count(w) / N. Counts are of all documents.

Documents are packed into runs. Each run's distinct words and pairs go, with their counts, to the count table's
partition of their hash; a partition adds up each n-gram's counts and answers every run with the totals of its
n-grams; joined back to the run's exploded n-grams they give the scores, summed per document. A frequent pair costs a
partition one entry a run, not one an occurrence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, document_words, mix64, pack_sorted, staged, string_buffers, unpack_sorted

ALPHA = 0.4
MIN_COUNT = 2
#: Bytes of text in a run, and n-grams dealt to a partition.
RUN_BYTES = 1 << 20
PART_GRAMS = 2_000_000


def _runs(batches):
    import pyarrow as pa
    import xxhash

    codec = pa.Codec("zstd", 1)
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = string_buffers(batch.column("text"))
        for first, last in chunks(offsets, RUN_BYTES):
            mine = ids[first:last]
            text = data[offsets[first] : offsets[last]].tobytes()
            words = sum(len(w) for _, w, _ in document_words(batch.column("text").slice(first, last - first)))
            # runs of one name share their totals, so it stands for ids and texts
            name = xxhash.xxh3_64_intdigest(text, xxhash.xxh3_64_intdigest(mine.tobytes() + np.diff(offsets[first : last + 1]).tobytes())) - (1 << 63)
            yield pa.RecordBatch.from_pydict(
                {"run": pa.array([name], pa.int64()), "ids": [mine.tobytes()], "at": [(offsets[first : last + 1] - offsets[first]).astype(np.int64).tobytes()], "text": [codec.compress(text, asbytes=True)], "words": pa.array([words], pa.int64())}
            )


def _run_words(at: np.ndarray, text: bytes):
    """Word hashes and word offsets of a run."""
    import pyarrow as pa

    data = pa.Codec("zstd", 1).decompress(text, int(at[-1]), asbytes=True) if at[-1] else b""
    column = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])
    hashes, bounds, n = [], [np.zeros(1, np.int64)], 0
    for _, words, offsets in document_words(column):
        hashes.append(words)
        bounds.append(offsets[1:] + n)
        n += len(words)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(bounds)


def _grams(words: np.ndarray, bounds: np.ndarray):
    """Keys of the words, keys of the pairs, and whether a pair lies within a document."""
    pairs = mix64(words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:]) if len(words) else words
    inside = np.ones(len(pairs), bool)
    cuts = bounds[1:-1] - 1
    inside[cuts[(cuts >= 0) & (cuts < len(pairs))]] = False
    return words, pairs, inside


def _counted(parts: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                at = np.frombuffer(batch.column("at")[i].as_py(), np.int64)
                words, pairs, inside = _grams(*_run_words(at, batch.column("text")[i].as_py()))
                keys, counts = np.unique(np.concatenate([words, pairs[inside]]), return_counts=True)
                part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(keys) else np.zeros(1, int)
                rows = [(int(part[a]), pack_sorted(keys[a:b]), pa.Codec("zstd", 1).compress(counts[a:b].astype(np.uint32).tobytes(), asbytes=True)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if rows:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int64()), "run": pa.array([batch.column("run")[i].as_py()] * len(rows), pa.int64()), "grams": [r[1] for r in rows], "counts": [r[2] for r in rows]})

    return run


def _totals(key, table):
    import pyarrow as pa

    codec = pa.Codec("zstd", 1)
    keys = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
    counts = [np.frombuffer(codec.decompress(x, 4 * len(k), asbytes=True), np.uint32) for k, x in zip(keys, table.column("counts").to_pylist(), strict=True)]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)[inverse]
    ends = np.cumsum([len(k) for k in keys])
    blobs = [codec.compress(sums[b - len(k) : b].tobytes(), asbytes=True) for k, b in zip(keys, ends, strict=True)]
    return pa.table({"run": table.column("run"), "part": table.column("part"), "n": pa.array([len(k) for k in keys], pa.int64()), "totals": pa.array(blobs, pa.binary())})


def _scores(total: int, alpha: float, min_count: int):
    def run(left, right):
        import pyarrow as pa

        codec = pa.Codec("zstd", 1)
        out = {"doc_id": [np.zeros(0, np.int64)], "n_words": [np.zeros(0, np.int64)], "log_score": [np.zeros(0)]}
        answers = sorted({(p, n, t) for p, n, t in zip(right.column("part").to_pylist(), right.column("n").to_pylist(), right.column("totals").to_pylist(), strict=True)})
        sums = np.concatenate([np.frombuffer(codec.decompress(t, 8 * n, asbytes=True), np.int64) for _, n, t in answers]) if answers else np.zeros(0, np.int64)
        for ids, at, text in zip(left.column("ids").to_pylist(), left.column("at").to_pylist(), left.column("text").to_pylist(), strict=True):
            words, bounds = _run_words(np.frombuffer(at, np.int64), text)
            words, pairs, inside = _grams(words, bounds)
            keys = np.unique(np.concatenate([words, pairs[inside]]))
            one = sums[np.searchsorted(keys, words)].astype(float)
            log = np.log(alpha * one / total)
            if len(pairs):
                two = np.zeros(len(pairs))
                two[inside] = sums[np.searchsorted(keys, pairs[inside])]
                seen = np.flatnonzero(two >= min_count)
                log[seen + 1] = np.log(two[seen] / one[seen])
            sizes = np.diff(bounds)
            out["doc_id"].append(np.frombuffer(ids, np.int64))
            out["n_words"].append(sizes)
            out["log_score"].append(np.bincount(np.repeat(np.arange(len(sizes)), sizes), log, len(sizes)))
        return pa.table({k: np.concatenate(v) for k, v in out.items()})

    return run


def backoff_scores(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for every row of ``docs`` with an id (doc_id, text).

    Words are lower-cased (A-Z). Documents without words (null, empty) score 0 with a null mean; repeated rows are
    counted and scored each; rows with a null doc_id take no part; other columns are ignored.
    """
    runs = staged(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(_runs, "run long, ids binary, at binary, text binary, words long"))
    total = runs.agg(F.sum("words")).first()[0] or 0
    parts = max(16, -(-2 * total // PART_GRAMS))
    grams = runs.select("run", "at", "text").mapInArrow(_counted(parts), "part long, run long, grams binary, counts binary")
    # staged, so that the n-grams' shuffle files, the largest, go before the texts are dealt out
    totals = staged(grams.groupBy("part").applyInArrow(_totals, "run long, part long, n long, totals binary"))
    both = runs.select("run", "ids", "at", "text").groupBy("run").cogroup(totals.groupBy("run"))
    out = both.applyInArrow(_scores(total, alpha, min_count), "doc_id long, n_words long, log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), placed AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words
), grams AS (
  SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM placed
), one AS (
  SELECT w, count(*) AS c FROM placed GROUP BY w
), two AS (
  SELECT v, w, count(*) AS c FROM grams WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= 2
), scored AS (
  SELECT g.doc_id, CASE WHEN t.c IS NOT NULL THEN ln(t.c::DOUBLE / o.c) ELSE ln(0.4::DOUBLE * u.c / (SELECT count(*) FROM placed)) END AS s
  FROM grams g LEFT JOIN two t ON g.v = t.v AND g.w = t.w LEFT JOIN one o ON o.w = g.v JOIN one u ON u.w = g.w
), summed AS (
  SELECT doc_id, count(*) AS n, sum(s) AS s FROM scored GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(s, 0), 6) AS log_score, round(s / n, 6) AS mean_log_score FROM words d LEFT JOIN summed USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))
