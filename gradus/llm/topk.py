"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are packed into blocks of rows. A block of queries meets every block of candidates; within such a meeting the
query rows' non-zero weights of one term at a time are multiplied with that term's postings and scattered into a dense
score array, whose best entries are selected by partition. A task keeps the best of all its meetings; a window merges
those of the tasks. Blocks meet by a shuffle: queries are a part of the input, so no process could hold them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 1024
#: Candidates whose scores are held at once.
SCORE_COLUMNS = 1024
#: Blocks of candidates in a task at least: each task gets its own copy of the queries.
TASK_BLOCKS = 4
#: Winners that a task holds.
HELD = 1 << 20
#: Meetings of two blocks in one Arrow batch: a batch is bounded by rows, and a row holds two blocks.
MEETINGS = 8
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BLOCK = "first long, ids binary, terms int, weights binary"


def _packed(rows_per_block: int, factor: float):
    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            vectors = batch.column("vector")
            lengths = np.diff(np.asarray(vectors.offsets))
            flat = np.floor(np.asarray(vectors.flatten(), np.float64) * factor)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for a in range(0, len(ids), rows_per_block):
                b = min(a + rows_per_block, len(ids))
                width = int(lengths[a:b].max(initial=0))
                dense = np.zeros((b - a, width))
                inside = np.arange(width) < lengths[a:b, None]
                dense[inside] = flat[starts[a] : starts[b]]
                most = np.abs(dense).max(initial=0)
                kind = np.int16 if most < 2.0**15 else np.int32 if most < 2.0**31 else np.float64
                # term-major, so that one term's weights lie together
                yield pa.RecordBatch.from_pydict({"first": pa.array([int(ids[a])], pa.int64()), "ids": [ids[a:b].astype(np.int64).tobytes()], "terms": pa.array([width], pa.int32()), "weights": [np.ascontiguousarray(dense.T.astype(kind)).tobytes()]})

    return pack


def _weights(blob: bytes, terms: int, n: int) -> np.ndarray:
    """A block's whole numbers by term: two or four bytes each or, if some are larger, doubles, which hold a floored number exactly."""
    size = len(blob) // (terms * n) if terms * n else 2
    return np.frombuffer(blob, {2: np.int16, 4: np.int32, 8: np.float64}[size]).reshape(terms, n)


def _exact(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit numbers if no score of theirs can pass 64 bits, else as Python's whole numbers."""
    n = min(len(queries), len(candidates))
    most = [np.abs(x.astype(np.float64)).max(axis=1, initial=0) for x in (queries, candidates)]
    if (most[0][:n] * most[1][:n]).sum() < 2.0**62 and all(m.max(initial=0) < 2.0**62 for m in most):
        return queries.astype(np.int64), candidates.astype(np.int64)
    return tuple(np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (queries, candidates))


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products of term-major weights: (terms, q) and (terms, c) to (q, c)."""
    scores = np.zeros((queries.shape[1], candidates.shape[1]), queries.dtype)
    for term in range(min(len(queries), len(candidates))):
        rows = np.flatnonzero(queries[term])
        if len(rows) == queries.shape[1]:
            scores += queries[term][:, None] * candidates[term]
        elif len(rows):
            scores[rows] += queries[term][rows][:, None] * candidates[term]
    if scores.dtype == object:
        if any(abs(v) >= 1 << 63 for v in scores.ravel()):
            raise OverflowError("a score passes 64 bits: take a smaller factor")
        scores = scores.astype(np.int64)
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _first(found: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query ids, candidate ids, scores) the ``k`` best of each query, ties to the smaller id."""
    asked, there, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((there, -scores, asked))
    asked = asked[order]
    kept = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
    return asked[kept], there[order][kept], scores[order][kept]


def _meet(k: int):
    def meet(batches):
        import pyarrow as pa

        out = lambda best: pa.RecordBatch.from_pydict({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), best, strict=True)})
        found, held, settled = [], 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda name: batch.column(name)[row].as_py()
                q_ids, c_ids = np.frombuffer(at("q_ids"), np.int64), np.frombuffer(at("ids"), np.int64)
                q, c = _exact(_weights(at("q_weights"), at("q_terms"), len(q_ids)), _weights(at("weights"), at("terms"), len(c_ids)))
                for a in range(0, len(q_ids), 128):
                    scores = accumulate(q[:, a : a + 128], c)
                    for i, query_id in enumerate(q_ids[a : a + 128]):
                        others = np.flatnonzero(c_ids != query_id)
                        best = others[select(scores[i][others], c_ids[others], k)] if len(others) < len(c_ids) else select(scores[i], c_ids, k)
                        found.append((np.full(len(best), query_id), c_ids[best], scores[i][best]))
                        held += len(best)
                if held > 2 * settled + 16 * QUERY_BLOCK * k:
                    found = [_first(found, k)]
                    held = settled = len(found[0][0])
                    if held > HELD:
                        yield out(found[0])
                        found, held, settled = [], 0, 0
        if found:
            yield out(_first(found, k))

    return meet


def top_k(vectors: DataFrame, is_query, k: int = 5, factor: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of each row that ``is_query`` selects.

    ``vectors`` has vec_id and embedding (an array); components become floor(factor * x) and scores are integer inner
    products, exact however large; one that passes 64 bits raises. Vectors (or ids) that are null, or hold null or
    non-finite components, take no part; shorter vectors count as 0 beyond their end; an empty vector scores 0. A row
    is no candidate for queries of its own id; repeated other rows each count. Other columns are ignored.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    asked = staged(rows.where(is_query).mapInArrow(_packed(QUERY_BLOCK, factor), _BLOCK))
    blocks = staged(rows.mapInArrow(_packed(CANDIDATE_BLOCK, factor), _BLOCK))
    salts = max(8, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), blocks.count() // TASK_BLOCKS))
    asked = asked.toDF("q_first", "q_ids", "q_terms", "q_weights").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("first"), F.lit(salts)).cast("int"))
    # never a broadcast, which Spark would choose by the size of the queries before they are copied
    met = blocks.join(asked.hint("merge"), "salt").drop("salt", "first", "q_first")
    conf = rows.sparkSession.conf
    before = conf.get(BATCH)
    conf.set(BATCH, str(MEETINGS))
    try:
        best = staged(met.mapInArrow(_meet(k), "query_id long, vec_id long, score long"))
    finally:
        conf.set(BATCH, before)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


SQL = """
WITH parts AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS n FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), good AS (
  SELECT vec_id FROM parts GROUP BY vec_id, n HAVING count(x) = n AND bool_and(isfinite(x))
), v AS (
  SELECT vec_id, i, floor(256 * x)::BIGINT AS w FROM parts WHERE vec_id IN (SELECT vec_id FROM good)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
