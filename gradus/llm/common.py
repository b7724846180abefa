"""What the operators of this subpackage share: staged tables, word splitting and hashing in Arrow batches.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z are lower-cased where an operator says so.
Nulls count as empty texts.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words where punctuation counts as space: all ASCII but letters and digits.
_PUNCTUATED = np.ones(256, bool)
_PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)
#: Multipliers by position inside a shingle: powers of an odd number, so any shingle length works.
_STEP = 0xD6E8FEB86659FD93
CHUNK_BYTES = 1 << 20
#: Whether shuffle files go when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Paths staged in each open ``scratch`` block, the innermost last.
_OPEN: list[list[str]] = []


def staging_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where none is set, a session in one process (a test) gets its own;
    a cluster has to name one, as a local folder would be seen by one machine alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = folder or tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there, lost executors cost no recomputation.

    Its shuffle files go as soon as the table is whole, for nothing reads them any more. The table itself goes with the
    innermost ``scratch`` block, if there is one.
    """
    conf, path = df.sparkSession.conf, f"{staging_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    if _OPEN:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside go when the block ends, but those handed to the function it gives; they go to the block around.

    What is read after the block has to be handed over, as a plan reads its tables when it runs.
    """
    made: list[str] = []
    kept: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield kept.append
    finally:
        _OPEN.pop()
        files = {f for df in kept for f in df.inputFiles()}
        for path in made:
            if any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in files):
                if _OPEN:
                    _OPEN[-1].append(path)
                continue
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` staged with a number of each row in ``_row``: ids may be null or repeat, these are neither."""
    return staged(df.withColumn("_row", F.monotonically_increasing_id()))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit hashes (in place on a copy)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        both = []
        for base in (_ODD, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS = both[0], both[1]
    return _POWERS


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, last) runs of documents of about ``limit`` bytes; a longer document is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the documents that ``offsets`` (from 0) delimit in ``data``, and n + 1 word offsets; ``punctuation`` separates words too if asked."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~(_PUNCTUATED if punctuation else _SPACE)[data]
    first = inside[1:-1] & ~inside[:-2]
    final = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = inside[edges + 1]
    final[edges - 1] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word: polynomial in an odd base, cut from one running sum, then mixed."""
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data.astype(np.uint64)) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def document_words(column, lower: bool = True, punctuation: bool = False):
    """For runs of documents: (first document, word hashes, n + 1 word offsets)."""
    data, offsets = string_buffers(column)
    for first, last in chunks(offsets):
        part = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        starts, ends, words = word_spans(part, at, punctuation)
        yield first, word_hashes(part, starts, ends, lower), words


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; with fewer words, that of the whole sequence; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out, factor = np.zeros(n - k + 1, np.uint64), 1
    for j in range(k):
        out += words[j : n - k + 1 + j] * np.uint64(factor)
        factor = factor * _STEP % (1 << 64)
    return mix64(out + np.uint64(k))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: the steps of their upper bits compressed, the rest as it is."""
    import pyarrow as pa

    steps = np.diff((keys >> np.uint64(40)).astype(np.int64), prepend=0).astype(np.uint32).tobytes()
    head = pa.Codec("zstd", 1).compress(steps, asbytes=True)
    low = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
    return len(keys).to_bytes(4, "little") + len(head).to_bytes(4, "little") + head + low


def unpack_sorted(blob: bytes) -> np.ndarray:
    import pyarrow as pa

    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    steps = np.frombuffer(pa.Codec("zstd", 1).decompress(blob[8 : 8 + size], 4 * n, asbytes=True), np.uint32)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :5] = np.frombuffer(blob, np.uint8, offset=8 + size).reshape(n, 5)
    return keys.view("<u8").ravel().astype(np.uint64) | np.cumsum(steps.astype(np.uint64)) << np.uint64(40)
