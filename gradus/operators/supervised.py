"""Class-aware filters: entropy discretisation, merging of labels, synthetic rows."""

from __future__ import annotations

from math import log2

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import Fitted, cut_label

#: Rows that meet others at once in the search for neighbours.
BLOCK = 1024


def entropy(counts) -> float:
    total = sum(counts)
    return -sum(c / total * log2(c / total) for c in counts if c) if total else 0.0


def mdl_cuts(df: DataFrame, column: str, target: str, kononenko: bool = False) -> list[float]:
    """Cut points by recursive splits of least class entropy that pay for their description length.

    Each level of the recursion is one Spark job over class counts by value: the open intervals' best splits are found
    by running sums in windows, and only one row an interval comes to the driver.
    """
    known = df.where(F.col(column).isNotNull() & F.col(target).isNotNull())
    counts = known.groupBy(F.col(column).cast("double").alias("v"), F.col(target).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    classes = [r["c"] for r in counts.select("c").distinct().orderBy("c").collect()]
    rows = counts.groupBy("v").pivot("c", classes).agg(F.sum("n")).na.fill(0)
    cols = [f"k{i}" for i in range(len(classes))]
    rows = rows.toDF("v", *cols).persist()
    cuts: list[float] = []
    open_ = [(None, None)]
    while open_:
        part = F.lit(-1)
        for i, (a, b) in enumerate(open_):
            inside = (F.col("v") > a if a is not None else F.lit(True)) & (F.col("v") <= b if b is not None else F.lit(True))
            part = F.when(inside, F.lit(i)).otherwise(part)
        w = Window.partitionBy("part").orderBy("v")
        whole = Window.partitionBy("part")
        x = rows.withColumn("part", part).where("part >= 0")
        left = {c: F.sum(c).over(w) for c in cols}
        total = {c: F.sum(c).over(whole) for c in cols}
        x = x.select("part", "v", F.lead("v").over(w).alias("next"), F.count(F.lit(1)).over(whole).alias("values"), *[left[c].alias(f"l{c}") for c in cols], *[total[c].alias(f"t{c}") for c in cols])

        def bits(names):
            n = sum(names[1:], names[0])
            return sum((F.when(k > 0, -k * F.log2(k / n)).otherwise(0.0) for k in names[1:]), F.when(names[0] > 0, -names[0] * F.log2(names[0] / n)).otherwise(0.0))

        lo = [F.col(f"l{c}") for c in cols]
        hi = [F.col(f"t{c}") - F.col(f"l{c}") for c in cols]
        best = x.where("next is not null").withColumn("cost", bits(lo) + bits(hi)).groupBy("part").agg(F.min(F.struct("cost", "v", "next", "values", *[f"l{c}" for c in cols], *[f"t{c}" for c in cols])).alias("b")).collect()
        after = []
        for r in best:
            b = r["b"]
            ls, ts = [b[f"l{c}"] for c in cols], [b[f"t{c}"] for c in cols]
            hs = [t - k for t, k in zip(ts, ls, strict=True)]
            n, h, h1, h2 = sum(ts), entropy(ts), entropy(ls), entropy(hs)
            gain = h - (sum(ls) * h1 + sum(hs) * h2) / n
            k, k1, k2 = (sum(1 for c in s if c) for s in (ts, ls, hs))
            if kononenko:
                accept = gain > 0 and k > 1
            else:
                delta = log2(3**k - 2) - (k * h - k1 * h1 - k2 * h2)
                accept = gain > 0 and gain > (log2(max(1, b["values"] - 1)) + delta) / n
            if accept:
                a, z = open_[r["part"]]
                cut = (b["v"] + b["next"]) / 2
                cuts.append(cut)
                after += [(a, cut), (cut, z)]
        open_ = after
    rows.unpersist()
    return sorted(cuts)


def fit_discretize(df: DataFrame, columns: list[str], target: str) -> Fitted:
    cuts = {c: mdl_cuts(df, c, target) for c in columns}
    return Fitted({c: cut_label(F.col(c), cuts[c]) for c in columns}, cuts)


def class_conditional(df: DataFrame, column: str, target: str) -> DataFrame:
    """(target, column, p): Pr(value | class) with one added to each count (as a naive-Bayes estimator)."""
    known = df.where(F.col(column).isNotNull() & F.col(target).isNotNull())
    counts = known.groupBy(target, column).agg(F.count(F.lit(1)).alias("n"))
    values = counts.select(column).distinct().count()
    totals = counts.groupBy(target).agg(F.sum("n").alias("t"))
    return counts.join(totals, target).select(target, column, ((F.col("n") + 1) / (F.col("t") + values)).alias("p"))


def _packed(batches):
    """Blocks of at most BLOCK rows (key, vector) in the order of their keys."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        table = pa.Table.from_batches([batch])
        for a in range(0, len(table), BLOCK):
            part = table.slice(a, BLOCK)
            part = part.take(pc.sort_indices(part.column(0), null_placement="at_start")).combine_chunks()
            keys, vectors = part.column(0).combine_chunks(), part.column(1).combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([lists, pa.array([np.asarray(vectors.flatten(), np.float64).tobytes()], pa.binary())], names=["keys", "vectors"])


def _nearest(k: int):
    """The k nearest of each row of a block among those of another; of equal distances the first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                block, other = batch.column("block")[i].as_py(), batch.column("other")[i].as_py()
                keys, others = batch.column("keys")[i].values, batch.column("other_keys")[i].values
                x = np.frombuffer(batch.column("vectors")[i].as_py()).reshape(len(keys), -1)
                y = np.frombuffer(batch.column("other_vectors")[i].as_py()).reshape(len(others), -1)
                d = np.zeros((len(x), len(y)))
                for c in range(x.shape[1]):
                    d += (x[:, c, None] - y[None, :, c]) ** 2
                if block == other:
                    np.fill_diagonal(d, np.inf)
                if d.shape[1] > k:
                    r, c = np.nonzero((d <= np.partition(d, k - 1, axis=1)[:, k - 1, None]) & np.isfinite(d))
                else:
                    r, c = np.nonzero(np.isfinite(d))
                order = np.lexsort((c, d[r, c], r))
                r, c = r[order], c[order]
                kept = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c = r[kept], c[kept]
                vectors = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), block), pa.int64()), pa.array(r, pa.int32()), keys.take(pa.array(r)), vectors(x[r]), pa.array(np.full(len(r), other), pa.int64()), pa.array(c, pa.int32()), others.take(pa.array(c)), vectors(y[c]), pa.array(d[r, c])],
                    names=["block", "place", "key", "x", "other", "other_place", "other_key", "y", "d"],
                )

    return run


def nearest_rows(df: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """(block, place, key, x, other_key, y, rank): the k nearest other rows of each row by Euclidean distance, ties by key.

    The search is exact: every block of rows meets every block, k are kept of each meeting and merged. ``block`` and
    ``place`` name a row, so keys may be null or repeat. Rows with a null or non-finite number take no part.
    """
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(key).alias("key"), vector.alias("v")).where(F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
    kind = df.schema[key].dataType.simpleString()
    # both sides of the meetings have to name rows alike
    blocks = rows.mapInArrow(_packed, f"keys array<{kind}>, vectors binary").withColumn("block", F.monotonically_increasing_id()).persist()
    salts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    others = blocks.select(F.col("block").alias("other"), F.col("keys").alias("other_keys"), F.col("vectors").alias("other_vectors"), F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    met = others.join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "salt").drop("salt")
    near = met.mapInArrow(_nearest(k), f"block long, place int, key {kind}, x array<double>, other long, other_place int, other_key {kind}, y array<double>, d double")
    order = Window.partitionBy("block", "place").orderBy("d", "other_key", "other", "other_place")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("other", "other_place", "d")


def smote(df: DataFrame, key: str, columns: list[str], target: str, minority, percent: int = 100, k: int = 5, seed: int = 1) -> DataFrame:
    """``df`` and, for each minority row, percent / 100 rows between it and one of its k nearest of the class.

    Each row with another of its class gets all its rows; neighbours are the exact ones of ``nearest_rows``.
    """
    near = nearest_rows(df.where(F.col(target) == F.lit(minority)), key, columns, k)
    copies = max(1, percent // 100)
    near = near.withColumn("_n", F.max("rank").over(Window.partitionBy("block", "place")))
    picked = near.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    pick = picked.where(F.col("rank") == F.pmod(F.xxhash64(F.lit(seed), "key", "_copy"), F.col("_n")) + 1)
    at = F.pmod(F.xxhash64(F.lit(seed + 1), "key", "_copy"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    new = pick.select(F.lit(None).cast(df.schema[key].dataType).alias(key), *[(F.col("x")[i] + at * (F.col("y")[i] - F.col("x")[i])).alias(c) for i, c in enumerate(columns)], F.lit(minority).alias(target))
    return df.unionByName(new, allowMissingColumns=True)
