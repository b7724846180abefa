"""Graded dependency measures of a class on numeric attributes.

Rows of equal values and class are one, with a weight. For a crisp class the lower approximation of a row is the
implication of its greatest similarity to a row of another class, 0; with one attribute that is its nearest enemy by
value, found by windows over the distinct values alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import similarities
from ..functions.degrees import IMPLICATORS, SIMILARITIES, quantifier
from .columns import statistics
from .meetings import BLOCK, closest, packed, placed, same, vectors
from .staging import cut

#: Rows of a block that are compared with the other block at once.
STRIP = 64


def collapsed(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Distinct (columns, target) with their number of rows ``_w``; rows without a class are left out."""
    return df.where(F.col(target).isNotNull()).groupBy(*columns, target).agg(F.count(F.lit(1)).alias("_w"))


def lower_memberships_1d(df: DataFrame, column: str, target: str, similarity: str = "linear", implicator: str = "lukasiewicz") -> DataFrame:
    """(column, target, _w, lower) of each distinct pair: nearest other-class values on both sides by windows."""
    s = statistics(df, [column])[column]
    rows = collapsed(df, [column], target).where(F.col(column).isNotNull())
    per_value = rows.groupBy(column).agg(F.min(target).alias("c0"), F.max(target).alias("c1"), F.count(F.lit(1)).alias("k"))
    w = Window.orderBy(column)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    # a value of one class is an enemy of other classes; one of several, of all
    change = F.struct(F.col(column).alias("v"), "c0", "c1")
    last = per_value.withColumn("p", F.max(change).over(back)).withColumn("q", F.min(change).over(ahead))
    alone = F.when((F.col("c0") == F.col("c1")), F.col("c0"))
    run = F.sum(F.when(F.lag(alone).over(w).eqNullSafe(alone) & alone.isNotNull(), 0).otherwise(1)).over(w)
    runs = last.withColumn("run", run).groupBy("run").agg(F.min(column).alias("a"), F.max(column).alias("b"), F.min("c0").alias("rc"))
    edge = Window.orderBy("run")
    runs = runs.select("run", F.lag("b").over(edge).alias("below"), F.lead("a").over(edge).alias("above"))
    near = last.withColumn("run", run).join(runs, "run").select(column, "k", "below", "above")
    x = rows.join(near, column)
    sim = lambda y: F.coalesce(SIMILARITIES[similarity](F.col(column), y, s), F.lit(0.0))
    best = F.when(F.col("k") > 1, F.lit(1.0)).otherwise(F.greatest(sim(F.col("below")), sim(F.col("above"))))
    return x.select(column, target, "_w", IMPLICATORS[implicator](best, F.lit(0.0)).alias("lower"))


def class_similarities(df: DataFrame, columns: list[str], target: str, similarity: str = "linear", norm: str = "lukasiewicz", parts: tuple[str, ...] = ("near", "total", "some")) -> DataFrame:
    """(x, wx, cx, cy, near, total, some, n): of each distinct row ``x`` and each class the greatest similarity to the class's
    rows, and the sums of their similarities, of those that have any, and of all by their weights; itself is one of them.

    Rows of equal values and class are one of weight ``wx``. Every block of them meets every other, as sums need all; a block's
    sums stay in its task until it has met all, so what leaves it is a row for each row and class. ``parts`` are those that are
    wanted, the others null. A null attribute is similar to all; rows without a class are left out.
    """
    s = statistics(df, columns)
    stats = [s[c] for c in columns]
    key = F.to_json(F.struct(*columns, target), {"ignoreNullFields": "false"})
    rows = collapsed(df, columns, target).select(key.alias("x"), F.col("_w").alias("wx"), F.col(target).alias("cx"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    places = [f"_{i}" for i in range(len(columns))]
    kind = rows.schema["cx"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        own, found = None, {}

        def out():
            x, wx, cx = own[1:4]
            for label, sums in found.items():
                values = [pa.array(sums[c]) if c in sums else pa.nulls(len(x), pa.float64()) for c in ("near", "total", "some")]
                yield pa.RecordBatch.from_arrays([x, wx, cx, pa.array([label] * len(x), cx.type), *values, pa.array(np.full(len(x), sums["n"]))], names=["x", "wx", "cx", "cy", "near", "total", "some", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("q__block")[i].as_py()
                if own is None or own[0] != block:
                    if own is not None:
                        yield from out()
                    own, found = [block, *(batch.column(c)[i].values for c in ("q_x", "q_wx", "q_cx")), vectors(batch, "q_vectors", i, len(stats))], {}
                b, weight, cy = vectors(batch, "vectors", i, len(stats)), batch.column("wx")[i].values.to_numpy().astype(float), batch.column("cx")[i].values
                labels = cy.unique()
                member = same(cy, labels)
                order = np.argsort(member.argmax(1), kind="stable")
                member, weight, b = member[order], weight[order], b[order]
                starts, heavy = np.searchsorted(member.argmax(1), np.arange(len(labels))), member * weight[:, None]
                n = heavy.sum(0)
                for at in range(0, len(own[4]), STRIP):
                    sim = similarities(own[4][at : at + STRIP], b, similarity, norm, stats)
                    new = {}
                    if "near" in parts:
                        new["near"] = np.maximum.reduceat(sim, starts, axis=1)
                    if "total" in parts:
                        new["total"] = sim @ heavy
                    if "some" in parts:
                        new["some"] = (sim > 0).astype(float) @ heavy
                    for j, label in enumerate(labels.to_pylist()):
                        sums = found.setdefault(label, {"n": 0.0, **{c: np.zeros(len(own[4])) if c != "near" else np.full(len(own[4]), -np.inf) for c in new}})
                        for c, v in new.items():
                            here = sums[c][at : at + STRIP]
                            np.maximum(here, v[:, j], out=here) if c == "near" else np.add(here, v[:, j], out=here)
                for j, label in enumerate(labels.to_pylist()):
                    found[label]["n"] += n[j]
        if own is not None:
            yield from out()

    tasks = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    asked = cut(packed(rows, ["x", "wx", "cx"], places, "q_", min(BLOCK, 512)).withColumn("q__block", F.monotonically_increasing_id()))
    pairs = asked.hint("shuffle_replicate_nl").crossJoin(packed(rows, ["wx", "cx"], places)).repartition(tasks, "q__block").sortWithinPartitions("q__block")
    return pairs.mapInArrow(run, f"x string, wx long, cx {kind}, cy {kind}, near double, total double, some double, n double")


def _near(df: DataFrame, columns: list[str], target: str, similarity: str, norm: str, relation: str) -> DataFrame:
    """(x, wx, cx, cy, near): of each distinct row its greatest similarity to ``each`` class, or to an ``enemy``."""
    s = statistics(df, columns)
    stats, places = [s[c] for c in columns], [f"_{i}" for i in range(len(columns))]
    key = F.to_json(F.struct(*columns, target), {"ignoreNullFields": "false"})
    rows = collapsed(df, columns, target).select(key.alias("x"), F.col("_w").alias("wx"), F.col(target).alias("cx"), *[F.col(c).cast("double").alias(p) for c, p in zip(columns, places)])
    blocks = placed(rows, ["x", "wx", "cx"], places, 512, "cx")
    exact = lambda x, y: similarities(x, y, similarity, norm, stats)
    if similarity == "squared":  # grows with the difference
        bound = lambda least, most: np.full(len(least), np.inf)
    else:
        bound = lambda least, most: _of_gaps(least, similarity, norm, stats)
    there = blocks.select("_block", "_low", "_high", "_holes", "_kinds", "_counts", F.col("cx").alias("cy"), "_vectors")
    return closest(blocks, there, ["x", "wx", "cx"], ["cy"], exact, bound, relation=relation, by=("cx", "cy")).withColumnRenamed("_close", "near")


def _of_gaps(gaps: np.ndarray, similarity: str, norm: str, stats: list[dict]) -> np.ndarray:
    return similarities(np.zeros((1, len(stats))), gaps, similarity, norm, stats)[0]


def class_nearest(df: DataFrame, columns: list[str], target: str, similarity: str = "linear", norm: str = "lukasiewicz") -> DataFrame:
    """(x, wx, cx, cy, near) of ``class_similarities``, of blocks alone that can hold a nearest row."""
    return _near(df, columns, target, similarity, norm, "each")


def enemies(df: DataFrame, columns: list[str], target: str, similarity: str = "linear", norm: str = "lukasiewicz") -> DataFrame:
    """(wx, near): of each distinct row its greatest similarity to a row of another class, null without any."""
    found = _near(df, columns, target, similarity, norm, "enemy").select("wx", "near")
    # without any there is one class
    rows = collapsed(df, columns, target)
    return found if not found.isEmpty() else rows.select(F.col("_w").alias("wx"), F.lit(None).cast("double").alias("near"))


def gamma(df: DataFrame, columns: list[str], target: str, similarity: str = "linear", norm: str = "lukasiewicz", implicator: str = "lukasiewicz") -> DataFrame:
    """(gamma, delta): mean and least lower membership of all rows."""
    if len(columns) == 1:
        m = lower_memberships_1d(df, columns[0], target, similarity, implicator).select(F.col("_w").alias("wx"), "lower")
    else:
        near = _near(df, columns, target, similarity, norm, "enemy")
        m = near.select("wx", IMPLICATORS[implicator](F.col("near"), F.lit(0.0)).alias("lower"))
    return m.agg((F.sum(F.col("lower") * F.col("wx")) / F.sum("wx")).alias("gamma"), F.min("lower").alias("delta"))


def vqrs(df: DataFrame, columns: list[str], target: str, similarity: str = "linear", norm: str = "lukasiewicz", alpha: float = 0.2, beta: float = 1.0) -> DataFrame:
    """(vqrs): mean of the quantified share of a row's similarity that lies in its own class."""
    table = class_similarities(df, columns, target, similarity, norm, ("total",))
    share = table.groupBy("x", "wx").agg((F.sum(F.when(F.col("cx") == F.col("cy"), F.col("total")).otherwise(0.0)) / F.sum("total")).alias("r"))
    return share.agg((F.sum(quantifier(F.col("r"), alpha, beta) * F.col("wx")) / F.sum("wx")).alias("vqrs"))


def discernibility(df: DataFrame, columns: list[str], target: str, similarity: str = "linear", norm: str = "lukasiewicz", implicator: str = "lukasiewicz") -> DataFrame:
    """(discernibility): mean over pairs of rows of the implication of similarity by sameness of class."""
    n = df.where(F.col(target).isNotNull()).count()
    # what the implication of 0 lacks of 1: the similarity itself or, for the residual ones, whether there is any
    lack = "some" if implicator in ("goedel", "gaines") else "total"
    others = class_similarities(df, columns, target, similarity, norm, (lack,)).where("cx <> cy")
    lost = others.agg(F.sum(F.col(lack) * F.col("wx")).alias("s"))
    return lost.select((1 - F.coalesce(F.col("s"), F.lit(0.0)) / F.lit(float(max(1, n) * max(1, n - 1)))).alias("discernibility"))


def granularity(df: DataFrame, columns: list[str], target: str, similarity: str = "linear", norm: str = "lukasiewicz") -> DataFrame:
    table = class_similarities(df, columns, target, similarity, norm, ("total",))
    return table.agg((F.sum(F.col("total") * F.col("wx")) / F.sum(F.col("n") * F.col("wx"))).alias("granularity"))
