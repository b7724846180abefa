"""Nearest-neighbour classifiers: scores of query rows against a training table.

Queries meet the training rows near them in blocks; only the k most similar of each are kept, and every class score is an
aggregation over them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.degrees import IMPLICATORS, T_NORMS, quantifier
from .columns import statistics
from .meetings import closest, placed

#: Rows in a block.
BLOCK = 512


def _similarity(spread: list[float]):
    """The mean similarity of rows by their vectors, and the greatest that differences by column allow."""

    def exact(x, y):
        total = np.zeros((len(x), len(y)))
        for c, width in enumerate(spread):
            part = np.maximum(0.0, 1 - np.abs(y[None, :, c] - x[:, c, None]) / width)
            total += np.where(np.isnan(part), 1.0, part)
        return total / len(spread)

    return exact, lambda least, most: np.maximum(0.0, 1 - least / np.array(spread)).mean(1)


def nearest(train: DataFrame, queries: DataFrame, key: str, columns: list[str], target: str, k: int = 10) -> DataFrame:
    """(query, key, target, sim, r): the k most similar training rows, the query's own id left out; ties to smaller ids.

    Similarity is the mean over attributes of 1 - |difference| / range; a null attribute counts as similar. Rows with a null
    key, and training rows with a null target, take no part. A block of queries meets the blocks of training rows that can
    hold one of its rows' nearest.
    """
    if k < 1:
        raise ValueError("k has to be at least 1")
    s = statistics(train, columns)
    spread = [float((s[c]["max"] or 0) - (s[c]["min"] or 0)) or 1.0 for c in columns]
    # a target may be a key or an attribute too
    named = train.where(F.col(target).isNotNull() & F.col(key).isNotNull())
    asked = placed(queries.where(F.col(key).isNotNull()).withColumn("query", F.col(key)), ["query"], columns, BLOCK)
    found = closest(asked, placed(named, [key, target], columns, BLOCK), ["query"], [key, target], *_similarity(spread), k=k, key=("query", key)).withColumnRenamed("_close", "sim")
    order = Window.partitionBy("query").orderBy(F.col("sim").desc(), key)
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def fuzzy_nn(neighbours: DataFrame, target: str) -> DataFrame:
    """(query, class, score): share of the similarity that each class has."""
    total = neighbours.groupBy("query").agg(F.sum("sim").alias("all"))
    per = neighbours.groupBy("query", F.col(target).alias("class")).agg(F.sum("sim").alias("s"))
    return per.join(total, "query").select("query", "class", F.when(F.col("all") > 0, F.col("s") / F.col("all")).otherwise(0.0).alias("score"))


def _by_class(neighbours: DataFrame, target: str) -> DataFrame:
    top = neighbours.groupBy("query").agg(F.max("sim").alias("top"))
    classes = neighbours.select("query", F.col(target).alias("class")).distinct()
    w = F.when(F.col("top") > 0, F.col("sim") / F.col("top")).otherwise(0.0)
    return neighbours.join(top, "query").select("query", target, w.alias("w")).join(classes, "query").withColumn("d", (F.col(target) == F.col("class")).cast("double"))


def fuzzy_rough_nn(neighbours: DataFrame, target: str, implicator: str = "kleene_dienes", norm: str = "min", mean: bool = False) -> DataFrame:
    """(query, class, score): mean of lower and upper approximation over the neighbours; averages instead of min/max if asked."""
    low, high = IMPLICATORS[implicator](F.col("w"), F.col("d")), T_NORMS[norm](F.col("w"), F.col("d"))
    per = _by_class(neighbours, target).groupBy("query", "class").agg((F.avg(low) if mean else F.min(low)).alias("lower"), (F.avg(high) if mean else F.max(high)).alias("upper"))
    return per.select("query", "class", ((F.col("lower") + F.col("upper")) / 2).alias("score"))


def vague_quantifier_nn(neighbours: DataFrame, target: str, alpha: float = 0.2, beta: float = 1.0) -> DataFrame:
    per = _by_class(neighbours, target).groupBy("query", "class").agg((F.sum(F.least("w", "d")) / F.sum("w")).alias("r"))
    return per.select("query", "class", ((quantifier(F.col("r"), 0.1, 0.6) + quantifier(F.col("r"), alpha, beta)) / 2).alias("score"))


def owa_nn(neighbours: DataFrame, target: str, alpha: float = 0.2, beta: float = 1.0, implicator: str = "kleene_dienes", norm: str = "min") -> DataFrame:
    """(query, class, score): mean of ordered weighted averages, of the implications by 'most' and of the norms by 'some'.

    The i-th largest of n weighs q(i / n) - q((i - 1) / n) for the quantifier q.
    """
    per = _by_class(neighbours, target)
    parts = {"lower": (IMPLICATORS[implicator](F.col("w"), F.col("d")), alpha, beta), "upper": (T_NORMS[norm](F.col("w"), F.col("d")), 0.1, 0.6)}
    n, sums = F.count(F.lit(1)).over(Window.partitionBy("query", "class")), []
    for name, (value, a, b) in parts.items():
        i = F.row_number().over(Window.partitionBy("query", "class").orderBy(value.desc()))
        per = per.withColumn(name, value * (quantifier(i / n, a, b) - quantifier((i - 1) / n, a, b)))
        sums.append(F.sum(name))
    return per.groupBy("query", "class").agg(((sums[0] + sums[1]) / 2).alias("score"))


def ownership_nn(neighbours: DataFrame, target: str, k: int, m: float = 2.0) -> DataFrame:
    """(query, class, score): sum of exp(-(1 / sim) ** (1 / (m - 1))) / k."""
    part = F.when(F.col("sim") > 0, F.exp(-F.pow(1 / F.col("sim"), F.lit(1 / (m - 1))))).otherwise(0.0)
    return neighbours.groupBy("query", F.col(target).alias("class")).agg((F.sum(part) / k).alias("score"))


def winners(scores: DataFrame) -> DataFrame:
    """(query, class) of the highest score, ties to the smaller class."""
    return scores.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("class"))).alias("x")).select("query", F.col("x.class").alias("class"))
