"""Filters of rows by graded memberships: lower approximations, undersampling, imputation, misclassified rows, clusters.

The lower approximation of a row (linear similarity, Lukasiewicz norm, crisp class) is 1 less its similarity to the
nearest row of another class. The search is exact: blocks of distinct rows meet the blocks that can hold a nearest row, and
what comes of it is one number for each row, never the pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import statistics
from .meetings import closest, placed
from .neighbours import fuzzy_nn, nearest, winners
from .ordering import numbered

#: Distinct rows in a block; a meeting takes a table of BLOCK by BLOCK numbers.
BLOCK = 1024


def _nearness(scale: list[float]):
    """The negative of the distance of rows by their vectors, and the nearest that differences by column allow."""

    def exact(x, y):
        far = np.zeros((len(x), len(y)))
        for c, width in enumerate(scale):
            far += np.nan_to_num(np.abs(x[:, c, None] - y[None, :, c])) / width
        return -far

    return exact, lambda least, most: -(least / np.array(scale)).sum(1)


def _vector(columns: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])


def with_lower(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``df`` with each row's membership in the lower approximation of its class in ``lower`` (replaced if there).

    A null attribute is similar to all; a row without a class has a null membership and is no row's enemy; without
    rows of another class it is 1. Columns ``_v`` and ``_label`` must not be there.
    """
    stats = statistics(df, columns)
    scale = [float((stats[c]["max"] or 0) - (stats[c]["min"] or 0)) or 1.0 for c in columns]
    places = [f"_{i}" for i in range(len(columns))]
    named = df.select(*[c for c in df.columns if c != "lower"]).withColumns({"_v": _vector(columns), "_label": F.col(target).cast("string")})
    rows = named.where(F.col("_label").isNotNull()).select("_v", "_label").distinct()
    rows = rows.select(F.col("_v").alias("there"), F.col("_label").alias("kind"), *[F.when(~F.isnan(F.col("_v")[i]), F.col("_v")[i]).alias(p) for i, p in enumerate(places)])
    blocks = placed(rows, ["there", "kind"], places, min(BLOCK, 512), "kind")
    near = closest(blocks, blocks.withColumnRenamed("kind", "c"), ["there", "kind"], [], *_nearness(scale), relation="enemy", by=("kind", "c"))
    near = near.select(F.col("there").alias("_v"), F.col("kind").alias("_label"), (1 + F.col("_close")).alias("near"))
    low = near.select("_v", "_label", (1 - F.greatest(F.lit(0.0), F.coalesce("near", F.lit(0.0)))).alias("lower"))
    # a class without enemies anywhere
    return named.join(low, ["_v", "_label"], "left").withColumn("lower", F.when(F.col("_label").isNotNull(), F.coalesce("lower", F.lit(1.0)))).drop("_v", "_label")


def undersample_safest(df: DataFrame, key: str, columns: list[str], target: str, majority, ratio: float = 1.0) -> DataFrame:
    """``df`` without the safest majority rows (greatest lower approximation, ties by the key's digest), so that ``ratio`` stay for each other row.

    Rows without a class stay and count for none. ``lower`` is added.
    """
    rows = with_lower(df, columns, target)
    big = F.col(target) == F.lit(majority)
    n = df.agg(F.count_if(big).alias("a"), F.count_if(~big).alias("b")).first()
    # memberships are equal to nine places, beyond which the order of additions tells
    safe = F.lpad(F.round(F.col("lower") * 1e9).cast("long").cast("string"), 10, "0")
    ranked = numbered(rows.where(big).withColumn("_safe", F.concat(safe, F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))), "_safe", "_no")
    return rows.where(~F.coalesce(big, F.lit(False))).unionByName(ranked.where(F.col("_no") <= int(ratio * n["b"])).select(*rows.columns))


def keep_boundary(df: DataFrame, columns: list[str], target: str, majority, threshold: float = 0.5) -> DataFrame:
    """``df`` without the majority rows whose lower approximation reaches the threshold; ``lower`` is added."""
    safe = (F.col(target) == F.lit(majority)) & (F.col("lower") >= threshold)
    return with_lower(df, columns, target).where(~F.coalesce(safe, F.lit(False)))


def impute(df: DataFrame, key: str, columns: list[str], column: str, k: int = 5) -> DataFrame:
    """``df`` with the nulls of a column filled from the k most similar rows that have it: the mean of numbers by
    similarity, of labels the one of most similarity. Keys have to be unique; with none known, nulls stay."""
    known, open_ = df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull())
    near = nearest(known, open_, key, columns, column, k)
    kind = df.schema[column].dataType
    if dict(df.dtypes)[column] in ("string", "boolean"):
        found = winners(fuzzy_nn(near, column)).select("query", F.col("class").alias("_found"))
    else:
        mean = F.when(F.sum("sim") > 0, F.sum(F.col("sim") * F.col(column)) / F.sum("sim")).otherwise(F.avg(column))
        found = near.groupBy("query").agg(mean.cast(kind).alias("_found"))
    out = df.join(found.withColumnRenamed("query", "_query"), F.col(key) == F.col("_query"), "left")
    return out.select(*[F.coalesce(c, "_found").alias(c) if c == column else F.col(c) for c in df.columns])


def add_classification(df: DataFrame, key: str, columns: list[str], target: str, k: int = 5) -> DataFrame:
    """``df`` with the class that the k most similar other rows give each row in ``classification``, and ``error`` (1 if
    it isn't the row's own, null if either is unknown). Keys have to be unique."""
    found = winners(fuzzy_nn(nearest(df, df, key, columns, target, k), target)).toDF("_query", "classification")
    out = df.join(found, F.col(key) == F.col("_query"), "left").drop("_query")
    return out.withColumn("error", (F.col("classification") != F.col(target)).cast("int"))


def remove_misclassified(df: DataFrame, key: str, columns: list[str], target: str, k: int = 5) -> DataFrame:
    """``df`` without the rows that their k most similar others give another class."""
    return add_classification(df, key, columns, target, k).where("error is null or error = 0").select(*df.columns)


def add_cluster(df: DataFrame, columns: list[str], k: int = 2, seed: int = 1) -> DataFrame:
    """``df`` with the number of the k-means cluster (from 0) in ``cluster``, fitted on its whole rows; null where a column is."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    whole = F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = VectorAssembler(inputCols=columns, outputCol="_vector", handleInvalid="keep").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol="cluster").fit(rows.where(whole))
    return model.transform(rows).withColumn("cluster", F.when(whole, F.col("cluster"))).drop("_vector")
