"""Memberships in the leaves of decision trees.

Trees are those of ``pyspark.ml``, whose fits aggregate over the rows by level. Each leaf of each tree is a column of zeros and
ones; the long form has a row for each row and tree and doesn't widen with the trees.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import _classes


def fit_partition(df: DataFrame, columns: list[str], target: str, estimator=None):
    """A fitted tree or forest of numeric ``columns`` for the classes of ``target``; rows with a null among them are left out."""
    labels = _classes(df.where(F.col(target).isNotNull()), target)
    label = (F.array_position(F.array(*map(F.lit, labels)), F.col(target)) - 1).cast("double")
    rows = df.where(F.col(target).isNotNull()).select(label.alias("label"), *[F.col(c).cast("double") for c in columns])
    ready = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(rows)
    return (estimator or DecisionTreeClassifier(seed=1)).fit(ready)


def leaves(model) -> list[int]:
    """The number of leaves of each tree of a model."""
    trees = list(model.trees) if hasattr(model, "trees") else [model]
    return [(t.numNodes + 1) // 2 for t in trees]


def leaf_of(df: DataFrame, key: str, columns: list[str], model) -> DataFrame:
    """(key, tree, leaf): the leaf, from 0 from left to right, to which each tree leads a row; null where a column is."""
    rows = df.select(key, *[F.col(c).cast("double") for c in columns])
    known = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0
    ready = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(rows)
    from pyspark.ml.functions import vector_to_array

    # a single tree gives a number, a forest a vector
    found = model.copy().setLeafCol("_leaf").transform(ready)
    each = vector_to_array("_leaf") if hasattr(model, "trees") else F.array("_leaf")
    return found.select(key, known.alias("_known"), F.posexplode(each).alias("tree", "leaf")).select(key, "tree", F.when(F.col("_known"), F.col("leaf").cast("int")).alias("leaf"))


def partition_membership(df: DataFrame, key: str, columns: list[str], model) -> DataFrame:
    """(key, partition_0, ..): 1 for the leaves that hold a row, of all trees in turn, else 0; null where a column is. Keys have to be unique."""
    start, wide = 0, []
    for tree, n in enumerate(leaves(model)):
        wide += [F.max(F.when(F.col("tree") == tree, (F.col("leaf") == i).cast("int"))).alias(f"partition_{start + i}") for i in range(n)]
        start += n
    return leaf_of(df, key, columns, model).groupBy(key).agg(*wide)
