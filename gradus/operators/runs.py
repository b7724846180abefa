"""Experiments: every scheme on every data set, run after run, into a table of results that can be taken up again.

A definition is data: data sets by name, schemes by name, a producer and its numbers, saved as JSON. Each (data set, scheme,
run) is one Spark job that counts all its folds and appends their rows in one commit, so what a stopped run has left is
whole; ``run`` skips what the table has. Rows are (dataset, scheme, run, fold, size, ..measures), which
``experiments.averaged``, ``paired`` and the rank tests take.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluation as E
from .rows import resample
from .staging import cut

#: Schemes by the name that a definition has for them; add to it what else a definition may name.
SCHEMES: dict[str, E.Scheme] = {"naive_bayes": E.naive_bayes, "majority": E.majority}
PRODUCERS = ("cross_validation", "random_split", "test_set", "learning_rate")


@dataclass
class Definition:
    """What an experiment runs.

    A data set has ``table`` (and ``test``, a table of other keys, for ``test_set``), ``key``, ``target`` and ``columns``.
    ``cross_validation`` deals out ``folds``; ``random_split`` trains on ``percent`` of each class; ``learning_rate``
    cross-validates on random rows, ``step`` more each time from ``lower`` to ``upper`` (None: all rows). Runs go from
    ``first`` to ``last`` and are the seeds of their draws. ``numeric`` targets are measured by errors.
    """

    datasets: dict[str, dict]
    schemes: list[str]
    producer: str = "cross_validation"
    first: int = 1
    last: int = 10
    folds: int = 10
    percent: float = 66.0
    lower: int = 0
    step: int = 10
    upper: int | None = None
    numeric: bool = False
    notes: str = ""
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.producer not in PRODUCERS:
            raise ValueError(f"{self.producer} is none of {', '.join(PRODUCERS)}")
        if unknown := [s for s in self.schemes if s not in SCHEMES]:
            raise ValueError(f"no scheme {', '.join(unknown)}")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "definition string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Definition:
        return Definition(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


def _measured(definition: Definition, rows: DataFrame, data: dict, scheme: str) -> DataFrame:
    """Measures of each fold that is looked at, and the size of its training rows."""
    found = E.predictions(rows, data["key"], data["columns"], data["target"], SCHEMES[scheme])
    if definition.producer in ("random_split", "test_set"):
        size = rows.agg(F.count_if(F.col("_fold") == 0).alias("size"))
        out = (E.number_measures if definition.numeric else E.class_measures)(found.where("_fold = 1"), ["_fold"])
        return out.crossJoin(F.broadcast(size)).withColumnRenamed("_fold", "fold")
    out = (E.number_measures if definition.numeric else E.class_measures)(found, ["_fold"])
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    return out.crossJoin(F.broadcast(total)).withColumn("size", F.col("_total") - F.col("n")).drop("_total").withColumnRenamed("_fold", "fold")


def one_run(definition: Definition, read: Callable[[str], DataFrame], dataset: str, scheme: str, run: int) -> DataFrame:
    """The result rows of one scheme on one data set in one run."""
    data = definition.datasets[dataset]
    df = read(data["table"]).select(data["key"], data["target"], *data["columns"])
    key, target = data["key"], data["target"]
    # a scheme reads its rows many times, so the draws are staged
    if definition.producer == "cross_validation":
        parts = [_measured(definition, cut(E.with_folds(df, key, target, definition.folds, run)), data, scheme)]
    elif definition.producer == "random_split":
        parts = [_measured(definition, cut(E.with_split(df, key, target, definition.percent, run)), data, scheme)]
    elif definition.producer == "test_set":
        rows = [d.where(F.col(target).isNotNull()).withColumn("_fold", F.lit(i)) for i, d in enumerate((df, read(data["test"]).select(df.columns)))]
        parts = [_measured(definition, rows[0].unionByName(rows[1]), data, scheme)]
    else:
        known = df.where(F.col(target).isNotNull())
        n = known.count()
        top = min(n, definition.upper) if definition.upper is not None else n
        sizes = range(definition.lower or definition.step, top + 1, definition.step)
        parts = [_measured(definition, cut(E.with_folds(resample(known, key, size, run), key, target, definition.folds, run)), data, scheme).withColumn("total", F.lit(size)) for size in sizes]
        if not parts:
            raise ValueError(f"{dataset} has fewer rows than the first size")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    first = ["dataset", "scheme", "run", "fold"]
    out = out.select(F.lit(dataset).alias("dataset"), F.lit(scheme).alias("scheme"), F.lit(run).alias("run"), "*")
    return out.select(*first, *[c for c in out.columns if c not in first])


def _keys(definition: Definition) -> list[tuple[str, str, int]]:
    return [(d, s, r) for r in range(definition.first, definition.last + 1) for d in definition.datasets for s in definition.schemes]


def results(definition: Definition, read: Callable[[str], DataFrame]) -> DataFrame:
    """All result rows, not stored."""
    out = None
    for key in _keys(definition):
        rows = one_run(definition, read, *key)
        out = rows if out is None else out.unionByName(rows)
    return out


def stored(spark: SparkSession, path: str) -> set[tuple[str, str, int]]:
    """The (dataset, scheme, run) that the table at ``path`` has; none if there is no table."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    return {tuple(r) for r in table.select("dataset", "scheme", "run").distinct().collect()}


def run(spark: SparkSession, definition: Definition, path: str, read: Callable[[str], DataFrame] | None = None, most: int | None = None) -> int:
    """Appends what the table at ``path`` lacks of the definition (at most ``most`` runs) and returns how many runs that were."""
    read = read or spark.read.parquet
    have = stored(spark, path)
    todo = [k for k in _keys(definition) if k not in have][:most]
    for key in todo:
        one_run(definition, read, *key).write.mode("append").parquet(path)
    return len(todo)
