"""Evaluation of classifiers by folds and splits, and of attribute subsets by it (wrappers).

A *scheme* is a function (rows, key, columns, target) -> DataFrame (key, predicted), where ``rows`` have ``_fold``: a row
is predicted by a model of the rows of all other folds; rows without a fold are predicted by a model of all rows and are
in no other model's way. So cross-validation is one call, a split two folds of which one is looked at, and evaluation on
the training rows a call without folds. ``naive_bayes`` and ``majority`` count all folds at once; ``ml_scheme`` fits an
estimator of ``pyspark.ml`` for each fold, folds in parallel.

Keys have to be unique. Draws are digests of the key, so reruns agree. Rows without a class take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import ranked_in_class
from .selection import memoised

Scheme = Callable[[DataFrame, str, list[str], str], DataFrame]
#: Digits to which scores are compared, so that sums in another order agree.
DIGITS = 9


def with_folds(df: DataFrame, key: str, target: str, n: int, seed: int = 1) -> DataFrame:
    """``df`` with ``_fold`` from 1 to ``n``, dealt in turn within each class in a random order; rows without a class go."""
    known = df.where(F.col(target).isNotNull())
    return ranked_in_class(known, key, target, seed).withColumn("_fold", ((F.col("_r") - 1) % n + 1).cast("int")).drop("_r")


def with_split(df: DataFrame, key: str, target: str, percent: float, seed: int = 1) -> DataFrame:
    """``df`` with ``_fold`` 0 for the first round(percent%) of each class in a random order (training rows) and 1 for the rest."""
    known = df.where(F.col(target).isNotNull())
    size = known.groupBy(F.col(target).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked_in_class(known, key, target, seed).join(size, F.col(target) == F.col("_t"))
    return rows.withColumn("_fold", (F.col("_r") > F.floor(F.col("_n") * percent / 100 + 0.5)).cast("int")).drop("_r", "_t", "_n")


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by ``on`` in which null equals null; columns of ``b`` outside ``on`` are added."""
    same = reduce(lambda x, y: x & y, [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in on])
    more = [c for c in b.columns if c not in on and c not in a.columns]
    return a.alias("_a").join(b.alias("_b"), same, how).select(*[F.col(f"_a.{c}") for c in a.columns], *[F.col(f"_b.{c}") for c in more])


def _classes(rows: DataFrame, target: str) -> list:
    """The classes in order; they are few, as each is a column of a model."""
    return [r[0] for r in rows.select(target).distinct().orderBy(target).collect()]


def _counts(rows: DataFrame, target: str, classes: list, by: list[str]) -> DataFrame:
    """Rows of each class, ``_n0`` and so on, by ``by``."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(target) == F.lit(c)).alias(f"_n{i}") for i, c in enumerate(classes)])


def _without_own(counts: DataFrame, total: DataFrame, by: list[str], n: int) -> DataFrame:
    """``counts`` by ``by`` and fold as ``_m0`` and so on: what a model without the fold has, ``total`` by ``by`` less the fold's own."""
    total = total.select(*by, *[F.col(f"_n{i}").alias(f"_t{i}") for i in range(n)])
    both = _joined(counts, total, by) if by else counts.crossJoin(F.broadcast(total))
    own = lambda i: F.when(F.col("_fold").isNull(), 0).otherwise(F.col(f"_n{i}"))
    return both.select(*[c for c in counts.columns if not c.startswith("_n")], *[(F.col(f"_t{i}") - own(i)).alias(f"_m{i}") for i in range(n)])


def _summed(counts: DataFrame, by: list[str], n: int) -> DataFrame:
    return counts.groupBy(*by).agg(*[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(n)])


def _priors(rows: DataFrame, target: str, classes: list) -> DataFrame:
    """(_fold, _m0, ..): rows of each class in each fold's model."""
    own = _counts(rows, target, classes, ["_fold"])
    return _without_own(own, _summed(own, [], len(classes)), [], len(classes))


def _first_best(scores: list, classes: list):
    """The class of the highest score, of ties the smaller."""
    return F.array_min(F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (s, c) in enumerate(zip(scores, classes))]))["c"]


def majority(rows: DataFrame, key: str, columns: list[str], target: str) -> DataFrame:
    """The most frequent class of the other folds (of ties the smaller)."""
    classes = _classes(rows, target)
    if not classes:
        return rows.select(key, F.col(target).alias("predicted"))
    found = _first_best([F.col(f"_m{i}") for i in range(len(classes))], classes)
    return _joined(rows.select(key, "_fold"), _priors(rows, target, classes), ["_fold"]).select(key, found.alias("predicted"))


def bayes_votes(rows: DataFrame, key: str, columns: list[str], target: str, classes: list) -> DataFrame:
    """(key, _prior, _v0, ..): for each row the log prior of each class and, for each column, the log likelihoods of its label.

    All folds' models come from one count of (column, label, fold) by class: a fold's model is the total less its own.
    Rows meet the labels' likelihoods, not each other. A column's entry is null where its label is.
    """
    n = len(classes)
    m = [F.col(f"_m{i}") for i in range(n)]
    prior = _priors(rows, target, classes)
    prior = prior.select("_fold", F.array(*[F.ln((x + 1) / (sum(m) + n)) for x in m]).alias("_prior"))
    base = _joined(rows.select(key, "_fold"), prior, ["_fold"])
    if not columns:
        return base.drop("_fold")
    cells = F.array(*[F.struct(F.lit(i).alias("_column"), F.col(c).cast("string").alias("_label")) for i, c in enumerate(columns)])
    long = rows.select(key, "_fold", F.col(target).alias("_class"), F.explode(cells).alias("_x")).select(key, "_fold", "_class", "_x._column", "_x._label").where("_label is not null")
    own = _counts(long, "_class", classes, ["_column", "_label", "_fold"])
    of_label = _summed(own, ["_column", "_label"], n)
    of_column = _summed(own, ["_column", "_fold"], n)
    # columns times folds
    size = _without_own(of_column, _summed(of_column, ["_column"], n), ["_column"], n).join(of_label.groupBy("_column").agg(F.count(F.lit(1)).alias("_labels")), "_column")
    size = size.select("_column", "_fold", F.array(*[x + F.col("_labels") for x in m]).alias("_size"))
    cell = _joined(_without_own(own, of_label, ["_column", "_label"], n), size, ["_column", "_fold"])
    cell = cell.select("_column", "_label", "_fold", F.array(*[F.ln((x + 1) / F.col("_size")[i]) for i, x in enumerate(m)]).alias("_v"))
    met = _joined(long.select(key, "_fold", "_column", "_label"), cell, ["_column", "_label", "_fold"])
    votes = met.groupBy(key).agg(*[F.max(F.when(F.col("_column") == i, F.col("_v"))).alias(f"_v{i}") for i in range(len(columns))])
    return _joined(base.drop("_fold"), votes, [key], "left")


def _decided(votes: DataFrame, key: str, places: list[int], classes: list) -> DataFrame:
    total = [F.round(sum((F.coalesce(F.col(f"_v{j}")[i], F.lit(0.0)) for j in places), F.col("_prior")[i]), DIGITS) for i in range(len(classes))]
    return votes.select(key, _first_best(total, classes).alias("predicted"))


def naive_bayes(rows: DataFrame, key: str, columns: list[str], target: str) -> DataFrame:
    """Bayes' rule with independent labels, counts raised by one; numbers count as labels, so cut them before. Nulls are passed over."""
    classes = _classes(rows, target)
    if not classes:
        return rows.select(key, F.col(target).alias("predicted"))
    return _decided(bayes_votes(rows, key, columns, target, classes), key, list(range(len(columns))), classes)


def prepared(scheme: Scheme, rows: DataFrame, key: str, columns: list[str], target: str) -> Callable[[list[str]], DataFrame]:
    """The scheme's (key, predicted) by subset of ``columns``. Bayes' votes of all columns are kept, so a subset is a sum over
    them; what it then has, ``release`` lets go."""
    if scheme is not naive_bayes:
        return lambda subset: scheme(rows, key, subset, target)
    classes = _classes(rows, target)
    if not classes:
        return lambda subset: naive_bayes(rows, key, subset, target)
    votes = bayes_votes(rows, key, columns, target, classes).persist()

    def by_subset(subset: list[str]) -> DataFrame:
        return _decided(votes, key, [columns.index(c) for c in subset], classes)

    by_subset.release = votes.unpersist
    return by_subset


def _release(*parts: Callable) -> Callable[[], None]:
    def release() -> None:
        for part in parts:
            if hasattr(part, "release"):
                part.release()

    return release


def ml_scheme(estimator: Callable[[], object], numeric_target: bool = False, parallel: int = 4) -> Scheme:
    """A scheme of an estimator of ``pyspark.ml`` (features ``features``, label ``label``) over numeric columns.

    A model is fitted for each fold, ``parallel`` at a time. Rows with a null among the columns are left to the majority
    class (or, of a numeric target, to no prediction). Without columns a class target gets the majority as well.
    """
    from pyspark.ml.feature import VectorAssembler

    def scheme(rows: DataFrame, key: str, columns: list[str], target: str) -> DataFrame:
        if not columns:
            return majority(rows, key, columns, target)
        labels = [] if numeric_target else _classes(rows, target)
        label = F.col(target).cast("double") if numeric_target else (F.array_position(F.array(*map(F.lit, labels)), F.col(target)) - 1).cast("double")
        ready = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(rows.select(key, "_fold", label.alias("label"), *columns)).select(key, "_fold", "label", "features")
        folds = [r[0] for r in rows.select("_fold").distinct().collect()]

        def one(fold):
            train = ready if fold is None else ready.where(F.col("_fold").isNull() | (F.col("_fold") != fold))
            test = ready.where(F.col("_fold").isNull() if fold is None else F.col("_fold") == fold)
            return estimator().fit(train).transform(test).select(key, "prediction")

        with ThreadPoolExecutor(parallel) as pool:
            parts = list(pool.map(one, folds))
        found = reduce(DataFrame.union, parts)
        if numeric_target:
            return found.select(key, F.col("prediction").alias("predicted"))
        named = found.select(F.col(key).alias("_key"), F.element_at(F.array(*map(F.lit, labels)), (F.col("prediction") + 1).cast("int")).alias("_named"))
        return majority(rows, key, columns, target).join(named, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("_named", "predicted").alias("predicted"))

    return scheme


def predictions(rows: DataFrame, key: str, columns: list[str], target: str, scheme: Scheme) -> DataFrame:
    """(key, _fold, actual, predicted) of the rows; ``rows`` have ``_fold``."""
    return _beside(rows, key, target, scheme(rows, key, columns, target))


def _beside(rows: DataFrame, key: str, target: str, found: DataFrame) -> DataFrame:
    found = found.withColumnRenamed(key, "_key")
    return rows.select(key, "_fold", F.col(target).alias("actual")).join(found, F.col(key) == F.col("_key"), "left").drop("_key")


def class_measures(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(.., n, correct, incorrect, unclassified, percent_correct, kappa, precision, recall, f_measure, mcc) of ``predictions``, from one table of confusions.

    Precision, recall (true positive rate), F-measure and Matthews correlation are means over the actual classes by their
    sizes, as is false_positive_rate; what is not defined (0 / 0) counts as 0.
    """
    by = list(by)
    cells = found.groupBy(*by, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(F.struct(F.col("actual").alias("c"), F.col("n").alias("a"), F.lit(0).alias("p"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("a"), F.col("n").alias("p"), F.lit(0).alias("t")))
    classes = cells.select(*by, F.explode(each).alias("x")).where("x.c is not null").groupBy(*by, "x.c").agg(*[F.sum(f"x.{k}").alias(k) for k in ("a", "p", "t")])
    whole = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("predicted").isNull(), F.col("n")).otherwise(0)).alias("unclassified"))
    rows = _joined(classes, whole, by) if by else classes.crossJoin(F.broadcast(whole))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    a, p, t, n = (F.col(c).cast("double") for c in ("a", "p", "t", "n"))
    tn = n - a - p + t
    parts = {"precision": share(t, p), "recall": share(t, a), "f_measure": share(2 * t, a + p), "false_positive_rate": share(p - t, n - a), "mcc": share(t * tn - (p - t) * (a - t), F.sqrt(a * p * (n - a) * (n - p)))}
    weighted = [(F.sum(a * v) / F.sum(a)).alias(k) for k, v in parts.items()]
    out = rows.groupBy(*by, "n", "unclassified").agg(F.sum("t").alias("correct"), F.sum(a * p).alias("_chance"), *weighted)
    chance = F.col("_chance") / (F.col("n") * F.col("n"))
    right = F.col("correct") / F.col("n")
    return out.select(*by, "n", "correct", (F.col("n") - F.col("correct") - F.col("unclassified")).alias("incorrect"), "unclassified", (100 * right).alias("percent_correct"), share(right - chance, 1 - chance).alias("kappa"), *parts)


def number_measures(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(.., n, mae, rmse, correlation) of ``predictions`` of numbers."""
    e = F.col("predicted") - F.col("actual")
    return found.groupBy(*by).agg(F.count("predicted").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("predicted", "actual").alias("correlation"))


#: Whether more is better, and where a measure is read.
MEASURES = {"accuracy": (True, "percent_correct"), "f_measure": (True, "f_measure"), "kappa": (True, "kappa"), "mcc": (True, "mcc"), "rmse": (False, "rmse"), "mae": (False, "mae"), "correlation": (True, "correlation")}


def merit_of(found: DataFrame, measure: str) -> float:
    """One number of ``predictions``, the higher the better: errors are negated, accuracy is a share."""
    more, column = MEASURES[measure]
    table = number_measures(found) if measure in ("rmse", "mae", "correlation") else class_measures(found)
    value = table.select(column).first()
    value = float(value[0]) if value and value[0] is not None else 0.0
    return (value / 100 if measure == "accuracy" else value) if more else -value


def wrapper_merit(df: DataFrame, key: str, columns: list[str], target: str, scheme: Scheme, folds: int = 5, threshold: float = 0.01, measure: str = "accuracy", seed: int = 1, most: int = 5) -> Callable[[frozenset], float]:
    """Merit of a subset of ``columns``: the mean over cross-validations of the scheme on it.

    Cross-validations, each with other folds, go on until their standard deviation is at most ``threshold`` times their
    mean, at least two and at most ``most``; a threshold below 0 takes one. For errors (``accuracy``'s is the error rate)
    it is the error's deviation that counts. The function remembers what it has found; its ``release`` lets go of
    what the scheme keeps between subsets.
    """
    known: dict[frozenset, float] = {}
    ready: list[tuple] = []

    def once(i: int, subset: frozenset) -> float:
        if i == len(ready):
            rows = with_folds(df.select(key, target, *columns), key, target, folds, seed + i)
            ready.append((rows, prepared(scheme, rows, key, columns, target)))
        rows, by_subset = ready[i]
        return merit_of(_beside(rows, key, target, by_subset([c for c in columns if c in subset])), measure)

    def merit(subset: frozenset) -> float:
        if subset not in known:
            values: list[float] = []
            for i in range(1 if threshold < 0 else most):
                values.append(once(i, subset))
                own = [1 - v if measure == "accuracy" else abs(v) for v in values]
                mean = sum(own) / len(own)
                spread = sqrt(sum((v - mean) ** 2 for v in own) / len(own))
                if len(values) > 1 and not spread > threshold * mean:
                    break
            known[subset] = sum(values) / len(values)
        return known[subset]

    merit.release = lambda: _release(*[by_subset for _, by_subset in ready])()
    return merit


def classifier_merit(df: DataFrame, key: str, columns: list[str], target: str, scheme: Scheme, percent: float | None = None, holdout: DataFrame | None = None, measure: str = "accuracy", seed: int = 1) -> Callable[[frozenset], float]:
    """Merit of a subset of ``columns`` on the training rows, on what a split of ``percent`` training rows leaves, or on a ``holdout`` table (of other keys)."""
    df = df.where(F.col(target).isNotNull()).select(key, target, *columns)
    if holdout is not None:
        rows = df.withColumn("_fold", F.lit(0)).unionByName(holdout.where(F.col(target).isNotNull()).select(df.columns).withColumn("_fold", F.lit(1)))
    else:
        rows = df.withColumn("_fold", F.lit(None).cast("int")) if percent is None else with_split(df, key, target, percent, seed)
    by_subset = prepared(scheme, rows, key, columns, target)

    def merit(subset: frozenset) -> float:
        found = _beside(rows, key, target, by_subset([c for c in columns if c in subset]))
        return merit_of(found if percent is None and holdout is None else found.where("_fold = 1"), measure)

    out = memoised(merit)
    out.release = _release(by_subset)
    return out


def attribute_merits(columns: list[str], merit: Callable[[frozenset], float], leave_out: bool = False) -> dict[str, float]:
    """What a column adds to the empty set, or takes from the full one when it is left out."""
    whole = frozenset(columns)
    if leave_out:
        return {c: merit(whole) - merit(whole - {c}) for c in columns}
    return {c: merit(frozenset([c])) - merit(frozenset()) for c in columns}
