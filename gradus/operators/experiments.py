"""Results of experiments: averages, paired tests and rank tests over (dataset, scheme, run, fold, value) tables."""

from __future__ import annotations

from collections.abc import Callable
from math import erf, exp, lgamma, log, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi_square_p_value


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def t_p_value(t: float, df: int) -> float:
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def normal_p_value(z: float) -> float:
    return 1 - erf(abs(z) / sqrt(2))


def f_p_value(f: float, d1: int, d2: int) -> float:
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def signed_rank_p_value(smaller: float, n: int) -> float:
    """Two-sided exact probability of a sum of signed ranks of ``n`` differences of at most ``smaller`` on either side, all ranks being whole.

    Of the 2**n ways to sign the ranks those of each sum are counted rank by rank.
    """
    most = n * (n + 1) // 2
    ways = [1] + [0] * most
    for rank in range(1, n + 1):
        for s in range(most, rank - 1, -1):
            ways[s] += ways[s - rank]
    return min(1.0, 2 * sum(ways[: int(smaller) + 1]) / 2**n) if n else 1.0


def with_p_value(tests: DataFrame, name: str, p_value: Callable[..., float], *columns: str) -> DataFrame:
    """``tests`` with a probability from its columns in ``name``; null where one of them is. A row a test, so few rows."""

    @F.pandas_udf("double")
    def p(*values: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else p_value(*row) for row in zip(*values)], dtype="float64")

    return tests.withColumn(name, p(*[F.col(c).cast("double") for c in columns]))


def friedman_tested(results: DataFrame, value: str) -> DataFrame:
    """``friedman`` with the probability of its statistic, and the F statistic that Iman and Davenport make of it with its own."""
    out = with_p_value(friedman(results, value).withColumn("_df", F.col("schemes") - 1), "p_value", lambda x, df: chi_square_p_value(x, int(df)), "statistic", "_df")
    rest = F.col("datasets") * F.col("_df") - F.col("statistic")
    out = out.withColumn("f_statistic", F.when(rest > 0, (F.col("datasets") - 1) * F.col("statistic") / rest)).withColumn("_d2", F.col("_df") * (F.col("datasets") - 1))
    return with_p_value(out, "f_p_value", f_p_value, "f_statistic", "_df", "_d2").drop("_df", "_d2")


def paired_tested(results: DataFrame, base: str, value: str, significance: float = 0.05, **more) -> DataFrame:
    """``paired`` with the two-sided probability of t, and ``verdict``: 1 if the scheme is significantly below the base, -1 if above, else 0.

    With no deviation there is no t: the verdict then is the sign of the difference.
    """
    out = with_p_value(paired(results, base, value, **more).withColumn("_df", F.col("n") - 1), "p_value", t_p_value, "t", "_df").drop("_df")
    sure = (F.col("p_value") <= significance) | (F.col("t").isNull() & (F.col("n") > 1))
    return out.withColumn("verdict", F.when(sure, F.signum("mean_diff")).otherwise(0).cast("int"))


def cross_table(tests: DataFrame) -> DataFrame:
    """(scheme, wins, ties, losses): over data sets, how often a scheme was significantly above, like or below the base of ``paired_tested``."""
    return tests.groupBy("scheme").agg(F.count_if(F.col("verdict") < 0).alias("wins"), F.count_if(F.col("verdict") == 0).alias("ties"), F.count_if(F.col("verdict") > 0).alias("losses"))


def wilcoxon_tested(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """``wilcoxon`` with ``p_value``, exact up to 50 differences (for tied ranks it is that of the next whole sum below) and of z beyond."""

    def p(n, plus, minus, z):
        return signed_rank_p_value(min(plus, minus), int(n)) if n <= 50 else normal_p_value(z)

    return with_p_value(wilcoxon(pairs, a, b, by), "p_value", p, "n", "w_plus", "w_minus", "z")


def averaged(results: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and sample standard deviation of ``values`` and the number of rows by ``keys``."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{p}_{c}") for c in values for p, f in (("avg", F.avg), ("sd", F.stddev_samp))])


def paired(results: DataFrame, base: str, value: str, by: tuple[str, ...] = ("dataset",), pair: tuple[str, ...] = ("run", "fold"), ratio: float | None = None) -> DataFrame:
    """Each scheme against ``base``: (.., n, mean_diff, sd_diff, correlation, t), rows paired by dataset, run and fold.

    With ``ratio`` (test over training size) the variance is corrected by 1 / n + ratio.
    """
    key = [*by, *pair]
    a = results.where(F.col("scheme") == base).select(*key, F.col(value).alias("x"))
    b = results.where(F.col("scheme") != base).select(*key, "scheme", F.col(value).alias("y"))
    d = F.col("x") - F.col("y")
    out = b.join(a, key).groupBy(*by, "scheme").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"), F.corr("x", "y").alias("correlation"))
    share = 1 / F.col("n") + (F.lit(ratio) if ratio is not None else F.lit(0.0))
    return out.withColumn("t", F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") * F.sqrt(share))))


def _same(names: list[str]) -> list[Column]:
    return [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names]


def _value_ranks(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(.., value, _twice): twice the mid-rank within ``by`` of each value, whose rows are ``_n``.

    The counts are summed up over 1024 ranges of the values of a group and inside each, so that no task holds a group.
    """
    edges = counts.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    cell = F.when(F.col("_high") > F.col("_low"), F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * 1023)).otherwise(F.lit(0))
    counts = counts.alias("l").join(edges.alias("r"), _same(by)).select(*[F.col(f"l.{c}") for c in [*by, value, "_n"]], cell.alias("_cell"))
    cells = counts.groupBy(*by, "_cell").agg(F.sum("_n").alias("_m"))
    cells = cells.withColumn("_before", F.sum("_m").over(Window.partitionBy(*by).orderBy("_cell")) - F.col("_m")).drop("_m")
    inside = F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy(value)) - F.col("_n")
    ranks = counts.withColumn("_inside", inside).alias("l").join(cells.alias("r"), _same([*by, "_cell"]))
    return ranks.select(*[F.col(f"l.{c}") for c in [*by, value]], (2 * (F.col("r._before") + F.col("l._inside")) + F.col("l._n") + 1).alias("_twice"))


def mid_ranks(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Ranks from 1 by ``value`` within ``by``, ties sharing their mean; no task sorts the rows of a group."""
    ranks = _value_ranks(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), value, by)
    ranks = ranks.select(*[F.col(c).alias(f"_{c}_") for c in [*by, value]], (F.col("_twice") / 2).alias(name))
    return df.join(ranks, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in [*by, value]]).drop(*[f"_{c}_" for c in [*by, value]])


def friedman(results: DataFrame, value: str) -> DataFrame:
    """(datasets, schemes, statistic): tie-corrected chi-square of the schemes' rank sums over datasets."""
    r = mid_ranks(results.groupBy("dataset", "scheme").agg(F.avg(value).alias("v")), "v", ["dataset"])
    size = r.agg(F.countDistinct("dataset").alias("n"), F.countDistinct("scheme").alias("k"))
    ties = r.groupBy("dataset", "v").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    sums = r.groupBy("scheme").agg(F.sum("rank").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12 / (n * k * (k + 1)) * F.col("q") - 3 * n * (k + 1)
    return size.join(ties, F.lit(True)).join(sums, F.lit(True)).select(F.col("n").alias("datasets"), F.col("k").alias("schemes"), (raw / (1 - F.col("ties") / (n * (k * k * k - k)))).alias("statistic"))


def wilcoxon(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(.., n, w_plus, w_minus, z): signed ranks of non-zero differences, z with continuity 0.5."""
    d = pairs.withColumn("_d", F.col(a) - F.col(b)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    r = mid_ranks(d, "_a", by)
    out = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    n = F.col("n").cast("double")
    return out.withColumn("z", (F.abs(F.col("w_plus") - n * (n + 1) / 4) - 0.5) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def mann_whitney(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """(.., n1, n2, u, z) of the smaller-named group against the other, by mid-ranks and the normal approximation."""
    counts = df.groupBy(*by, value, group).agg(F.count(F.lit(1)).alias("_k"))
    ranks = _value_ranks(counts.groupBy(*by, value).agg(F.sum("_k").alias("_n")), value, by)
    r = counts.alias("l").join(ranks.alias("r"), _same([*by, value])).select(*[F.col(f"l.{c}") for c in [*by, group, "_k"]], (F.col("r._twice").cast("decimal(38,0)") * F.col("l._k")).cast("decimal(38,0)").alias("_t"))
    # rows and twice the ranks' sum of each group, which are whole numbers
    sums = r.groupBy(*by, group).agg(F.sum("_k").alias("_k"), F.sum("_t").alias("_t"))
    first = F.col(group) == F.min(group).over(Window.partitionBy(*by))
    sums = sums.withColumn("_first", first)
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("_k"))), F.lit(0).cast("long"))
    out = sums.groupBy(*by).agg(count(F.col("_first")).alias("n1"), count(~F.col("_first")).alias("n2"), (F.coalesce(F.sum(F.when(F.col("_first"), F.col("_t"))).cast("double"), F.lit(0.0)) / 2).alias("_r"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    out = out.withColumn("u", F.col("_r") - n1 * (n1 + 1) / 2).drop("_r")
    return out.withColumn("z", (F.col("u") - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))


def classification_metrics(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) for each label, from one pass over the predictions."""
    cells = predictions.groupBy(F.col(label).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("a") != F.col("p"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col("a") != F.col("p"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x"))
    out = rows.groupBy("x.label").agg(*[F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def regression_metrics(predictions: DataFrame, label: str, predicted: str, train_mean: float) -> DataFrame:
    """(n, mae, rmse, rae, rrse, correlation); relative errors against always predicting the training mean."""
    y, e = F.col(label), F.col(predicted) - F.col(label)
    base = y - F.lit(train_mean)
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.sum(F.abs(e)) * 100 / F.sum(F.abs(base))).alias("rae"), (F.sqrt(F.sum(e * e) / F.sum(base * base)) * 100).alias("rrse"), F.corr(label, predicted).alias("correlation"))


def win_loss(pairs: DataFrame, by: tuple[str, ...] = ("scheme", "other"), critical: float = 1.96) -> DataFrame:
    """(.., wins, losses, difference) from rows (.., t): how often |t| passes ``critical`` on either side."""
    out = pairs.groupBy(*by).agg(F.count(F.when(F.col("t") > critical, 1)).alias("wins"), F.count(F.when(F.col("t") < -critical, 1)).alias("losses"))
    return out.withColumn("difference", F.col("wins") - F.col("losses"))


def holm(tests: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """``tests`` with ``adjusted``: p values by Holm's step-down rule, within ``by``; the tests of a family are few."""
    family = Window.partitionBy(*(by or []))
    order = family.orderBy(p)
    step = (F.count(F.lit(1)).over(family) - F.row_number().over(order) + 1) * F.col(p)
    return tests.withColumn("_step", step).withColumn("adjusted", F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")
