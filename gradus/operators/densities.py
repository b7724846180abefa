"""Mixtures of Gaussians by class, and rows' memberships in their clusters.

The mixtures of all classes are fitted together by expectation and maximisation: each round is one aggregation over the rows,
which gives back a few sums for each class, cluster and column. Columns are independent within a cluster. A null leaves its
column out of a row's density, and the row out of that column's sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard deviations are at least this.
LEAST_SD = 1e-6


@dataclass
class Mixture:
    """One class's share of the rows and, for each cluster, its weight, means and standard deviations by column."""

    label: object
    prior: float
    weights: list[float]
    means: list[list[float]]
    sds: list[list[float]]


def _log_densities(columns: list[str], mixture: Mixture) -> list[Column]:
    """For each cluster the log of its weight and density."""
    out = []
    for weight, means, sds in zip(mixture.weights, mixture.means, mixture.sds):
        parts = [F.coalesce(-0.5 * F.pow((F.col(c).cast("double") - m) / s, F.lit(2.0)) - (log(s) + 0.5 * log(2 * pi)), F.lit(0.0)) for c, m, s in zip(columns, means, sds)]
        out.append(sum(parts, F.lit(log(weight) if weight > 0 else float("-inf"))))
    return out


def _shares(logs: list[Column]) -> list[Column]:
    """Each log's share of all: exp(log - greatest) over the sum of those."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    whole = sum(parts[1:], parts[0])
    return [p / whole for p in parts]


def _starts(df: DataFrame, columns: list[str], target: str | None, k: int) -> list[Mixture]:
    """Clusters spread along the diagonal of a class's box of 1.5 deviations about the mean."""
    known = df if target is None else df.where(F.col(target).isNotNull())
    rows = known.groupBy(*([target] if target else [])).agg(F.count(F.lit(1)).alias("_n"), *[f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = (rows.orderBy(target) if target else rows.where("_n > 0")).collect()
    total, out = sum(r["_n"] for r in rows), []
    for r in rows:
        mean, sd = [r[f"m{i}"] or 0.0 for i in range(len(columns))], [max(LEAST_SD, r[f"s{i}"] or 0.0) for i in range(len(columns))]
        at = [1.5 * ((2 * j + 1) / k - 1) for j in range(k)]
        out.append(Mixture(r[target] if target else None, r["_n"] / total, [1 / k] * k, [[m + a * s for m, s in zip(mean, sd)] for a in at], [list(sd) for _ in at]))
    return out


def fit_mixtures(df: DataFrame, columns: list[str], target: str | None = None, k: int = 1, rounds: int = 100, enough: float = 1e-6) -> list[Mixture]:
    """A mixture of ``k`` clusters for each class in order (or one of all rows), rows without a class left out.

    With one cluster that is the means and deviations. With more, rounds go on until the mean log density of no class's
    rows grows by ``enough``, or ``rounds`` are done. A cluster that loses all its rows stays as it is, without weight.
    """
    mixtures = _starts(df, columns, target, k)
    if k == 1:
        return mixtures
    last = [float("-inf")] * len(mixtures)
    for _ in range(rounds):
        sums = []
        for i, m in enumerate(mixtures):
            own = F.lit(True) if target is None else F.col(target) == F.lit(m.label)
            logs = _log_densities(columns, m)
            top = F.greatest(*logs)
            sums += [F.sum(F.when(own, top + F.log(sum((F.exp(x - top) for x in logs), F.lit(0.0))))).alias(f"l{i}"), F.count_if(own).alias(f"n{i}")]
            for j, share in enumerate(_shares(logs)):
                sums.append(F.sum(F.when(own, share)).alias(f"w{i}_{j}"))
                for a, c in enumerate(columns):
                    off = F.col(c).cast("double") - m.means[j][a]
                    sums += [F.sum(F.when(own & off.isNotNull(), share)).alias(f"s{i}_{j}_{a}"), F.sum(F.when(own, share * off)).alias(f"x{i}_{j}_{a}"), F.sum(F.when(own, share * off * off)).alias(f"q{i}_{j}_{a}")]
        if not sums:
            break
        row = df.agg(*sums).first()
        now = [row[f"l{i}"] / row[f"n{i}"] for i in range(len(mixtures))]
        for i, m in enumerate(mixtures):
            for j in range(k):
                m.weights[j] = row[f"w{i}_{j}"] / row[f"n{i}"]
                for a in range(len(columns)):
                    if s := row[f"s{i}_{j}_{a}"]:
                        step = row[f"x{i}_{j}_{a}"] / s
                        m.means[j][a] += step
                        m.sds[j][a] = max(LEAST_SD, max(0.0, row[f"q{i}_{j}_{a}"] / s - step * step) ** 0.5)
        if all(a - b < enough for a, b in zip(now, last)):
            break
        last = now
    return mixtures


def cluster_membership(df: DataFrame, columns: list[str], mixtures: list[Mixture], keep: list[str]) -> DataFrame:
    """``keep`` and, for the class numbered i and its cluster j, ``pCluster_i_j``: the row's share of all densities, classes weighed by their share of rows.

    The mixtures are literals of the plan, so later batches and streams can be told their memberships as well.
    """
    logs = [(f"pCluster_{i}_{j}", x + log(m.prior)) for i, m in enumerate(mixtures) for j, x in enumerate(_log_densities(columns, m))]
    shares = _shares([x for _, x in logs]) if logs else []
    return df.select(*keep, *[s.alias(name) for (name, _), s in zip(logs, shares)])
