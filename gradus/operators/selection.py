"""Attribute evaluators, each one aggregation over all attributes, and greedy searches over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .supervised import fit_discretize


def contingency(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(attribute, value, class, n): all attributes' tables in one pass; a null value is a level of its own."""
    rows = df.where(F.col(target).isNotNull())
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.col(target).cast("string").alias("class"), F.explode(pairs).alias("p")).groupBy("p.attribute", "p.value", "class").agg(F.count(F.lit(1)).alias("n"))


def entropy_scores(df: DataFrame, columns: list[str], target: str, numeric: Sequence[str] = ()) -> DataFrame:
    """(attribute, info_gain, gain_ratio, symmetrical_uncertainty).

    Attributes of ``numeric`` are cut by ``supervised.mdl_cuts`` first, one without cuts scores 0; of the others each
    value is a level.
    """
    cells = contingency(fit_discretize(df, list(numeric), target).transform(df) if numeric else df, columns, target)
    n = F.lit(float(df.where(F.col(target).isNotNull()).count() or 1))
    bits = lambda: -F.sum(F.col("n") / n * F.log2(F.col("n") / n))
    joint = cells.groupBy("attribute").agg(bits().alias("hj"))
    values = cells.groupBy("attribute", "value").agg(F.sum("n").alias("n")).groupBy("attribute").agg(bits().alias("ha"))
    classes = cells.groupBy("attribute", "class").agg(F.sum("n").alias("n")).groupBy("attribute").agg(bits().alias("hc"))
    gain = F.col("hc") + F.col("ha") - F.col("hj")
    return (
        joint.join(values, "attribute")
        .join(classes, "attribute")
        .select("attribute", gain.alias("info_gain"), F.when(F.col("ha") > 0, gain / F.col("ha")).otherwise(0.0).alias("gain_ratio"), F.when(F.col("ha") + F.col("hc") > 0, 2 * gain / (F.col("ha") + F.col("hc"))).otherwise(0.0).alias("symmetrical_uncertainty"))
    )


def one_rule_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(attribute, accuracy): percent right if each value predicts its most frequent class; numbers are not binned."""
    best = contingency(df, columns, target).groupBy("attribute", "value").agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return best.groupBy("attribute").agg((F.sum("m") * 100.0 / F.sum("t")).alias("accuracy"))


def _correlation(a: str, b: str) -> Column:
    """Pearson's correlation of the rows that have both; null where one of them is constant."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))


def correlations(df: DataFrame, columns: list[str], target: str) -> dict[tuple[str, str], float]:
    """Absolute Pearson correlations of all pairs, the target included, in one job; 0 with a constant column."""
    names = [*columns, target]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*[F.abs(_correlation(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {pair: row[f"p{i}"] or 0.0 for i, pair in enumerate(pairs)}


def correlation_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(attribute, correlation) with a numeric target; null for a constant attribute."""
    wide = df.agg(*[_correlation(c, target).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("correlation")) for c in columns])).alias("x")).select("x.*")


def cfs_merit(table: dict[tuple[str, str], float], target: str) -> Callable[[frozenset], float]:
    """Sum of relevance over the root of k + redundancy."""
    r = lambda a, b: table.get((a, b), table.get((b, a), 0.0))

    def merit(subset: frozenset) -> float:
        if not subset:
            return 0.0
        s = sorted(subset)
        inner = sum(r(a, b) for i, a in enumerate(s) for b in s[i + 1 :])
        return sum(r(a, target) for a in s) / (len(s) + 2 * inner) ** 0.5

    return merit


def memoised(merit: Callable[[frozenset], float]) -> Callable[[frozenset], float]:
    known: dict[frozenset, float] = {}

    def look(subset: frozenset) -> float:
        if subset not in known:
            known[subset] = merit(subset)
        return known[subset]

    return look


def greedy_forward(columns: list[str], merit: Callable[[frozenset], float], enough: float | None = None) -> list[str]:
    """Adds the best attribute while the merit grows, up to ``enough``."""
    merit, chosen, best = memoised(merit), [], float("-inf")
    while len(chosen) < len(columns):
        value, name = max((merit(frozenset([*chosen, c])), c) for c in columns if c not in chosen)
        if value <= best:
            break
        chosen.append(name)
        best = value
        if enough is not None and best >= enough:
            break
    return chosen


def greedy_backward(columns: list[str], merit: Callable[[frozenset], float], least: float) -> list[str]:
    """From the last to the first, drops each attribute without which the merit stays at ``least``."""
    kept = list(columns)
    for c in reversed(columns):
        rest = frozenset(x for x in kept if x != c)
        if rest and merit(rest) >= least:
            kept.remove(c)
    return kept


def best_first(columns: list[str], merit: Callable[[frozenset], float], stale: int = 5) -> list[str]:
    """Expands the best open subset until ``stale`` expansions in a row bring nothing better."""
    merit = memoised(merit)
    start: frozenset = frozenset()
    queue, seen, best, idle = [(merit(start), start)], {start}, (merit(start), start), 0
    while queue and idle < stale:
        queue.sort(key=lambda x: (x[0], sorted(x[1])))
        _, subset = queue.pop()
        found = False
        for c in columns:
            new = subset | {c}
            if new not in seen:
                seen.add(new)
                queue.append((merit(new), new))
                if merit(new) > best[0] + 1e-5:
                    best, found = (merit(new), new), True
        idle = 0 if found else idle + 1
    return sorted(best[1], key=columns.index)


def ranked(scores: DataFrame, score: str, n: int | None = None, threshold: float | None = None) -> DataFrame:
    """Attributes by score, the highest first."""
    out = scores if threshold is None else scores.where(F.col(score) >= threshold)
    out = out.orderBy(F.col(score).desc(), "attribute")
    return out if n is None else out.limit(n)

