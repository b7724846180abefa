"""Merging of labels by chi-square (CHAID without re-splitting), for all attributes at once.

Counts of (attribute, label, class) are one aggregation over the rows. What is left of an attribute is its table of labels
by classes, on which the merges depend on each other; each attribute's is worked on by a task of its own, in memory for
labels times classes and time for labels squared. The merges come back as a table of labels that is joined to the rows,
so no label passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import chi_square_p_value


def chi_square(table: np.ndarray) -> float:
    """Chi-square statistic of a table of counts, with Yates' correction of one degree of freedom; empty rows and columns add nothing."""
    rows, columns, n = table.sum(1), table.sum(0), table.sum()
    if not n or min(table.shape) < 2:
        return 0.0
    expected = np.outer(rows, columns) / n
    off = np.abs(table - expected)
    if table.shape == (2, 2):
        off = np.maximum(0, off - 0.5)
    return float(np.divide(off * off, expected, out=np.zeros_like(off), where=expected > 0).sum())


def _against(row: np.ndarray, others: np.ndarray) -> np.ndarray:
    """``chi_square`` of ``row`` with each of ``others``."""
    total = row + others
    n, own = total.sum(1, keepdims=True), row.sum()
    safe = np.where(n > 0, n, 1)
    out = np.zeros(len(others))
    for part, size in ((row, own), (others, others.sum(1, keepdims=True))):
        expected = total * size / safe
        off = np.abs(part - expected)
        if len(row) == 2:
            off = np.maximum(0, off - 0.5)
        out += np.divide(off * off, expected, out=np.zeros_like(off), where=expected > 0).sum(1)
    return out


def subsets(labels: int, groups: int) -> int:
    """In how many ways ``labels`` labels fall into ``groups`` groups, none empty: the multiplier of the p value for having searched among them."""
    return sum((-1) ** i * math.comb(groups, i) * (groups - i) ** labels for i in range(groups)) // math.factorial(groups)


def merged_groups(counts: np.ndarray, level: float) -> list[list[int]]:
    """Groups of rows of ``counts`` (labels by classes), in the order of their first rows.

    The pair of groups that differ least (of ties the first) is merged until it differs significantly; then all are
    merged if the whole table, its p value multiplied by ``subsets``, isn't significant. Each group keeps its best later
    partner, so a merge costs one pass over the groups and a pass for each whose partner went.
    """
    table, groups, classes = counts.astype(float), {i: [i] for i in range(len(counts))}, counts.shape[1]
    best: dict[int, tuple[float, int]] = {}

    def look(i: int) -> None:
        later = [j for j in groups if j > i]
        best.pop(i, None)
        if later:
            values = _against(table[i], table[later])
            at = int(np.argmin(values))
            best[i] = (float(values[at]), later[at])

    for i in groups:
        look(i)
    while len(groups) > 1:
        i = min(best, key=lambda i: (best[i][0], i))
        value, j = best[i]
        if chi_square_p_value(value, classes - 1) <= level:
            whole = table[list(groups)]
            p = chi_square_p_value(chi_square(whole), (classes - 1) * (len(whole) - 1))
            if p > 0 and math.log(p) + math.log(subsets(len(counts), len(whole))) > math.log(level):
                return [list(range(len(counts)))]
            break
        table[i] += table[j]
        groups[i] = sorted(groups[i] + groups.pop(j))
        best.pop(j, None)
        earlier = [e for e in groups if e < i]
        stale = [e for e in groups if e != i and e < j and best.get(e, (0, -1))[1] in (i, j)]
        look(i)
        for e, v in zip(earlier, _against(table[i], table[earlier]) if earlier else ()):
            if e not in stale and (float(v), i) < best[e]:
                best[e] = (float(v), i)
        for e in stale:
            look(e)
    return list(groups.values())


def label_merges(df: DataFrame, columns: list[str], target: str, level: float = 0.05, short: bool = False, weight: str | None = None) -> DataFrame:
    """(attribute, label, merged, groups): the name under which each label of each column goes on, and how many its column keeps.

    A merged label is its labels joined by ``_or_`` in their order or, if ``short``, its number from 1. Labels are text,
    in order of their code points. Rows without a label or class don't count; ``weight`` names a column of row weights.
    """
    classes = df.agg(F.countDistinct(target)).first()[0]
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("label")) for c in columns])
    n = F.sum("w").cast("double") if weight else F.count(F.lit(1)).cast("double")
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("class"), *([F.col(weight).alias("w")] if weight else []), F.explode(pairs).alias("p"))
    counts = rows.where("p.label is not null").groupBy("p.attribute", "p.label", "class").agg(n.alias("n"))

    def merge(part):
        import pandas as pd

        table = part.pivot(index="label", columns="class", values="n").fillna(0.0)
        table = table.loc[sorted(table.index)]
        labels = list(table.index)
        values = np.zeros((len(labels), max(classes, table.shape[1])))
        values[:, : table.shape[1]] = table.to_numpy()
        groups = merged_groups(values, level)
        named = [(labels[i], str(g + 1) if short else "_or_".join(labels[k] for k in group), len(groups)) for g, group in enumerate(groups) for i in group]
        return pd.DataFrame(named, columns=["label", "merged", "groups"]).assign(attribute=part["attribute"].iloc[0])[["attribute", "label", "merged", "groups"]]

    return counts.groupBy("attribute").applyInPandas(merge, "attribute string, label string, merged string, groups int")


def merge_labels(df: DataFrame, columns: list[str], merges: DataFrame) -> DataFrame:
    """``df`` with each of ``columns`` that ``label_merges`` changed in its place as ``{column}_merged_values``; others stay as they are.

    Nulls stay null, and so do labels that the merges haven't seen.
    """
    table = merges.select(F.col("attribute").alias("_attribute"), F.col("label").alias("_label"), F.col("merged").alias("_merged"))
    changed = {r[0] for r in table.groupBy("_attribute").agg(F.countDistinct("_merged").alias("m"), F.countDistinct("_label").alias("n")).where("m < n").select("_attribute").collect()}
    for c in [c for c in columns if c in changed]:
        one = table.where(F.col("_attribute") == c).select("_label", "_merged")
        out = df.join(one, F.col(c).cast("string") == F.col("_label"), "left")
        df = out.select(*[F.col("_merged").alias(f"{c}_merged_values") if x == c else F.col(x) for x in df.columns])
    return df
