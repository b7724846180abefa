"""Row numbers, running sums and shifts over a key, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a numbering cell should hold, and cells at most: bounds are literals of two levels of SIDE each.
CELL_ROWS = 100_000
SIDE = 64


def _below(bounds: list, key: Column) -> Column:
    """How many of the bounds, in order, lie below the key."""
    return sum((F.when(key > F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))


def cells(df: DataFrame, key: str) -> Column:
    """The number of a row's cell: cells are in the order of ``key`` and of about as many rows each, nulls in the first.

    Bounds are keys of a sample, so that skewed and textual keys are cut as well as any; all bounds are right ones.
    """
    n = df.count()
    wanted = min(SIDE * SIDE, n // CELL_ROWS + 1)
    if wanted == 1:
        return F.lit(0)
    share = min(1.0, 40 * wanted / n)
    sample = sorted(r[0] for r in df.select(key).where(F.col(key).isNotNull()).sample(share, seed=1).collect())  # about 40 keys a cell
    bounds = sorted({sample[i * len(sample) // wanted] for i in range(1, wanted)}) if sample else []
    steps = [bounds[i : i + SIDE] for i in range(0, len(bounds), SIDE)]
    x = F.col(key)
    upper = _below([s[-1] for s in steps], x)
    inner = F.lit(0)
    for i, s in enumerate(steps):
        inner = F.when(upper == i, _below(s, x)).otherwise(inner)
    return F.when(x.isNull(), F.lit(0)).otherwise(upper * (SIDE + 1) + inner)


def running(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each in the order of ``key``, itself included; nulls come first."""
    rows = df.withColumn("_cell", cells(df, key)).withColumn("_v", value)
    totals = rows.groupBy("_cell").agg(F.sum("_v").alias("_t"))
    before = totals.select("_cell", (F.sum("_t").over(Window.orderBy("_cell")) - F.col("_t")).alias("_before"))  # a row a cell
    inside = F.sum("_v").over(Window.partitionBy("_cell").orderBy(F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, "_cell").withColumn(name, F.col("_before") + inside).drop("_cell", "_before", "_v")


def numbered(df: DataFrame, key: str, name: str = "_ord") -> DataFrame:
    """``df`` with the place (from 1) of each row by ``key``; rows of a null key come first, equal keys in any order."""
    return running(df, key, F.lit(1).cast("long"), name)


def shifted(df: DataFrame, key: str, columns: list[str], offset: int, partition_by: list[str] | None = None, delta: bool = False, keep_edges: bool = True) -> DataFrame:
    """Values of the row ``offset`` places away (negative: before), or the current value less that one.

    Rows without such a row get nulls, or go if ``keep_edges`` is off. With ``partition_by`` a window does it; over the
    whole table, places are joined.
    """
    change = lambda c, other: (F.col(c) - other if delta else other).alias(c)
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(key)
        other = {c: F.lead(c, offset).over(w) for c in columns}
        there = F.lead(F.lit(1), offset).over(w)
        out = df.select(*[change(c, other[c]) if c in columns else F.col(c) for c in df.columns], there.alias("_there"))
    else:
        rows = numbered(df, key)
        other = rows.select((F.col("_ord") - offset).alias("_ord"), F.lit(1).alias("_there"), *[F.col(c).alias(f"_{c}") for c in columns])
        out = rows.join(other, "_ord", "left").select(*[change(c, F.col(f"_{c}")) if c in columns else F.col(c) for c in df.columns], "_there")
    return (out if keep_edges else out.where("_there = 1")).drop("_there")
