"""Discernibility clauses as a table, the measure over them, and a greedy reduct.

A clause says of a pair of rows of different classes how well each column tells them apart: 1 less the column's similarity.
Equal clauses are one, with the number of their pairs. They are gathered by meetings of blocks of distinct rows, which collapse
what they find before it leaves the task, so work and table are as large as the rows are varied, not as they or their pairs
are many; columns of few values (labels, cut numbers) give few. A subset of columns satisfies a clause as far as the S-norm of its
degrees.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .meetings import met, packed, same, vectors
from .oversampling import _DIGITS, _met, _points, _sides, _spread

#: Rows of a block that are compared with the other block at once.
STRIP = 64


def clauses(df: DataFrame, numeric: list[str], target: str, nominal: list[str] | None = None) -> DataFrame:
    """(degrees, pairs): distinct clauses of ``df`` over ``numeric`` and then ``nominal`` columns, to nine digits.

    Rows of equal values and class are one of a weight before they meet. A null is similar to all, so it tells nothing
    apart. Rows without a class have no clauses.
    """
    nominal = nominal or []
    numbers, width = len(numeric), len(numeric) + len(nominal)
    places = [f"_{i}" for i in range(width)]
    rows = _points(df, F.lit(""), numeric, nominal, target, _spread(df, numeric)).groupBy("class", "v").agg(F.count(F.lit(1)).alias("w"))
    rows = rows.select("class", "w", *[F.col("v")[i].alias(p) for i, p in enumerate(places)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                x, y = vectors(batch, "q_vectors", i, width), vectors(batch, "vectors", i, width)
                a, b, wx, wy = (batch.column(c)[i].values for c in ("q_class", "class", "q_w", "w"))
                apart, wx, wy = ~same(a, b), wx.to_numpy(), wy.to_numpy()
                parts, counts = [], []
                for at in range(0, len(x), STRIP):
                    enemy = apart[at : at + STRIP]
                    degrees = np.stack([(np.nan_to_num(np.minimum(1, np.abs(u - v))) if c < numbers else ((u != v) & ~np.isnan(u) & ~np.isnan(v)).astype(float))[enemy] for c in range(width) for u, v in [(x[at : at + STRIP, c, None], y[None, :, c])]], axis=1)
                    found, inverse = np.unique(np.round(degrees, _DIGITS) + 0.0, axis=0, return_inverse=True)
                    parts.append(found)
                    counts.append(np.bincount(inverse.ravel(), (wx[at : at + STRIP, None] * wy[None, :])[enemy], len(found)))
                found, inverse = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
                n = np.bincount(inverse.ravel(), np.concatenate(counts), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(found.ravel())), pa.array(n)], names=["degrees", "n"])

    found = met(packed(rows, ["w", "class"], places, "q_"), packed(rows, ["w", "class"], places), run, "degrees array<double>, n long")
    # each pair meets twice
    return found.groupBy("degrees").agg(F.expr("sum(n) div 2").alias("pairs"))


def satisfied(places: list[int], norm: str = "lukasiewicz") -> Column:
    """How far the columns at ``places`` satisfy a clause: the bounded sum, or the greatest, of their degrees."""
    own = [F.col("degrees")[i] for i in places]
    if not own:
        return F.lit(0.0)
    return F.least(F.lit(1.0), sum(own[1:], own[0])) if norm == "lukasiewicz" else F.greatest(*own, F.lit(0.0))


def clause_merits(table: DataFrame, subsets: list[list[int]], norm: str = "lukasiewicz", mean: bool = True) -> list[float]:
    """The discernibility of each subset of columns, all in one job: the mean over the distinct clauses of how far it satisfies
    them, or their T-norm (Lukasiewicz, or the least). 1 without clauses."""

    def one(places):
        x = satisfied(places, norm)
        whole = F.avg(x) if mean else F.greatest(F.lit(0.0), 1 - F.sum(1 - x)) if norm == "lukasiewicz" else F.min(x)
        return F.coalesce(whole, F.lit(1.0))

    row = table.agg(*[one(s).alias(f"m{i}") for i, s in enumerate(subsets)]).first()
    return [float(v) for v in row]


def least_clauses(table: DataFrame, norm: str = "lukasiewicz") -> DataFrame:
    """Without clauses that another makes needless: one of no greater degrees that all columns satisfy as far.

    Clauses meet in blocks as rows do; what is asked of them is only whether there is such a one.
    """
    rows = table.select(F.concat_ws("|", F.transform("degrees", lambda d: d.cast("string"))).alias("id"), F.lit("").alias("class"), F.col("degrees").alias("v"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                width = len(np.frombuffer(batch.column("vectors")[i].as_py())) // len(batch.column("ids")[i])
                x, y, ids, _, _, _ = _sides(batch, i, width)
                most = (lambda z: np.minimum(1, z.sum(1))) if norm == "lukasiewicz" else (lambda z: z.max(1))
                needless = np.zeros(len(x), bool)
                for at in range(0, len(x), STRIP):
                    u = x[at : at + STRIP]
                    below = (y[None, :, :] <= u[:, None, :]).all(2) & (y[None, :, :] < u[:, None, :]).any(2)
                    needless[at : at + STRIP] = (below & (np.round(most(y), _DIGITS)[None, :] >= np.round(most(u), _DIGITS)[:, None])).any(1)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(needless))], names=["id"])

    gone = _met(rows, rows, run, "id string").distinct()
    key = F.concat_ws("|", F.transform("degrees", lambda d: d.cast("string")))
    return table.withColumn("_id", key).join(gone.withColumnRenamed("id", "_gone"), F.col("_id") == F.col("_gone"), "left_anti").drop("_id")


def greedy_reduct(table: DataFrame, width: int, norm: str = "lukasiewicz") -> list[int]:
    """Columns, in the order of their choice, that satisfy every clause as far as all columns do.

    Columns that alone tell a pair apart come first; then the one of the greatest sum of degrees over the clauses that are
    still open, of equal sums the first. Each choice is one aggregation over the clauses; what leaves it is a number a column.
    """
    whole = F.round(satisfied(list(range(width)), norm), _DIGITS)
    alone = F.size(F.filter("degrees", lambda d: d > 0)) == 1
    chosen: list[int] = []
    while len(chosen) < width:
        open_ = table.where(F.round(satisfied(chosen, norm), _DIGITS) < whole)
        rest = [i for i in range(width) if i not in chosen]
        row = open_.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(alone & (F.col("degrees")[i] > 0)).alias(f"a{i}") for i in rest], *[F.round(F.sum(F.col("degrees")[i]), 6).alias(f"s{i}") for i in rest]).first()
        if not row["n"]:
            break
        only = [i for i in rest if row[f"a{i}"]]
        chosen.append(only[0] if only else max(rest, key=lambda i: (row[f"s{i}"], -i)))
    return chosen
