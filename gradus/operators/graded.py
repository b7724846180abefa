"""Graded measures over all pairs of rows, subset merits made of them, and relief weights.

A row of the pair table holds the similarity of two rows on the attributes (``sim``) and on the class (``dec``: equality
of labels, or linear similarity of numbers). Rows of equal values and class are one, with a weight. Pairs are quadratic
in the distinct rows by definition; the smaller measures come from one aggregation by row over them. Measures that a row's
similarities by class determine take the table of ``measures.class_similarities`` instead, which meets in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import IMPLICATORS as ARRAY_IMPLICATORS
from ..functions.arrays import quantifier as quantiles
from ..functions.arrays import similarities
from ..functions.degrees import IMPLICATORS, SIMILARITIES, T_NORMS, _range, fold, quantifier
from .columns import statistics
from .measures import collapsed, enemies
from .meetings import closest, packed, placed, vectors
from .meetings import same as alike
from .staging import cut

#: Rows in a block.
BLOCK = 512
#: Rows whose implications are ordered at once.
STRIP = 16


def graded_pairs(df: DataFrame, columns: list[str], target: str, similarity: str = "linear", norm: str = "lukasiewicz") -> DataFrame:
    """(x, y, cx, cy, sim, dec, wx, wy) of all pairs of distinct rows, each with itself too.

    A null attribute is similar to all; rows without a class are left out.
    """
    numeric = dict(df.dtypes)[target] in ("double", "float")
    s = statistics(df, [*columns, target] if numeric else columns)
    rows = collapsed(df, columns, target)
    names = [*columns, target]
    a = rows.select(F.struct(*names).alias("x"), F.col(target).alias("cx"), F.col("_w").alias("wx"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rows.select(F.struct(*names).alias("y"), F.col(target).alias("cy"), F.col("_w").alias("wy"), *[F.col(c).alias(f"b_{c}") for c in columns])
    sim = fold(norm, [F.coalesce(SIMILARITIES[similarity](F.col(f"a_{c}"), F.col(f"b_{c}"), s[c]), F.lit(1.0)) for c in columns])
    dec = SIMILARITIES["linear" if numeric else "equal"](F.col("cx"), F.col("cy"), s[target] if numeric else {})
    return a.join(b, F.lit(True)).select("x", "y", "cx", "cy", sim.alias("sim"), dec.alias("dec"), "wx", "wy")


def weak_lower(pairs: DataFrame, implicator: str = "lukasiewicz") -> DataFrame:
    """(weak_gamma, weak_delta): mean and least of each row's lower membership in its own decision."""
    low = pairs.groupBy("x", "wx").agg(F.min(IMPLICATORS[implicator](F.col("sim"), F.col("dec"))).alias("low"))
    return low.agg((F.sum(F.col("low") * F.col("wx")) / F.sum("wx")).alias("weak_gamma"), F.min("low").alias("weak_delta"))


def weak_lower_of(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``weak_lower`` (linear similarity, Lukasiewicz) without the pairs.

    A class of labels asks for the nearest row of another class alone. For a number the least implication lies at a row near
    in the columns and far in the target, which is found by bounds of blocks.
    """
    if dict(df.dtypes)[target] not in ("double", "float"):
        low = enemies(df, columns, target).select("wx", IMPLICATORS["lukasiewicz"](F.coalesce("near", F.lit(0.0)), F.lit(0.0)).alias("low"))
        return low.agg((F.sum(F.col("low") * F.col("wx")) / F.sum("wx")).alias("weak_gamma"), F.min("low").alias("weak_delta"))
    s = statistics(df, [*columns, target])
    spread = np.array([_range(s[c]) for c in [*columns, target]])
    last, places = len(columns), [f"_{i}" for i in range(len(columns) + 1)]

    def low(gaps):
        part = np.maximum(0.0, 1 - gaps / spread)
        sim = part[..., 0]
        for c in range(1, last):
            sim = np.maximum(sim + part[..., c] - 1, 0.0)
        return np.minimum(1.0, 1 - sim + part[..., last])

    rows = collapsed(df, columns, target)
    rows = rows.select(F.col("_w").alias("wx"), *[F.col(c).cast("double").alias(p) for c, p in zip([*columns, target], places)])
    blocks = placed(rows, ["wx"], places, BLOCK)
    exact = lambda x, y: -low(np.nan_to_num(np.abs(x[:, None, :] - y[None, :, :])))
    bound = lambda least, most: -low(np.concatenate([least[..., :last], most[..., last:]], -1))
    found = closest(blocks, blocks.drop("wx"), ["wx"], [], exact, bound).withColumn("low", -F.col("_close"))
    return found.agg((F.sum(F.col("low") * F.col("wx")) / F.sum("wx")).alias("weak_gamma"), F.min("low").alias("weak_delta"))


def weak_owa(pairs: DataFrame, implicator: str = "lukasiewicz", alpha: float = 0.2, beta: float = 1.0) -> DataFrame:
    """(weak_gamma_owa): the same with an ordered weighted average of the implications for the minimum.

    The i-th largest of n implications weighs q(i / n) - q((i - 1) / n) for the vague quantifier q.
    """
    rows = pairs.select("x", "wx", "wy", IMPLICATORS[implicator](F.col("sim"), F.col("dec")).alias("i"))
    same = rows.groupBy("x", "wx", "i").agg(F.sum("wy").alias("k"))  # equal implications are neighbours in any order
    upto = F.sum("k").over(Window.partitionBy("x").orderBy(F.col("i").desc()))
    n = F.sum("k").over(Window.partitionBy("x"))
    share = same.select("x", "wx", "i", (quantifier(upto / n, alpha, beta) - quantifier((upto - F.col("k")) / n, alpha, beta)).alias("w"))
    low = share.groupBy("x", "wx").agg(F.sum(F.col("i") * F.col("w")).alias("low"))
    return low.agg((F.sum(F.col("low") * F.col("wx")) / F.sum("wx")).alias("weak_gamma_owa"))


def weak_owa_of(df: DataFrame, columns: list[str], target: str, similarity: str = "linear", norm: str = "lukasiewicz", implicator: str = "lukasiewicz", alpha: float = 0.2, beta: float = 1.0) -> DataFrame:
    """``weak_owa`` without the pairs: a block of rows gathers the vectors of all rows in its task, and orders the implications
    of a few of its rows at once. Time is quadratic in the distinct rows; a task holds one vector for each of them."""
    numeric = dict(df.dtypes)[target] in ("double", "float")
    s = statistics(df, [*columns, target] if numeric else columns)
    stats, width = [s[c] for c in columns], len(columns) + numeric
    places = [f"_{i}" for i in range(width)]
    rows = collapsed(df, columns, target)
    rows = rows.select(F.col("_w").alias("wx"), F.col(target).alias("cx"), *[F.col(c).alias(p) for c, p in zip([*columns, target], places)])

    def run(batches):
        import pyarrow as pa

        own, met = None, []

        def out():
            _, wx, cx, x = own
            y, weight, cy = np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met]), pa.concat_arrays([m[2] for m in met])
            n, low = weight.sum(), np.zeros(len(x))
            even = np.diff(quantiles(np.arange(len(y) + 1) / n, alpha, beta)) if (weight == 1).all() else None
            for at in range(0, len(x), STRIP):
                few = slice(at, at + STRIP)
                if numeric:
                    dec = similarities(x[few, -1:], y[:, -1:], "linear", norm, [s[target]])
                else:
                    dec = alike(cx[few], cy).astype(float)
                i = ARRAY_IMPLICATORS[implicator](similarities(x[few, : len(columns)], y[:, : len(columns)], similarity, norm, stats), dec)
                if even is not None:
                    low[few] = np.sort(i, axis=1)[:, ::-1] @ even
                else:
                    order = np.argsort(-i, axis=1)
                    upto = np.cumsum(weight[order], axis=1)
                    share = quantiles(upto / n, alpha, beta) - quantiles((upto - weight[order]) / n, alpha, beta)
                    low[few] = (np.take_along_axis(i, order, 1) * share).sum(1)
            yield pa.RecordBatch.from_arrays([wx, pa.array(low)], names=["wx", "low"])

        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("q__block")[i].as_py()
                if own is None or own[0] != block:
                    if own is not None:
                        yield from out()
                    own, met = (block, *(batch.column(c)[i].values for c in ("q_wx", "q_cx")), vectors(batch, "q_vectors", i, width).copy()), []
                met.append((vectors(batch, "vectors", i, width).copy(), batch.column("wx")[i].values.to_numpy().astype(float), batch.column("cx")[i].values))
        if own is not None:
            yield from out()

    tasks = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    asked = cut(packed(rows, ["wx", "cx"], places, "q_", BLOCK).withColumn("q__block", F.monotonically_increasing_id()))
    pairs = asked.hint("shuffle_replicate_nl").crossJoin(packed(rows, ["wx", "cx"], places)).repartition(tasks, "q__block").sortWithinPartitions("q__block")
    low = pairs.mapInArrow(run, "wx long, low double")
    return low.agg((F.sum(F.col("low") * F.col("wx")) / F.sum("wx")).alias("weak_gamma_owa"))


def boundary_region(table: DataFrame, implicator: str = "lukasiewicz", norm: str = "lukasiewicz") -> DataFrame:
    """(boundary): 1 less the mean of upper less lower membership, over rows and classes, of ``measures.class_nearest``
    (or ``class_similarities``).

    Of a row's membership in a class, its most similar rows inside and outside say all: I(s, 1) = 1 and T(s, 0) = 0.
    """
    table = cut(table)
    k = table.agg(F.countDistinct("cx")).first()[0] or 1
    best = table.select("x", "wx", F.col("cy").alias("c"), "near")
    top = Window.partitionBy("x").orderBy(F.col("near").desc())
    best = best.withColumn("first", F.max("near").over(Window.partitionBy("x"))).withColumn("r", F.row_number().over(top))
    second = F.max(F.when(F.col("r") == 2, F.col("near"))).over(Window.partitionBy("x"))
    outside = F.when(F.col("r") == 1, F.coalesce(second, F.lit(None))).otherwise(F.col("first"))
    low = F.coalesce(IMPLICATORS[implicator](outside, F.lit(0.0)), F.lit(1.0))
    gap = T_NORMS[norm](F.col("near"), F.lit(1.0)) - low
    return best.withColumn("gap", gap).agg((1 - F.sum(F.col("gap") * F.col("wx")) / (F.sum(F.when(F.col("r") == 1, F.col("wx"))) * k)).alias("boundary"))


def fuzzy_entropy(table: DataFrame) -> DataFrame:
    """(fuzzy_entropy): 1 less the entropy of the classes around each row, weighed by its cardinality, over log2 of the classes,
    of ``measures.class_similarities``."""
    table = cut(table)
    k = table.agg(F.countDistinct("cx")).first()[0] or 1
    part = table.select("x", "wx", "cy", F.col("total").alias("s"))
    p = F.col("s") / F.sum("s").over(Window.partitionBy("x"))
    rows = part.withColumn("p", p).groupBy("x", "wx").agg(F.sum("s").alias("card"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)).alias("h"))
    mean = F.sum(F.col("card") * F.col("h") * F.col("wx")) / F.sum(F.col("card") * F.col("wx"))
    return rows.agg((1 - mean / F.greatest(F.lit(1.0), F.log2(F.lit(float(k))))).alias("fuzzy_entropy"))


def fuzzy_information(pairs: DataFrame) -> DataFrame:
    """(gain_ratio, mutual_information, rough_information) of the attributes and the class, joint similarity being the minimum.

    Entropy is the mean of -log2 of a row's relative cardinality; the rough kind is the mean share of rows unlike it.
    """
    both = F.least("sim", "dec")
    w = F.col("wy")
    rows = pairs.groupBy("x", "wx").agg(F.sum(F.col("sim") * w).alias("s"), F.sum(F.col("dec") * w).alias("d"), F.sum(both * w).alias("j"), F.sum(w).alias("n"))
    return _information(rows)


def _information(rows: DataFrame) -> DataFrame:
    mean = lambda c: F.sum(c * F.col("wx")) / F.sum("wx")
    bits = lambda c: mean(-F.log2(F.col(c) / F.col("n")))
    unlike = lambda c: mean((F.col("n") - F.col(c)) / (F.col("n") - 1))
    out = rows.agg(bits("s").alias("hs"), bits("d").alias("hd"), bits("j").alias("hj"), unlike("s").alias("us"), unlike("d").alias("ud"), unlike("j").alias("uj"))
    gain = F.col("hs") + F.col("hd") - F.col("hj")
    return out.select(F.when(F.col("hj") > 0, gain / F.col("hj")).otherwise(0.0).alias("gain_ratio"), gain.alias("mutual_information"), (F.col("us") + F.col("ud") - F.col("uj")).alias("rough_information"))


def fuzzy_information_by_class(table: DataFrame) -> DataFrame:
    """``fuzzy_information`` of a class of labels, of ``measures.class_similarities``: a row is like its own class alone."""
    own = F.col("cx") == F.col("cy")
    rows = table.groupBy("x", "wx").agg(F.sum("total").alias("s"), F.sum(F.when(own, F.col("n"))).alias("d"), F.sum(F.when(own, F.col("total"))).alias("j"), F.sum("n").alias("n"))
    return _information(rows)


def dependency_merit(df: DataFrame, columns: list[str], target: str, measure: Callable[[DataFrame], DataFrame] | None = None, pairs: Callable = graded_pairs) -> Callable[[frozenset], float]:
    """A merit for the searches of ``selection``: the measure of a subset over that of all columns, 1 at most.

    ``pairs`` makes what the measure takes: ``graded_pairs``, or ``measures.class_similarities`` for those by class. Without a
    measure it is that of ``weak_lower_of``, which makes no pairs.
    """

    def value(subset) -> float:
        some = sorted(subset, key=columns.index)
        return (measure(pairs(df, some, target)) if measure else weak_lower_of(df, some, target)).first()[0] or 0.0

    whole = value(columns) or 1.0
    return lambda subset: min(1.0, value(subset) / whole) if subset else 0.0


def _summed(spread: list[float]):
    """The negative of the sum of differences of rows by their vectors, an unknown one being 0.5, and the nearest that differences by column allow."""

    def exact(x, y):
        far = np.zeros((len(x), len(y)))
        for c, width in enumerate(spread):
            d = np.abs(y[None, :, c] - x[:, c, None]) / width
            far += np.where(np.isnan(d), 0.5, d)
        return -far

    return exact, lambda least, most: -np.minimum(least / np.array(spread), 1).sum(1)


def relief_scores(df: DataFrame, key: str, columns: list[str], target: str, k: int = 10, most: int | None = None, seed: int = 1) -> DataFrame:
    """(attribute, weight): how much better attributes tell a row's nearest rows of other classes apart than those of its own.

    All rows (or, if ``most`` is given, as many by their keys' digests) are compared with all others by the sum of
    range-scaled differences. A null differs by 0.5. Ties go to the smaller key. Blocks of rows that can hold a nearest row
    of a class meet, and what comes of it is k rows for each row and class.
    """
    s = statistics(df, columns)
    known = df.where(F.col(target).isNotNull() & F.col(key).isNotNull())
    counts = known.groupBy(F.col(target).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    total = float(known.count() or 1)
    spread = [float((s[c]["max"] or 0) - (s[c]["min"] or 0)) or 1.0 for c in columns]
    rows = known.select(F.col(key).alias("k"), F.col(target).alias("c"), *columns)
    some = rows if most is None else rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("k").cast("string"))), "k").limit(most)
    values = [f"_{i}" for i in range(len(columns))]
    doubles = lambda df, prefix: df.select("k", "c", *[F.col(c).cast("double").alias(f"{prefix}{v}") for c, v in zip(columns, values)])
    asked = doubles(some, "q").withColumnsRenamed({"k": "q", "c": "qc"})
    asked, there = placed(asked, ["q", "qc", *[f"q{v}" for v in values]], [f"q{v}" for v in values], BLOCK, "qc"), placed(doubles(rows, "y"), ["k", "c", *[f"y{v}" for v in values]], [f"y{v}" for v in values], BLOCK, "c")
    # unknown values are half a range away, so a column's bound of them is one
    near = closest(asked, there, ["q", "qc", *[f"q{v}" for v in values]], ["k", "c", *[f"y{v}" for v in values]], *_summed(spread), k=k, relation="each", key=("q", "k"), by=("qc", "c"), unknown=max(spread))
    near = near.withColumn("d", F.array(*[F.coalesce(F.abs(F.col(f"y{v}") - F.col(f"q{v}")) / width, F.lit(0.5)) for v, width in zip(values, spread)]))
    means = near.groupBy("q", "qc", "c").agg(*[F.avg(F.col("d")[i]).alias(f"d_{c}") for i, c in enumerate(columns)])
    prior = F.col("n") / total
    own = counts.select(F.col("c").alias("qc"), prior.alias("own"))
    means = means.join(F.broadcast(counts), "c").join(F.broadcast(own), "qc")  # a row a class
    sign = F.when(F.col("c") == F.col("qc"), F.lit(-1.0)).otherwise(prior / (1 - F.col("own")))
    sums = means.agg(F.countDistinct("q").alias("m"), *[F.sum(sign * F.col(f"d_{c}")).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), (F.col(c) / F.col("m")).alias("weight")) for c in columns])).alias("x")).select("x.*")
