"""Row filters, folds and samples. Row positions are those of a unique key; draws are hashes of it, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def draw(key: str, seed: int) -> Column:
    """A fixed number in [0, 1) for each key; of a null key too."""
    return _share(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _share(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def subset_by_expression(df: DataFrame, expression: str) -> DataFrame:
    """Rows where a Spark SQL condition is true; unknown is false at the end, so that the NOT of an unknown is false too.

    For conditions whose comparisons with nulls are false themselves, and true under a NOT, use ``subset``.
    """
    return df.where(F.coalesce(F.expr(expression), F.lit(False)))


def holds(comparison: Column) -> Column:
    """A comparison that is false where a null is compared."""
    return F.coalesce(comparison, F.lit(False))


def subset(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where a condition made of ``holds`` comparisons by ``&``, ``|`` and ``~`` is true."""
    return df.where(condition)


def remove_duplicates(df: DataFrame, key: str | None = None) -> DataFrame:
    """Without rows that equal an earlier one (in all columns but ``key``), the first by ``key`` kept."""
    if key is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(*rest).agg(F.min(key).alias(key))
    return first.select(*df.columns)


def remove_range(df: DataFrame, key: str, first: int, last: int, invert: bool = False) -> DataFrame:
    inside = F.col("_ord").between(first, last)
    return numbered(df, key).where(inside if invert else ~inside).drop("_ord")


def remove_percentage(df: DataFrame, key: str, percent: float, invert: bool = False) -> DataFrame:
    """Without the first round(n * percent / 100) rows, or only those."""
    cut = int(df.count() * percent / 100 + 0.5)
    return numbered(df, key).where(F.col("_ord") <= cut if invert else F.col("_ord") > cut).drop("_ord")


def folds(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with a column ``fold`` (from 1): contiguous by ``key``, the first n_rows % n folds one row larger."""
    total = df.count()
    size, larger = divmod(total, n)
    at = F.col("_ord") - 1
    edge = larger * (size + 1)
    fold = F.when(at < edge, F.floor(at / (size + 1))).otherwise(larger + F.floor((at - edge) / max(1, size)))
    return numbered(df, key).withColumn("fold", (fold + 1).cast("int")).drop("_ord")


def stratified_folds(df: DataFrame, key: str, target: str, n: int) -> DataFrame:
    """Folds dealt in turn within each class. A class's rows are split by the digest of the key and numbered in two steps."""
    cell = F.substring(F.md5(F.col(key).cast("string")), 1, 3)
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy(target, "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy(target).orderBy("_cell")) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy(target, "_cell").orderBy(key)) - 1 + F.col("_before")
    counts = counts.select(F.col(target).alias("_t"), F.col("_cell").alias("_c"), "_before")
    out = rows.join(counts, F.col(target).eqNullSafe(F.col("_t")) & (F.col("_cell") == F.col("_c")))
    return out.withColumn("fold", (place % n + 1).cast("int")).drop("_cell", "_before", "_t", "_c")


def remove_with_values(df: DataFrame, column: str, below: float | None = None, labels: list | None = None, invert: bool = False, match_missing: bool = False) -> DataFrame:
    """Without rows whose value is below a bound, or among labels; nulls stay unless they match."""
    hit = F.col(column) < below if below is not None else F.col(column).isin(labels)
    return df.where(~F.coalesce(~hit if invert else hit, F.lit(match_missing)))


def keep_frequent_values(df: DataFrame, column: str, n: int, least: bool = False) -> DataFrame:
    """Rows of the ``n`` most (or least) frequent labels; ties by label."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    kept = counts.orderBy(F.col("count").asc() if least else F.col("count").desc(), column).limit(n).select(column)
    return df.join(F.broadcast(kept), column, "left_semi") if n <= 10_000 else df.join(kept, column, "left_semi")


def resample(df: DataFrame, key: str, size: int, seed: int = 1) -> DataFrame:
    """Exactly ``size`` rows (all, if fewer) without replacement: those of the smallest draws. The k-sample of a reservoir as well."""
    if size <= 0:
        return df.limit(0)
    # whole cells of draws, and of the cell in which the rows run out the smallest; rows without a draw come first
    rows = df.withColumn("_d", draw(key, seed)).withColumn("_cell", F.coalesce(F.floor(F.col("_d") * 4096), F.lit(-1)))
    before = 0
    for cell, n in sorted(map(tuple, rows.groupBy("_cell").count().collect())):
        if before + n > size:
            edge = rows.where(F.col("_cell") == cell).orderBy("_d").limit(size - before)
            return rows.where(F.col("_cell") < cell).unionByName(edge).select(*df.columns)
        before += n
    return df


def shuffled(df: DataFrame, key: str, seed: int = 1, name: str = "place") -> DataFrame:
    """``df`` with its place (from 1) in a random order that is fixed by ``key`` and ``seed``."""
    return numbered(df.withColumn("_d", draw(key, seed)), "_d", name).drop("_d")


def ranked_in_class(df: DataFrame, key: str, target: str, seed: int = 1) -> DataFrame:
    """``df`` with ``_r``, the place (from 1) of each row by its draw within its class, null being one.

    Places are running counts over cells of draws plus a row number inside one, so no task holds a class.
    """
    rows = df.withColumn("_d", draw(key, seed)).withColumn("_cell", F.floor(F.col("_d") * 4096))
    counts = rows.groupBy(target, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(F.col(target).alias("_t"), F.col("_cell").alias("_c"), (F.sum("_n").over(Window.partitionBy(target).orderBy("_cell")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(target, "_cell").orderBy("_d", key))
    out = rows.join(counts, F.col(target).eqNullSafe(F.col("_t")) & (F.col("_cell") == F.col("_c")))
    return out.withColumn("_r", inside + F.col("_before")).select(*df.columns, "_r")


def class_resample(df: DataFrame, key: str, target: str, percent: float = 100.0, bias: float = 0.0, seed: int = 1) -> DataFrame:
    """Of each class floor(percent% * ((1 - bias) * its rows + bias * all rows / classes)) rows at random, or all it has."""
    counts = df.groupBy(F.col(target).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    every = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    even = float(every["n"] or 0) / max(1, every["k"])
    quota = counts.select("_t", F.floor(percent / 100 * ((1 - bias) * F.col("_n") + bias * even)).alias("_quota"))
    rows = ranked_in_class(df, key, target, seed).join(quota, F.col(target).eqNullSafe(F.col("_t")))
    return rows.where(F.col("_r") <= F.col("_quota")).select(*df.columns)


def resample_with_replacement(df: DataFrame, key: str, size: int, seed: int = 1) -> DataFrame:
    """``size`` draws: each is a random place, joined to the numbered rows."""
    n = df.count()
    draws = df.sparkSession.range(size).select((F.floor(draw("id", seed) * n) + 1).alias("_ord"))
    return numbered(df, key).join(draws, "_ord").drop("_ord")


def replace_with_missing(df: DataFrame, key: str, columns: list[str], share: float, seed: int = 1) -> DataFrame:
    return df.select(*[F.when(draw(key, seed + i) >= share, F.col(c)).alias(c) if c in columns else F.col(c) for i, c in enumerate(df.columns)])


def add_noise(df: DataFrame, key: str, column: str, labels: list, percent: float, seed: int = 1) -> DataFrame:
    """floor(count * percent% + 0.5) rows of each label get the next label, those of the smallest draws; nulls stay null.

    Noise on a class column is the same filter.
    """
    counts = df.groupBy(F.col(column).alias("_t")).agg(F.floor(F.count(F.lit(1)) * percent / 100 + 0.5).alias("_quota"))
    counts = counts.withColumnRenamed("_t", "_label")
    cut = ranked_in_class(df, key, column, seed).join(counts, F.col(column).eqNullSafe(F.col("_label")))
    after = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(labels[(i + 1) % len(labels)]))])
    return cut.withColumn(column, F.when(F.col("_r") <= F.col("_quota"), after[F.col(column)]).otherwise(F.col(column))).select(*df.columns)


def conditional_noise(df: DataFrame, key: str, columns: list[str], share: float, severity: float, stats: dict, seed: int = 1) -> DataFrame:
    """Each number of ``columns`` is moved with probability ``share``: by a normal draw of ``severity`` deviations, within its range."""
    out = []
    for i, c in enumerate(df.columns):
        if c not in columns:
            out.append(F.col(c))
            continue
        s = stats[c]
        u, v = draw(key, seed + 2 * i), draw(key, seed + 2 * i + 1)
        normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(v * 6.283185307179586)
        moved = F.greatest(F.lit(s["min"]), F.least(F.lit(s["max"]), F.col(c) + normal * (severity * (s["sd"] or 0.0))))
        out.append(F.when((draw(key, seed + 1000 + i) < share) & F.col(c).isNotNull(), moved).otherwise(F.col(c)).alias(c))
    return df.select(*out)


def class_weights(df: DataFrame, target: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``_weight`` such that every class has the same total, and the whole its old one; rows without a class keep theirs."""
    w = F.col(weight) if weight else F.lit(1.0)
    totals = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("_t")).agg(F.sum(w).alias("_class"))
    every = totals.agg(F.sum("_class").alias("_all"), F.count(F.lit(1)).alias("_k")).first()
    share = F.lit(float(every["_all"] or 0)) / max(1, every["_k"]) * w / F.col("_class")
    return df.join(totals, F.col(target) == F.col("_t"), "left").withColumn("_weight", F.coalesce(share, w)).drop("_class", "_t")


def spread_subsample(df: DataFrame, key: str, target: str, spread: float, most: int | None = None, seed: int = 1) -> DataFrame:
    """At most spread * (smallest class) rows of each class, those of the smallest draws; rows without a class go."""
    known = df.where(F.col(target).isNotNull())
    least = known.groupBy(target).count().agg(F.min("count")).first()[0] or 0
    cap = int(spread * least) if spread > 0 else 1 << 62
    return ranked_in_class(known, key, target, seed).where(F.col("_r") <= min(cap, most or cap)).select(*df.columns)
