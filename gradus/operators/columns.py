"""Column filters. Fitted ones take their statistics in one aggregation and return a lazy projection.

``fit`` functions return a ``Fitted``, whose ``transform`` applies literals to any later batch, streams included.
Statistics ignore nulls; nulls stay null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running


@dataclass
class Fitted:
    """Expressions by column name, fixed on a first batch."""

    expressions: dict[str, Column]
    state: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.expressions[c].alias(c) if c in self.expressions else F.col(c) for c in df.columns])


def column_range(columns: list[str], spec: str) -> list[str]:
    """Columns of a range such as ``first-3,5,last`` (from 1); a leading ``!`` inverts it."""
    invert, spec = spec.startswith("!"), spec.lstrip("!")
    place = lambda t: {"first": 1, "last": len(columns)}.get(t) or int(t)
    chosen = []
    for part in filter(None, spec.split(",")):
        a, _, b = part.partition("-")
        chosen += columns[place(a) - 1 : place(b or a)]
    return [c for c in columns if c not in chosen] if invert else chosen


def statistics(df: DataFrame, columns: list[str], weight: str | None = None) -> dict[str, dict]:
    """count, min, max, mean, sd, sum, sumsq of each column in one job; means are weighted if asked."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        mean = F.sum(x * F.col(weight)) / F.sum(F.when(x.isNotNull(), F.col(weight))) if weight else F.avg(x)
        parts += [F.struct(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), mean.alias("mean"), F.stddev_samp(x).alias("sd"), F.sum(x).alias("sum"), F.sum(x * x).alias("sumsq")).alias(c)]
    row = df.agg(*parts).first()
    return {c: row[c].asDict() for c in columns}


def fit_normalize(df: DataFrame, columns: list[str], scale: float = 1.0, shift: float = 0.0) -> Fitted:
    """(x - min) / (max - min) * scale + shift; a constant column becomes ``shift``."""
    s = statistics(df, columns)

    def one(c):
        low, high = s[c]["min"], s[c]["max"]
        if low is None or high == low:
            return F.when(F.col(c).isNotNull(), F.lit(float(shift)))
        return (F.col(c) - low) / (high - low) * scale + shift

    return Fitted({c: one(c) for c in columns}, s)


def fit_center(df: DataFrame, columns: list[str], weight: str | None = None) -> Fitted:
    s = statistics(df, columns, weight)
    return Fitted({c: F.col(c) - F.lit(s[c]["mean"]) for c in columns}, s)


def fit_standardize(df: DataFrame, columns: list[str]) -> Fitted:
    """(x - mean) / sample sd; only centred where the sd is 0."""
    s = statistics(df, columns)
    return Fitted({c: (F.col(c) - F.lit(s[c]["mean"])) / F.lit(s[c]["sd"] or 1.0) for c in columns}, s)


def fit_math(df: DataFrame, columns: list[str], formula: Callable[[Column, dict[str, Column]], Column]) -> Fitted:
    """Each column by ``formula(x, stats)`` with MEAN MIN MAX SD COUNT SUM SUMSQUARED; NaN and infinities become null."""
    s = statistics(df, columns)
    names = {"MEAN": "mean", "MIN": "min", "MAX": "max", "SD": "sd", "COUNT": "count", "SUM": "sum", "SUMSQUARED": "sumsq"}
    return Fitted({c: finite(formula(F.col(c), {k: F.lit(s[c][v]) for k, v in names.items()})) for c in columns}, s)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def fit_replace_missing(df: DataFrame, numeric: list[str], nominal: list[str]) -> Fitted:
    """Nulls by the mean or the most frequent label (ties: the smallest)."""
    s = statistics(df, numeric) if numeric else {}
    out = {c: F.coalesce(F.col(c).cast("double"), F.lit(s[c]["mean"])) for c in numeric}
    for c in nominal:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        out[c] = F.coalesce(F.col(c), F.lit(top[c] if top else None))
    return Fitted(out, s)


def replace_missing_with(df: DataFrame, constants: dict) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit(constants[c])).alias(c) if c in constants else F.col(c) for c in df.columns])


def add_column(df: DataFrame, name: str, kind: str, place: int | None = None) -> DataFrame:
    """An all-null column of type ``kind`` at ``place`` (from 0; the end without)."""
    columns = list(df.columns)
    columns.insert(len(columns) if place is None else place, name)
    return df.withColumn(name, F.lit(None).cast(kind)).select(*columns)


def add_constants(df: DataFrame, fields: list[tuple[str, str, object]]) -> DataFrame:
    return df.select("*", *[F.lit(v).cast(t).alias(n) for n, t, v in fields])


def add_expression(df: DataFrame, name: str, expression: str) -> DataFrame:
    """A double column of a Spark SQL expression; NaN and infinities become null."""
    return df.withColumn(name, finite(F.expr(expression).cast("double")))


def cartesian_product(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    known = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        known = known & F.col(c).isNotNull()
    return df.withColumn(name, F.when(known, F.concat_ws("_x_", *columns)))


def copy_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.col(c).alias(f"Copy of {c}") for c in columns])


def first_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """Differences of consecutive columns in place of them."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[(F.col(b) - F.col(a)).alias(f"FO {b}") for a, b in zip(columns, columns[1:], strict=False)])


def make_indicator(df: DataFrame, column: str, labels: list) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column).isin(labels).cast("int")))


def merge_values(df: DataFrame, column: str, labels: list, into: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(labels), F.lit(into)).otherwise(F.col(column)))


def swap_values(df: DataFrame, column: str, a, b) -> DataFrame:
    x = F.col(column)
    return df.withColumn(column, F.when(x == a, F.lit(b)).when(x == b, F.lit(a)).otherwise(x))


def rename_values(df: DataFrame, columns: list[str], names: dict[str, str]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.select(*[F.coalesce(table[F.col(c)], F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def fit_merge_infrequent(df: DataFrame, column: str, least: int) -> Fitted:
    """Labels rarer than ``least`` become one, their names joined by ``_or_``, if there are at least two."""
    rare = [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(column).count().where(F.col("count") < least).orderBy(column).select(column).toLocalIterator()]
    x = F.col(column)
    return Fitted({column: F.when(x.isin(rare), F.lit("_or_".join(map(str, rare)))).otherwise(x) if len(rare) > 1 else x}, {"merged": rare})


def labels_of(df: DataFrame, column: str) -> list:
    """The label domain in order."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).toLocalIterator()]


def one_hot(df: DataFrame, column: str, labels: list) -> DataFrame:
    """A 0/1 column for each label in place of ``column``; all null where it is null."""
    x = F.col(column)
    new = [F.when(x.isNotNull(), (x == v).cast("double")).alias(f"{column}={v}") for v in labels]
    return df.select(*[c for c in df.columns if c != column], *new)


def fit_one_hot_by_mean(df: DataFrame, column: str, target: str) -> Callable[[DataFrame], DataFrame]:
    """k - 1 binary columns over the labels ordered by their mean target: whether a row's label is above each cut."""
    order = [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(column).agg(F.avg(target).alias("m")).orderBy("m", column).toLocalIterator()]

    def apply(rows: DataFrame) -> DataFrame:
        x = F.col(column)
        new = [F.when(x.isNotNull(), x.isin(order[i + 1 :]).cast("double")).alias(f"{column}>{order[i]}") for i in range(len(order) - 1)]
        return rows.select(*[c for c in rows.columns if c != column], *new)

    return apply


def numeric_to_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.when(F.col(c).isNotNull(), (F.col(c) != 0).cast("int")).alias(f"{c}_binarized") if c in columns else F.col(c) for c in df.columns])


def numeric_clean(df: DataFrame, columns: list[str], low: float | None = None, low_value: float | None = None, high: float | None = None, high_value: float | None = None, close: float | None = None, close_value: float | None = None, tolerance: float = 1e-6, decimals: int | None = None) -> DataFrame:
    """The first of these that applies: below low, above high, near a value; else rounded half up."""

    def one(c):
        x, f = F.col(c).cast("double"), 10.0 ** (decimals or 0)
        out = F.floor(x * f + 0.5) / f if decimals is not None else x
        if close is not None:
            out = F.when(F.abs(x - close) < tolerance, F.lit(float(close_value))).otherwise(out)
        if high is not None:
            out = F.when(x > high, F.lit(float(high_value))).otherwise(out)
        if low is not None:
            out = F.when(x < low, F.lit(float(low_value))).otherwise(out)
        return out.alias(c)

    return df.select(*[one(c) if c in columns else F.col(c) for c in df.columns])


#: Functions that a numeric transformation may name.
TRANSFORMS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "floor": F.floor, "ceil": F.ceil, "rint": F.rint, "sin": F.sin, "cos": F.cos, "tan": F.tan, "signum": F.signum, "cbrt": F.cbrt}


def numeric_transform(df: DataFrame, columns: list[str], function: str = "abs") -> DataFrame:
    return df.select(*[finite(TRANSFORMS[function](F.col(c)).cast("double")).alias(c) if c in columns else F.col(c) for c in df.columns])


def change_date_format(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.withColumn(column, F.to_timestamp(F.date_format(column, pattern), pattern))


def date_to_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.unix_millis(F.col(c).cast("timestamp")).cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])


def numeric_to_date(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.timestamp_millis(F.col(c).cast("long")).alias(c) if c in columns else F.col(c) for c in df.columns])


def ordinal_to_numeric(df: DataFrame, column: str, labels: list) -> DataFrame:
    table = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
    return df.withColumn(column, table[F.col(column)])


def obfuscate(df: DataFrame, nominal: dict[str, list]) -> DataFrame:
    """Columns become A1.., labels of the columns in ``nominal`` V1..."""
    for c, labels in nominal.items():
        df = rename_values(df, [c], {v: f"V{i + 1}" for i, v in enumerate(labels)})
    return df.toDF(*[f"A{i + 1}" for i in range(len(df.columns))])


def remove_columns(df: DataFrame, columns: list[str], invert: bool = False) -> DataFrame:
    return df.select(*[c for c in df.columns if (c in columns) == invert])


def remove_by_name(df: DataFrame, pattern: str, invert: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[c for c in df.columns if c in keep or bool(re.fullmatch(pattern, c)) == invert])


def remove_type(df: DataFrame, kinds: set[str], invert: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[c for c, t in df.dtypes if c in keep or (t in kinds) == invert])


def remove_useless(df: DataFrame, most: float = 99.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without columns that are all null, constant, or labels that are distinct in over ``most`` percent of rows."""
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.countDistinct(c).alias("d")).alias(c) for c in df.columns]).first()
    labels = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[c for c in df.columns if c in keep or row[c]["d"] > 1 and not (c in labels and row[c]["d"] * 100.0 / row[c]["n"] > most)])


def rename_by_pattern(df: DataFrame, pattern: str, replacement: str, all_matches: bool = True) -> DataFrame:
    return df.withColumnsRenamed({c: re.sub(pattern, replacement, c, count=0 if all_matches else 1) for c in df.columns})


def reorder(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in the order named; a column named again gets ``_2``, ``_3``..."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        seen[c] = seen.get(c, 0) + 1
        out.append(F.col(c) if seen[c] == 1 else F.col(c).alias(f"{c}_{seen[c]}"))
    return df.select(*out)


#: Cuts of a step: labels of more cuts are found in steps of them, so that conditions nest this deep at most.
STEP = 32


def cut_label(x: Column, cuts: list[float]) -> Column:
    """Bin number from 0; a value equal to a cut belongs below it."""

    def among(first: int, last: int) -> Column:
        # the bin of a value above cut first - 1 and, but for the last bin, not above cut ``last``
        if last - first <= STEP:
            out = F.lit(last)
            for i in reversed(range(first, last)):
                out = F.when(x <= cuts[i], F.lit(i)).otherwise(out)
            return out
        middle = (first + last) // 2
        return F.when(x <= cuts[middle], among(first, middle)).otherwise(among(middle + 1, last))

    return F.when(x.isNotNull(), among(0, len(cuts)))


def fit_equal_width(df: DataFrame, columns: list[str], bins: int = 10) -> Fitted:
    s = statistics(df, columns)
    cuts = {c: [s[c]["min"] + (s[c]["max"] - s[c]["min"]) / bins * i for i in range(1, bins)] if s[c]["count"] and s[c]["max"] > s[c]["min"] else [] for c in columns}
    return Fitted({c: cut_label(F.col(c), cuts[c]) for c in columns}, cuts)


def fit_equal_frequency(df: DataFrame, column: str, bins: int | None = None) -> Fitted:
    """Cuts half way between neighbouring values where a running count passes each share; without ``bins``, sqrt(n) of them.

    A cut is taken at the last value whose running count does not pass the share: a fixed share of all rows, where the
    usual rule shares what is left anew after each cut. Running counts are taken in cells; a row a cut comes to the driver.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    bins = bins or max(1, int(total**0.5))
    ranked = running(counts, "v", F.col("n"), "upto")
    share = F.ceil(F.col("upto") * bins / F.lit(float(total or 1)))
    edges = ranked.groupBy(share.alias("share")).agg(F.min("v").alias("first"), F.max("v").alias("last")).orderBy("share").collect()  # ``bins`` rows at most
    cuts = [(a["last"] + b["first"]) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    return Fitted({column: cut_label(F.col(column), cuts)}, {column: cuts})


def values_at(df: DataFrame, column: str, places: list[int]) -> list:
    """The values at places (from 0) of the sorted column, nulls left out; counts by value are summed up in cells."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = running(counts, "v", F.col("n"), "upto")
    wanted = F.array(*[F.lit(p) for p in places])
    hit = F.filter(wanted, lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))
    found = {p: r["v"] for r in upto.select("v", hit.alias("hit")).where(F.size("hit") > 0).collect() for p in r["hit"]}
    return [found[p] for p in places]


def quartiles(df: DataFrame, column: str) -> tuple[float, float]:
    """First and third quartile by place: with h = n // 2 and q = h // 2, the values at q and n - q - 1, each averaged with the one after if h is even."""
    n = df.where(F.col(column).isNotNull()).count()
    if n == 0:
        return float("nan"), float("nan")
    half = n // 2
    q = half // 2
    low, high = ([q], [n - q - 1]) if half % 2 else ([q, min(q + 1, n - 1)], [n - q - 1, min(n - q, n - 1)])
    x = values_at(df, column, [low[0], low[-1], high[0], high[-1]])
    return (x[0] + x[1]) / 2, (x[2] + x[3]) / 2


def fit_quartile_flags(df: DataFrame, column: str, outlier: float = 3.0, extreme: float = 6.0) -> Fitted:
    """Outlier and extreme flags by interquartile range, with ``quartiles``; nulls have neither."""
    q1, q3 = quartiles(df, column)
    spread = q3 - q1
    x = F.col(column)
    far = F.coalesce((x > q3 + extreme * spread) | (x < q1 - extreme * spread), F.lit(False))
    out = F.coalesce((x > q3 + outlier * spread) | (x < q1 - outlier * spread), F.lit(False)) & ~far
    return Fitted({}, {"q1": q1, "q3": q3, "outlier": out, "extreme": far})


#: Words of a table that is sent to all tasks; a larger one meets the documents in a shuffle.
FEW_WORDS = 1_000_000


def _words(df: DataFrame, key: str, text: str, lower: bool = True) -> DataFrame:
    """(key, word): texts are shuffled by key before they become words, which take several times as much, so that words are
    counted where they are."""
    x = F.lower(F.col(text)) if lower else F.col(text)
    return df.select(key, text).repartition(key).select(key, F.explode(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("word"))


def _small(words: DataFrame) -> DataFrame:
    """``words`` staged, and sent to all tasks if they are few."""
    from .staging import cut

    words = cut(words)
    return F.broadcast(words) if words.count() <= FEW_WORDS else words


def word_counts(df: DataFrame, key: str, text: str, lower: bool = True) -> DataFrame:
    """(key, word, n, tf, df) of every document, by exploding words; no vocabulary is gathered."""
    counts = _words(df, key, text, lower).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    spread = _small(counts.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    return counts.join(spread, "word").select(key, "word", "n", F.log1p("n").alias("tf"), "df")


def word_vectors(df: DataFrame, key: str, text: str, dictionary: DataFrame | None = None, words: int = 1000, least: int = 1, stop: tuple[str, ...] = (), tf: bool = False, idf: bool = False, normalize: bool = False) -> DataFrame:
    """(key, word, weight): counts of the dictionary's words in each document, the long form of a word matrix.

    The dictionary is a table with a column ``word`` or, if None, the ``words`` most frequent words (ties by word) that
    occur ``least`` times and are no stop words. ``tf`` takes log(1 + count), ``idf`` multiplies by log(documents /
    documents with the word), ``normalize`` scales each vector to the mean Euclidean length of all.
    """
    tokens = _words(df, key, text)
    counts = tokens.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy("word").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df"))
    if dictionary is None:
        chosen = spread.where((F.col("total") >= least) & ~F.col("word").isin(*stop, "")).orderBy(F.desc("total"), "word").limit(words)
    else:
        chosen = spread.join(dictionary.select("word").distinct(), "word")
    chosen = _small(chosen)
    counts = tokens.join(chosen.select("word"), "word", "left_semi").groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    out = counts.join(chosen, "word").withColumn("weight", F.log1p("n") if tf else F.col("n").cast("double"))
    if idf:
        out = out.withColumn("weight", F.col("weight") * F.log(F.lit(float(df.count())) / F.col("df")))
    if normalize:
        lengths = out.groupBy(F.col(key).alias("_k")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_length"))
        mean = lengths.agg(F.avg("_length")).first()[0] or 0.0
        out = out.join(lengths, F.col(key) == F.col("_k")).withColumn("weight", F.when(F.col("_length") > 0, F.col("weight") * mean / F.col("_length")).otherwise(0.0))
    return out.select(key, "word", "weight")


def numeric_to_nominal(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as labels: their text."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in columns else F.col(c) for c in df.columns])


def label_table(df: DataFrame, column: str, by: str = "label", descending: bool = False) -> DataFrame:
    """(label, n, place): the label domain in order of the labels or of their ``frequency`` (ties by label); a null is none."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    first = F.col("n") if by == "frequency" else F.col("label")
    order = Window.orderBy(first.desc() if descending else first.asc(), "label")  # a row a label
    return counts.withColumn("place", (F.row_number().over(order) - 1).cast("int"))


def with_label_place(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of its label in a ``label_table``; labels outside of it, and nulls, have none."""
    table = labels.select(F.col("label").alias("_label"), F.col("place").alias(name))
    return df.join(table, F.col(column) == F.col("_label"), "left").drop("_label")


def random_subset(df: DataFrame, share: float, seed: int = 1, keep: tuple[str, ...] = (), invert: bool = False) -> DataFrame:
    """A random choice of columns, in their order: a share below 1, else a number; ``keep`` stay in any case."""
    import random

    free = [c for c in df.columns if c not in keep]
    n = round(share * len(free)) if share < 1 else min(int(share), len(free))
    chosen = set(random.Random(seed).sample(free, n))
    return df.select(*[c for c in df.columns if c in keep or (c in chosen) != invert])


def multi_filter(df: DataFrame, parts: list[tuple[list[str], Callable[[DataFrame, list[str]], Fitted]]]) -> DataFrame:
    """Each fitted filter on its own columns: parts of (columns, fit function)."""
    out = df
    for columns, fit in parts:
        out = fit(df, columns).transform(out)
    return out


def transpose(df: DataFrame, key: str) -> DataFrame:
    """(attribute, one column for each key): for tables of few rows, whose keys become columns. All values become doubles."""
    long = df.unpivot(key, [F.col(c).cast("double").alias(c) for c in df.columns if c != key], "attribute", "value")
    return long.groupBy("attribute").pivot(key).agg(F.first("value"))


def fit_principal_components(df: DataFrame, columns: list[str], standardize: bool = True, variance: float = 0.95) -> tuple[Callable[[DataFrame], DataFrame], list[float]]:
    """(filter, variances): projections PC1.. on the components that together explain ``variance``.

    The correlation (or covariance) matrix is one aggregation; only the matrix comes to the driver. Nulls count as the
    mean. The sign is such that a component's largest loading (of equals, the first) is positive.
    """
    import numpy as np

    s = statistics(df, columns)
    scale = {c: (s[c]["sd"] or 1.0) if standardize else 1.0 for c in columns}
    z = {c: F.coalesce((F.col(c).cast("double") - F.lit(s[c]["mean"] or 0.0)) / F.lit(scale[c]), F.lit(0.0)) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(z[a] * z[b]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    m = np.zeros((len(columns), len(columns)))
    for i, (a, b) in enumerate(pairs):
        value = (row[f"p{i}"] or 0.0) / max(1, row["n"] - 1)
        if standardize and a == b and value > 0:
            # what it is exactly: the error of a long sum, beside small correlations, would turn the components
            value = (s[a]["count"] - 1) / max(1, row["n"] - 1)
        m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = value
    values, vectors = np.linalg.eigh(m)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    kept = int(np.searchsorted(np.cumsum(values) / (values.sum() or 1), variance - 1e-12) + 1)
    loads = []
    for k in range(min(kept, len(columns))):
        v = vectors[:, k]
        lead = int(np.argmax(np.round(np.abs(v), 9)))
        loads.append(v * (1 if v[lead] >= 0 else -1))

    def apply(rows: DataFrame) -> DataFrame:
        new = [sum((z[c] * float(w) for c, w in zip(columns, load, strict=True)), F.lit(0.0)).alias(f"PC{k + 1}") for k, load in enumerate(loads)]
        return rows.select(*[c for c in rows.columns if c not in columns], *new)

    return apply, [float(x) for x in values]


def random_projection(df: DataFrame, columns: list[str], dims: int, seed: int = 42, gaussian: bool = False) -> DataFrame:
    """Columns K1.. from a fixed random matrix of literals; nulls count as 0."""
    import random

    draw = random.Random(seed)
    entry = (lambda: draw.gauss(0, 1)) if gaussian else (lambda: draw.choice((-(3**0.5), 0.0, 0.0, 0.0, 0.0, 3**0.5)))
    new = []
    for k in range(dims):
        weights = [entry() for _ in columns]
        total = F.lit(0.0)
        for c, w in zip(columns, weights, strict=True):
            if w:
                total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
        new.append(total.alias(f"K{k + 1}"))
    return df.select(*[c for c in df.columns if c not in columns], *new)
