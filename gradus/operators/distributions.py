"""Classes drawn anew from distributions that are fitted to them.

Parameters of every class and column are one aggregation; draws are digests of (seed, class, number, column), so reruns
agree, but for the last digits of means.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .oversampling import _slots, uniform

KINDS = ("uniform", "gaussian", "poisson", "multinomial")
#: From this mean on, Poisson numbers are rounded normal ones.
LARGE = 30.0
#: Poisson numbers below ``LARGE`` end here: their chance of more is under 10**-30.
_MOST = 150


def parameters(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(class, n, low, high, mean, sd, total): of each class arrays over ``columns`` (sample deviations), nulls left out."""
    each = lambda f: F.array(*[f(F.col(c).cast("double")) for c in columns])
    known = df.where(F.col(target).isNotNull())
    return known.groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"), each(F.min).alias("low"), each(F.max).alias("high"), each(F.avg).alias("mean"), each(F.stddev_samp).alias("sd"), each(lambda c: F.coalesce(F.sum(c), F.lit(0.0))).alias("total"))


def normal(*parts) -> Column:
    """A fixed standard normal number for each value of the parts."""
    return F.sqrt(-2 * F.log(1 - uniform(*parts, "r"))) * F.cos(F.lit(2 * pi) * uniform(*parts, "t"))


def poisson(mean: Column, *parts) -> Column:
    """A fixed Poisson number: how many values of the distribution function lie below a uniform one; from ``LARGE`` on, a rounded normal one."""
    u = uniform(*parts)
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.when(F.exp(-mean) < u, 1).otherwise(0).alias("k"))
    step = lambda s, i: F.struct((s["p"] * mean / i).alias("p"), (s["below"] + s["p"] * mean / i).alias("below"), (s["k"] + F.when(s["below"] + s["p"] * mean / i < u, 1).otherwise(0)).alias("k"))
    small = F.aggregate(F.sequence(F.lit(1), F.lit(_MOST)), start, step, lambda s: s["k"].cast("double"))
    return F.when(mean < LARGE, small).otherwise(F.greatest(F.lit(0.0), F.floor(mean + F.sqrt(mean) * normal(*parts) + 0.5).cast("double")))


def resample_from_distributions(df: DataFrame, columns: list[str], target: str, kind: str = "gaussian", n: int = 30, classes: list | None = None, negative: bool = False, seed: int = 1) -> DataFrame:
    """``df`` with the rows of ``classes`` (all, if not named) replaced by ``n`` rows a class, drawn by column.

    ``uniform`` draws between a class's least and greatest, ``gaussian`` and ``poisson`` by its means; ``multinomial`` draws a
    Poisson number of counts by the class's mean total and deals them out over the columns by their shares of it. Numbers
    below 0 become 0 unless ``negative`` are allowed. A column that a class doesn't know is null; other columns are null in
    drawn rows. Rows without a class stay; a named class without rows is none.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    fitted = parameters(df, columns, target)
    if classes is not None:
        fitted = fitted.where(F.col("class").isin([str(c) for c in classes]))
    names = [r[0] for r in fitted.select("class").collect()]  # a row a class
    slots = _slots(df, {c: n for c in names}).join(F.broadcast(fitted), "class")
    key = lambda *more: (seed, F.col("class"), F.col("slot"), *more)
    floor0 = (lambda x: x) if negative else (lambda x: F.greatest(x, F.lit(0.0)))
    types = dict(df.dtypes)
    if kind == "multinomial":
        whole = F.aggregate("total", F.lit(0.0), lambda a, b: a + b)
        trials = slots.select("class", "slot", "total", whole.alias("_whole"), poisson(whole / F.col("n"), *key("n")).cast("int").alias("_trials"))
        dealt = trials.where("_trials > 0").select("class", "slot", "total", "_whole", F.explode(F.sequence(F.lit(1), F.col("_trials"))).alias("_t"))
        place, upto = F.lit(0), F.lit(0.0)
        for i in range(len(columns) - 1):
            upto = upto + F.col("total")[i] / F.col("_whole")
            place = place + (uniform(*key(F.col("_t"))) >= upto).cast("int")
        counts = dealt.withColumn("_at", place).groupBy("class", "slot").agg(*[F.count_if(F.col("_at") == i).alias(f"_c{i}") for i in range(len(columns))])
        found = trials.select("class", "slot").join(counts, ["class", "slot"], "left")
        drawn = [F.coalesce(F.col(f"_c{i}"), F.lit(0)).cast("double") for i in range(len(columns))]
    else:
        found = slots
        if kind == "uniform":
            drawn = [floor0(F.col("low")[i] + uniform(*key(i)) * (F.col("high")[i] - F.col("low")[i])) for i in range(len(columns))]
        elif kind == "gaussian":
            drawn = [floor0(F.when(F.col("mean")[i].isNotNull(), F.col("mean")[i] + normal(*key(i)) * F.coalesce(F.col("sd")[i], F.lit(0.0)))) for i in range(len(columns))]
        else:
            drawn = [floor0(poisson(F.greatest(F.col("mean")[i], F.lit(0.0)), *key(i))) for i in range(len(columns))]
        if not negative:
            drawn = [F.when(F.col("mean")[i].isNotNull(), d) for i, d in enumerate(drawn)]
    # a whole number's column takes what was drawn rounded to the nearest
    fit = lambda x, c: (x if types[c] in ("double", "float") else F.round(x)).cast(types[c])
    new = found.select(F.col("class").cast(types[target]).alias(target), *[fit(d, c).alias(c) for c, d in zip(columns, drawn)])
    gone = F.col(target).cast("string").isin(names) if names else F.lit(False)
    return df.where(~F.coalesce(gone, F.lit(False))).unionByName(new, allowMissingColumns=True)
