"""Rows drawn from fitted distributions: parameters, repeats, odd classes."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import distributions as D

ROWS = "k long, x double, y int, c string"


@pytest.fixture(scope="module")
def table(spark):
    g = np.random.default_rng(2)
    rows = [(i, float(g.normal(5, 2)), int(g.poisson(3 + 40 * (i % 3 == 0))), "pqr"[i % 3]) for i in range(90)]
    return spark.createDataFrame([*rows, (90, 1.0, 1, None), (91, None, 4, "s")], ROWS)


@pytest.mark.parametrize("kind", D.KINDS)
def test_draws(spark, table, kind):
    out = D.resample_from_distributions(table, ["x", "y"], "c", kind, 400, ["p", "r", "none"])
    rows = out.collect()
    assert out.columns == table.columns and Counter(r.c for r in rows) == {"p": 400, "r": 400, "q": 30, "s": 1, None: 1}
    again = D.resample_from_distributions(table.repartition(3), ["x", "y"], "c", kind, 400, ["p", "r", "none"]).collect()
    told = lambda part: sorted(str((r.k, None if r.x is None else round(r.x, 8), r.y, r.c)) for r in part)
    assert told(rows) == told(again)
    for c in "pr":
        old, new = (np.array([[r.x, r.y] for r in part if r.c == c]) for part in (table.collect(), rows))
        assert all(r.k is None for r in rows if r.c == c) and new.min() >= 0
        if kind == "uniform":
            assert (new[:, 0].min() >= old[:, 0].min()) and (new.max(0) <= old.max(0)).all()
        else:
            assert (np.abs(new.mean(0) - old.mean(0)) < 0.2 * old.mean(0) + 0.5).all()
        if kind == "multinomial":
            assert (new == new.round()).all()


def test_odd_classes(spark, table):
    for kind in ("uniform", "gaussian", "poisson"):
        one = [r for r in D.resample_from_distributions(table, ["x", "y"], "c", kind, 5, ["s"]).collect() if r.c == "s"]
        assert len(one) == 5 and {r.x for r in one} == {None} and (kind == "poisson" or {r.y for r in one} == {4})
    low = D.resample_from_distributions(table.withColumn("x", -F.abs("x")), ["x"], "c", "gaussian", 50, ["p"], negative=True).where("c = 'p'")
    assert low.where("x < 0").count() > 40 and low.where("y is not null").count() == 0
    assert D.resample_from_distributions(table.limit(0), ["x"], "c").count() == 0
    with pytest.raises(ValueError):
        D.resample_from_distributions(table, ["x"], "c", "none")
