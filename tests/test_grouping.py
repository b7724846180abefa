"""Groups of attributes, the search over them, and searches and choices that no query runs."""

import numpy as np
from pyspark.sql import functions as F

from gradus.operators import columns as C
from gradus.operators import grouping as P
from gradus.operators import selection as S


def test_groups_and_search(spark):
    g = np.random.default_rng(7)
    x, y, z = g.normal(size=(3, 200))
    rows = [(float(a), float(2 * a), float(a + 0.3 * b), float(b), float(c), 1.0, float(a + b)) for a, b, c in zip(x, y, z)]
    names = ["x", "twice", "near", "y", "z", "flat"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "t"]))
    groups = P.correlation_groups(df, names, "t", threshold=0.8, cutoff=1 - 1e-9)
    table = np.abs(np.nan_to_num(np.corrcoef(np.array(rows).T + 0.0)))
    want = sorted(names, key=lambda c: (-round(table[names.index(c), 6], 12), names.index(c)))
    assert groups.order == want and groups.needless in ({"twice"}, {"x"})
    kept = next(c for c in groups.order if c in ("x", "twice"))
    assert groups.members["near"] == {"near", "x", "twice"} and groups.members[kept] == {kept, "near"} and groups.members["z"] == {"z"}
    tried = []

    def merit(subset):
        tried.append(subset)
        return len(subset & {"near", "y"}) / 2

    assert P.grouped_forward(names, groups, merit) == ["y", "near"] or P.grouped_forward(names, groups, merit) == ["near", "y"]
    # of a group one is tried a step
    assert not any("x" in s and len(s) == 1 for s in tried)
    assert P.correlation_groups(df, ["z"], "t", threshold=-1).members == {"z": {"z"}}
    assert P.grouped_forward(names, groups, lambda s: 1.0, prune=True)


def test_backward_and_ranker(spark):
    merit = lambda s: len(s & {"a", "c"})
    assert S.greedy_backward(["a", "b", "c", "d"], merit, 2) == ["a", "c"]
    scores = spark.createDataFrame([("a", 0.2), ("b", 0.9), ("c", 0.2), ("d", 0.1)], "attribute string, score double")
    assert [r.attribute for r in S.ranked(scores, "score", n=2).collect()] == ["b", "a"]
    assert [r.attribute for r in S.ranked(scores, "score", threshold=0.2).collect()] == ["b", "a", "c"]


def test_random_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    some = C.random_subset(df, 2, seed=3, keep=("d",)).columns
    assert len(some) == 3 and some[-1] == "d" and some == C.random_subset(df, 2, seed=3, keep=("d",)).columns
    rest = C.random_subset(df, 2, seed=3, keep=("d",), invert=True).columns
    assert set(some) | set(rest) == set("abcd") and set(some) & set(rest) == {"d"}
    assert len(C.random_subset(df, 0.5, seed=1).columns) == 2


def test_binary_columns_by_mean(spark):
    df = spark.createDataFrame([("u", 1.0), ("v", 5.0), ("w", 3.0), (None, 9.0)], "s string, y double")
    out = C.fit_one_hot_by_mean(df, "s", "y")(df).orderBy(F.col("y")).collect()
    assert out[0].asDict() == {"y": 1.0, "s>u": 0.0, "s>w": 0.0} and out[1].asDict() == {"y": 3.0, "s>u": 1.0, "s>w": 0.0}
    assert out[2].asDict() == {"y": 5.0, "s>u": 1.0, "s>w": 1.0} and out[3]["s>u"] is None
