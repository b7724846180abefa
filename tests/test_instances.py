"""Row filters by graded memberships against brute force, on odd rows too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import instances as I
from gradus.sources import tables as T

ROWS = "k long, a double, b double, c string"


def brute(rows):
    known = [r for r in rows if r[3] is not None]
    spread = []
    for i in (1, 2):
        v = [r[i] for r in rows if r[i] is not None]
        spread.append((max(v) - min(v)) or 1.0)
    out = {}
    for r in rows:
        if r[3] is None:
            out[r[0]] = None
            continue
        sims = [1 - sum(abs(r[i] - o[i]) / spread[i - 1] for i in (1, 2) if r[i] is not None and o[i] is not None) for o in known if o[3] != r[3]]
        out[r[0]] = 1 - max([0.0, *sims])
    return out


def test_lower_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 7)
    g = np.random.default_rng(3)
    rows = [(i, None if i % 11 == 0 else round(float(g.random()), 3), round(float(g.random()), 3), None if i % 13 == 0 else "xyz"[i % 3]) for i in range(60)]
    rows += [(100, *rows[1][1:]), (101, *rows[1][1:])]
    found = {r["k"]: r["lower"] for r in I.with_lower(spark.createDataFrame(rows, ROWS).repartition(3), ["a", "b"], "c").collect()}
    want = brute(rows)
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert (found[k] is None) == (v is None) and (v is None or abs(found[k] - v) < 1e-9)


def test_lower_without_enemies_and_rows(spark):
    one = spark.createDataFrame([(1, 0.5, 0.5, "x"), (2, 0.1, None, "x")], ROWS).withColumn("lower", F.lit("old"))
    assert {r["lower"] for r in I.with_lower(one, ["a", "b"], "c").collect()} == {1.0}
    assert I.with_lower(one.limit(0), ["a", "b"], "c").count() == 0


def test_undersample_keeps_ratio_and_rows_without_class(spark):
    rows = [(i, float(i), 0.0, "m" if i < 30 else "f") for i in range(40)] + [(99, 1.0, 0.0, None)]
    out = I.undersample_safest(spark.createDataFrame(rows, ROWS), "k", ["a", "b"], "c", "m", 2.0).collect()
    # the farther from the others, the safer
    assert sorted(r["k"] for r in out) == [*range(10, 40), 99]


def test_impute_labels_and_numbers(spark):
    rows = [(1, 0.0, 1.0, "x"), (2, 0.1, 2.0, "x"), (3, 1.0, 9.0, "y"), (4, 0.05, None, None), (5, 0.95, 8.0, "y")]
    df = spark.createDataFrame(rows, ROWS)
    assert {r["k"]: r["c"] for r in I.impute(df, "k", ["a"], "c", 2).collect()}[4] == "x"
    assert abs({r["k"]: r["b"] for r in I.impute(df, "k", ["a"], "b", 2).collect()}[4] - 1.5) < 1e-6
    assert I.impute(df.withColumn("b", F.lit(None).cast("double")), "k", ["a"], "b").where("b is null").count() == 5


def test_misclassified_rows_go(spark):
    rows = [(i, float(i > 9) + i / 1000, 0.0, "x" if i < 10 else "y") for i in range(20)] + [(50, 0.0, 0.0, "y"), (51, 1.0, 0.0, None)]
    kept = I.remove_misclassified(spark.createDataFrame(rows, ROWS), "k", ["a"], "c", 3)
    assert sorted(r["k"] for r in kept.collect()) == [*range(20), 51]


def test_clusters(spark):
    rows = [(i, float(i % 2) * 10 + i / 100, 0.0, None) for i in range(20)] + [(20, None, 0.0, None)]
    out = {r["k"]: r["cluster"] for r in I.add_cluster(spark.createDataFrame(rows, ROWS), ["a", "b"]).collect()}
    assert out[20] is None and len({out[i] for i in range(0, 20, 2)}) == 1 and out[0] != out[1]


def test_point_read(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert T.point_read(df, {"k": 1}, "v") == "a"
    for k in (2, 3):
        with pytest.raises(LookupError):
            T.point_read(df, {"k": k}, "v")
