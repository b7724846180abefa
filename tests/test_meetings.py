"""Nearest rows by block meetings against loops, on odd rows."""

import numpy as np
import pytest

from gradus.operators import graded as G
from gradus.operators import meetings as M
from gradus.operators import neighbours as N

ROWS = "k string, x double, y int, c string"


def table(n=60):
    g = np.random.default_rng(6)
    rows = [(f"k{i}", None if i % 11 == 2 else round(float(g.random()), 2), int(g.integers(0, 6)), None if i % 17 == 3 else "pqr"[int(g.integers(0, 3))]) for i in range(n)]
    return [*rows, (None, 0.5, 1, "p"), ("z", 0.5, None, "q")]


def spreads(rows):
    return [max(v) - min(v) for v in ([r[i] for r in rows if r[i] is not None] for i in (1, 2))]


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    rows = table()
    df, spread = spark.createDataFrame(rows, ROWS).repartition(3), spreads(rows)
    sim = lambda a, b: sum(1.0 if a[i] is None or b[i] is None else max(0.0, 1 - abs(a[i] - b[i]) / spread[i - 1]) for i in (1, 2)) / 2
    found = {}
    for r in N.nearest(df, df, "k", ["x", "y"], "c", 4).collect():
        found.setdefault(r["query"], []).append((r.r, r.k, r.c, r.sim))
    for a in rows:
        if a[0] is None:
            continue
        best = sorted(((-sim(a, b), b[0], b[3]) for b in rows if b[0] not in (None, a[0]) and b[3] is not None))[:4]
        assert [(r, k, c) for r, k, c, _ in sorted(found[a[0]])] == [(i + 1, k, c) for i, (_, k, c) in enumerate(best)]
    assert None not in found
    assert N.nearest(df, df.limit(0), "k", ["x"], "c").count() == N.nearest(df.limit(0), df, "k", ["x"], "c").count() == 0
    # the target may be an attribute, and the key its own attribute
    number = df.selectExpr("y as n", "x").where("n is not null").dropDuplicates(["n"])
    assert N.nearest(number, number, "n", ["n", "x"], "x", 2).where("query = n").count() == 0
    mean = N.fuzzy_rough_nn(N.nearest(df, df, "k", ["x", "y"], "c", 4), "c", mean=True).collect()
    assert mean and all(0 <= r.score <= 1 for r in mean)
    with pytest.raises(ValueError):
        N.nearest(df, df, "k", ["x"], "c", 0)


def test_relief(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 9)
    rows, k = table(), 3
    known, spread = [r for r in rows if r[0] is not None and r[3] is not None], spreads(rows)
    share = {c: sum(r[3] == c for r in known) / len(known) for c in "pqr"}
    want = [0.0, 0.0]
    for a in known:
        for c in "pqr":
            diffs = []
            for b in known:
                if b[3] == c and b[0] != a[0]:
                    d = [0.5 if a[i] is None or b[i] is None else abs(a[i] - b[i]) / spread[i - 1] for i in (1, 2)]
                    diffs.append((sum(d), b[0], d))
            near = sorted(diffs)[:k]
            weight = -1 if c == a[3] else share[c] / (1 - share[a[3]])
            for i in (0, 1):
                want[i] += weight * sum(d[i] for _, _, d in near) / len(near) / len(known)
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    found = {r.attribute: r.weight for r in G.relief_scores(df, "k", ["x", "y"], "c", k).collect()}
    assert abs(found["x"] - want[0]) < 1e-9 and abs(found["y"] - want[1]) < 1e-9
    assert len(G.relief_scores(df, "k", ["x", "y"], "c", k, most=10).collect()) == 2


@pytest.mark.parametrize("kind", ["linear", "gaussian", "tolerance", "slope", "equal", "squared"])
def test_arrays_are_the_columns(spark, kind):
    from pyspark.sql import functions as F

    from gradus.functions import arrays, degrees

    stats = [{"min": 0.0, "max": 2.0, "sd": 0.7}, {"min": 0.0, "max": 1.0, "sd": 0.3}]
    values = [(0.0, 0.5), (1.0, None), (2.0, 1.0), (0.25, 0.25)]
    df = spark.createDataFrame([(i, j, *a, *b) for i, a in enumerate(values) for j, b in enumerate(values)], "i int, j int, a double, b double, c double, d double")
    x = np.array([[np.nan if v is None else v for v in r] for r in values])
    for norm in arrays.T_NORMS:
        sim = degrees.fold(norm, [degrees.known(degrees.SIMILARITIES[kind](F.col(p), F.col(q), s)) for p, q, s in (("a", "c", stats[0]), ("b", "d", stats[1]))])
        want = {(r.i, r.j): r.s for r in df.select("i", "j", sim.alias("s")).collect()}
        found = arrays.similarities(x, x, kind, norm, stats)
        assert all(abs(found[i, j] - s) < 1e-12 for (i, j), s in want.items())


def test_class_similarities(spark, monkeypatch):
    from gradus.operators import measures

    monkeypatch.setattr(M, "BLOCK", 6)
    rows = table(40)
    rows += [rows[0], rows[1]]
    known, spread = [r for r in rows if r[3] is not None], spreads(rows)
    sim = lambda a, b: max(0.0, 1 - sum(min(1.0, abs(a[i] - b[i]) / spread[i - 1]) for i in (1, 2) if a[i] is not None and b[i] is not None))
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    enemy = [[sim(a, b) for b in known if b[3] != a[3]] for a in known]
    g = measures.gamma(df, ["x", "y"], "c").first()
    lower = [1 - max(e) for e in enemy]
    assert abs(g.gamma - sum(lower) / len(lower)) < 1e-9 and abs(g.delta - min(lower)) < 1e-9
    whole = [[sim(a, b) for b in known] for a in known]
    assert abs(measures.granularity(df, ["x", "y"], "c").first()[0] - np.mean(whole)) < 1e-9
    n = len(known)
    assert abs(measures.discernibility(df, ["x", "y"], "c").first()[0] - (1 - sum(map(sum, enemy)) / n / (n - 1))) < 1e-9
    assert abs(measures.discernibility(df, ["x", "y"], "c", implicator="goedel").first()[0] - (1 - sum(v > 0 for e in enemy for v in e) / n / (n - 1))) < 1e-9
    assert measures.class_similarities(df.limit(0), ["x", "y"], "c").count() == 0


@pytest.mark.parametrize("implicator", ["lukasiewicz", "kleene_dienes", "gaines"])
def test_weak_owa_without_pairs(spark, monkeypatch, implicator):
    """Blocks against the table of all pairs: repeated rows, unknown values, labels and numbers as the class."""
    from gradus.operators import graded as G

    monkeypatch.setattr(G, "BLOCK", 7)
    monkeypatch.setattr(G, "STRIP", 3)
    rows = [(None if i % 11 == 3 else (i * 7 % 10) / 10, float(i % 6), "abc"[i % 3] if i % 13 else None, float(i * 5 % 8)) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, y double, c string, t double").repartition(3)
    for target in ("c", "t"):
        found = G.weak_owa_of(df, ["x", "y"], target, implicator=implicator)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.first()[0] == pytest.approx(G.weak_owa(G.graded_pairs(df, ["x", "y"], target), implicator).first()[0], abs=1e-9)
