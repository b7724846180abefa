"""Mixtures by class and leaves of trees against plain walks."""

import math

import numpy as np
from pyspark.sql import functions as F

from gradus.operators import densities as D
from gradus.operators import partitions as T


def table():
    g = np.random.default_rng(4)
    return [(i, None if i % 11 == 4 else round(float(g.normal(3 * (i % 2) + (i % 3 == 0) * 8, 1)), 3), round(float(g.normal((i % 3 == 0) * 5, 2)), 3), None if i % 19 == 5 else "pq"[i % 2]) for i in range(120)]


def plain(rows, k, rounds):
    out = []
    for c in "pq":
        x = np.array([[np.nan if v is None else v for v in r[1:3]] for r in rows if r[3] == c], float)
        known = ~np.isnan(x)
        mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
        w, m, s = np.full(k, 1 / k), np.array([mean + 1.5 * ((2 * j + 1) / k - 1) * sd for j in range(k)]), np.array([sd] * k)
        for _ in range(rounds):
            logs = np.log(w) + np.stack([np.nansum(-0.5 * ((x - m[j]) / s[j]) ** 2 - np.log(s[j]) - 0.5 * math.log(2 * math.pi), 1) for j in range(k)], 1)
            r = np.exp(logs - logs.max(1, keepdims=True))
            r /= r.sum(1, keepdims=True)
            w = r.mean(0)
            m = np.array([np.nansum(r[:, j, None] * x, 0) / (r[:, j, None] * known).sum(0) for j in range(k)])
            s = np.array([np.sqrt(np.nansum(r[:, j, None] * (x - m[j]) ** 2, 0) / (r[:, j, None] * known).sum(0)) for j in range(k)])
        out.append((len(x), w, m, s))
    return out


def test_mixtures(spark):
    rows = table()
    df = spark.createDataFrame(rows, "k long, x double, y double, c string")
    found = D.fit_mixtures(df, ["x", "y"], "c", k=2, rounds=6, enough=0)
    want = plain(rows, 2, 6)
    for f, (n, w, m, s) in zip(found, want):
        assert abs(f.prior - n / sum(v[0] for v in want)) < 1e-12
        assert np.allclose(f.weights, w) and np.allclose(f.means, m) and np.allclose(f.sds, s)
    out = D.cluster_membership(df, ["x", "y"], found, ["k", "c"])
    assert out.columns == ["k", "c", "pCluster_0_0", "pCluster_0_1", "pCluster_1_0", "pCluster_1_1"]
    for r in out.collect():
        assert abs(sum(r[2:]) - 1) < 1e-9
        x, y = rows[r.k][1:3]
        logs = [math.log(f.prior * w) + sum(-0.5 * ((v - a) / b) ** 2 - math.log(b) - 0.5 * math.log(2 * math.pi) for v, a, b in zip((x, y), m, s) if v is not None) for f in found for w, m, s in zip(f.weights, f.means, f.sds)]
        whole = sum(math.exp(v) for v in logs)
        assert np.allclose(r[2:], [math.exp(v) / whole for v in logs])
    assert len(D.fit_mixtures(df, ["x"], k=3)[0].weights) == 3
    assert D.fit_mixtures(df.limit(0), ["x"], "c", k=2) == [] and D.fit_mixtures(df.limit(0), ["x"]) == []
    flat = D.fit_mixtures(df.withColumn("x", F.lit(1.0)), ["x"], k=1)[0]
    assert flat.means == [[1.0]] and flat.sds == [[D.LEAST_SD]]


def test_leaves_by_the_printed_tree(spark):
    import re

    from pyspark.ml.classification import RandomForestClassifier

    rows = table()
    df = spark.createDataFrame(rows, "k long, x double, y double, c string")
    model = T.fit_partition(df, ["x", "y"], "c", RandomForestClassifier(numTrees=3, maxDepth=3, seed=2))

    def walk(tree, row):
        lines, leaf, at = [(len(t) - len(t.lstrip()), t.strip()) for t in tree.toDebugString.splitlines()[1:] if t.strip()], 0, 0
        # a condition's block is taken or skipped; leaves that are skipped count
        while True:
            depth, text = lines[at]
            if text.startswith("Predict"):
                return leaf
            f, op, v = re.match(r".*\(feature (\d) (<=|>) (.*)\)", text).groups()
            x = row[1 + int(f)]
            if (x <= float(v)) if op == "<=" else (x > float(v)):
                at += 1
                continue
            at += 1
            while lines[at][0] > depth:
                leaf += lines[at][1].startswith("Predict")
                at += 1

    sizes = T.leaves(model)
    wide = {r.k: r for r in T.partition_membership(df, "k", ["x", "y"], model).collect()}
    for row in rows:
        values = wide[row[0]][1:]
        if row[1] is None:
            assert set(values) == {None}
            continue
        start = 0
        for tree, n in zip(model.trees, sizes):
            own = values[start : start + n]
            assert sum(own) == 1 and own.index(1) == walk(tree, row)
            start += n
