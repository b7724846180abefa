"""The search by bounds of blocks: what it finds against loops, and how few blocks meet."""

import numpy as np
import pytest

from gradus.operators import meetings as M


def exact(x, y):
    return -np.round(np.nan_to_num(np.abs(x[:, None, :] - y[None, :, :])).sum(2), 9)


def closeness(least, most):
    return -least.sum(1)


def table(n, seed=4):
    g = np.random.default_rng(seed)
    return [(i, None if i % 19 == 4 else round(float(g.random()), 2), round(float(g.random()), 2), "abc"[int(g.integers(0, 3))]) for i in range(n)]


@pytest.mark.parametrize("relation, k", [("any", 3), ("enemy", 1), ("friend", 2), ("each", 2)])
def test_closest(spark, relation, k):
    rows = table(120)
    df = spark.createDataFrame(rows, "i long, x double, y double, c string")
    asked = M.placed(df.selectExpr("i as q", "c as qc", "x", "y"), ["q", "qc"], ["x", "y"], 7, "qc")
    others = M.placed(df, ["i", "c"], ["x", "y"], 7, "c")
    found = {}
    for r in M.closest(asked, others, ["q"], ["i", "c"], exact, closeness, k, relation, ("q", "i"), ("qc", "c")).collect():
        found.setdefault(r.q, []).append((round(-r._close, 9), r.i))
    far = lambda a, b: round(sum(abs(a[j] - b[j]) for j in (1, 2) if a[j] is not None and b[j] is not None), 9)
    for a in rows:
        groups = {"any": [rows], "enemy": [[b for b in rows if b[3] != a[3]]], "friend": [[b for b in rows if b[3] == a[3]]], "each": [[b for b in rows if b[3] == c] for c in "abc"]}[relation]
        want = [v for g in groups for v in sorted((far(a, b), b[0]) for b in g if b[0] != a[0])[:k]]
        assert sorted(found[a[0]]) == sorted(want)


def test_few_blocks_meet(spark):
    """Meetings of a block stay about as many when there are four times as many rows."""
    share = []
    for size in (3000, 12000):
        df = spark.createDataFrame([r for r in table(size) if r[1] is not None], "i long, x double, y double, c string")
        blocks = M.placed(df, ["i", "c"], ["x", "y"], 25, "c")
        pairs = blocks.mapInArrow(M._wanted_pairs(M._boxes(blocks), closeness, "enemy", 1, 0.0), "_a long, _b long, _best double").count()
        share.append(pairs / blocks.count())
    assert share[1] < 1.5 * share[0]
