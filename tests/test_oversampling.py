"""Synthetic rows by memberships against brute force, in small blocks and on odd rows."""

from collections import Counter
from hashlib import md5

import numpy as np
import pytest

from gradus.operators import oversampling as B

ROWS = "k long, x double, y double, s string, c string"


def table(seed=1, n=70):
    g = np.random.default_rng(seed)
    return [(i, None if i % 17 == 3 else round(float(g.random()), 3), float(g.integers(0, 9)), None if i % 13 == 5 else "uvw"[int(g.integers(0, 3))], None if i % 29 == 7 else "aaaaabbbcc"[i % 10]) for i in range(n)]


def spreads(rows):
    return [max(v) - min(v) for v in ([r[i] for r in rows if r[i] is not None] for i in (1, 2))]


def similarity(a, b, spread):
    far = sum(abs(a[i] - b[i]) / spread[i - 1] for i in (1, 2) if a[i] is not None and b[i] is not None)
    return max(0.0, 1 - far - (a[3] is not None and b[3] is not None and a[3] != b[3]))


def membership(row, rows, spread, kind="standard"):
    sims = [similarity(row, r, spread) for r in rows if r[4] is not None and r[4] != row[4]]
    if not sims:
        return 1.0
    return round(1 - (max(sims) if kind == "standard" else sum(sims) / len(sims)), 9)


@pytest.mark.parametrize("kind", ["standard", "mean"])
def test_memberships(spark, monkeypatch, kind):
    monkeypatch.setattr(B, "BLOCK", 9)
    rows = table()
    found = {int(r.id): r.membership for r in B.memberships(spark.createDataFrame(rows, ROWS).repartition(3), "k", ["x", "y"], "c", ["s"], kind).collect()}
    assert found.keys() == {r[0] for r in rows if r[4] is not None}
    assert all(abs(found[r[0]] - membership(r, rows, spreads(rows), kind)) < 2e-9 for r in rows if r[4] is not None)
    with pytest.raises(ValueError):
        B.memberships(spark.createDataFrame(rows, ROWS), "k", ["x"], "c", kind="none")


@pytest.mark.parametrize("average", [False, True])
def test_rows_in_the_box_belong_to_their_class(spark, monkeypatch, average):
    monkeypatch.setattr(B, "BLOCK", 16)
    monkeypatch.setattr(B, "RUN", 5)
    rows = table()
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    out = B.oversample_in_box(df, "k", ["x", "y"], "c", ["s"], average=average).collect()
    assert sorted(map(str, (r for r in out if r.k is not None))) == sorted(map(str, df.collect()))
    new, spread, sizes = [r for r in out if r.k is None], spreads(rows), Counter(r[4] for r in rows if r[4])
    for c in "bc":
        own = [r for r in rows if r[4] == c]
        levels = [membership(r, rows, spread) for r in own]
        level = sum(levels) / len(levels) if average else min(levels)
        made = [r for r in new if r.c == c]
        assert 0 < len(made) <= sizes["a"] - sizes[c] and (average or len(made) == sizes["a"] - sizes[c])
        for r in made:
            assert min(o[1] for o in own if o[1] is not None) <= r.x <= max(o[1] for o in own if o[1] is not None) and r.s in "uvw"
            assert membership(r, rows, spread) >= level - 2e-9
    assert not [r for r in new if r.c == "a"]


@pytest.mark.parametrize("average", [False, True])
def test_later_candidates_are_drawn_where_the_earlier_do_not_fit(spark, monkeypatch, average):
    rows, tried, placed = table(4), [], B._placed
    monkeypatch.setattr(B, "_placed", lambda df, names, *rest: (tried.append(df.count()) if names.get("id") else None) or placed(df, names, *rest))
    out = B.oversample_in_box(spark.createDataFrame(rows, ROWS).repartition(3), "k", ["x", "y"], "c", ["s"], average=average).where("k is null").collect()
    u = lambda *p: int(md5("|".join(map(str, (1, *p))).encode()).hexdigest()[:13], 16) / 2**52
    spread, sizes, want, slots, tries = spreads(rows), Counter(r[4] for r in rows if r[4]), [], 0, 0
    for c in "bc":
        own = [r for r in rows if r[4] == c]
        levels = [membership(r, rows, spread) for r in own]
        level = round(sum(levels) / len(levels) if average else min(levels), 9)
        low, high = ([f(r[i] for r in own if r[i] is not None) for i in (1, 2)] for f in (min, max))
        for slot in range(1, sizes["a"] - sizes[c] + 1):
            slots += 1
            for i in range(1, 12):
                tries += 1
                row = (None, *(low[j] + u(c, slot, i, j) * (high[j] - low[j]) for j in (0, 1)), "uvw"[int(u(c, slot, i, 2) * 3)], c)
                if membership(row, rows, spread) >= level:
                    want.append(row)
                    break
    key = lambda r: (r[4], r[3], round(r[1], 9), round(r[2], 9))
    assert sorted(map(key, out)) == sorted(map(key, want))
    assert tries <= sum(tried) < 11 * slots


def test_rows_from_pairs(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 16)
    rows = table()
    df, spread = spark.createDataFrame(rows, ROWS), spreads(rows)
    out = B.oversample_by_pairs(df, "k", ["x", "y"], "c", ["s"], percent=90).collect()
    sizes = Counter(r[4] for r in rows if r[4])
    new = [r for r in out if r.k is None]
    assert len(out) - len(new) == len(rows) and Counter(r.c for r in new) == {c: int(0.9 * sizes["a"] - sizes[c]) for c in "bc"}
    weights = {r[0]: membership(r, rows, spread) for r in rows if r[4]}
    for r in new:
        # some pair of the class, both of a positive membership, explains the row
        own = [o for o in rows if o[4] == r.c and weights[o[0]] > 0]
        share = lambda a, b: weights[a[0]] / (weights[a[0]] + weights[b[0]])
        mixed = lambda a, b, i: None if a[i] is None or b[i] is None else share(a, b) * a[i] + (1 - share(a, b)) * b[i]
        same = lambda p, q: p is q or (p is not None and q is not None and abs(p - q) < 1e-9)
        assert any(same(mixed(a, b, 1), r.x) and same(mixed(a, b, 2), r.y) and r.s == (a if weights[a[0]] >= weights[b[0]] else b)[3] for a in own for b in own if a[0] != b[0])


def test_graded_smote(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 4)
    rows = table()
    df, spread = spark.createDataFrame(rows, ROWS).repartition(2), spreads(rows)
    own = [r for r in rows if r[4] == "c" and membership(r, rows, spread) > 0]
    near = {a[0]: sorted((round(1 - similarity(a, b, spread), 9) if similarity(a, b, spread) > 0 else 9.0, str(b[0])) for b in own if b[0] != a[0]) for a in own}
    for biased in (False, True):
        new = [r for r in B.graded_smote(df, "k", ["x", "y"], "c", ["s"], percent=200, k=3, biased=biased).collect() if r.k is None]
        assert {r.c for r in new} == {"c"} and len(new) == 2 * sum(r[4] == "c" for r in rows)
        on_line = 0
        for r in new:
            for a in own:
                for b in own:
                    if a[0] != b[0] and None not in (a[1], b[1], r.x) and a[2] != b[2]:
                        share = (r.y - a[2]) / (b[2] - a[2])
                        if abs(a[1] + share * (b[1] - a[1]) - r.x) < 1e-9 and -1e-9 <= share <= 1 + 1e-9:
                            on_line += 1
                            break
                else:
                    continue
                break
        assert on_line > len(new) / 2
    assert near


def test_nothing_to_make(spark):
    one = spark.createDataFrame([(1, 0.5, 1.0, "u", "a"), (2, 0.1, 2.0, None, "a"), (3, 0.3, 1.0, "u", "b"), (4, 0.2, 1.0, "v", None)], ROWS)
    for f in (B.oversample_in_box, B.oversample_by_pairs, B.graded_smote):
        assert f(one.limit(0), "k", ["x"], "c").count() == 0
        assert f(one.where("c = 'a'"), "k", ["x"], "c", ["s"]).count() == 2
    # one row of the smaller class pairs with itself, and has no neighbour
    made = [r for r in B.oversample_by_pairs(one, "k", ["x", "y"], "c", ["s"]).collect() if r.k is None]
    assert [(r.x, r.y, r.s, r.c) for r in made] == [(0.3, 1.0, "u", "b")]
    assert B.graded_smote(one, "k", ["x", "y"], "c", ["s"]).count() == 4


def test_searches_are_done_once(spark):
    """What comes out reads staged memberships and neighbours; before, each part of the plan searched anew."""
    df = spark.createDataFrame(table(), ROWS)
    for f in (B.oversample_by_pairs, B.graded_smote):
        plan = f(df, "k", ["x", "y"], "c", ["s"])._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "Scan ExistingRDD" in plan
