"""Discernibility clauses, the measure and the reduct against loops over all pairs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradus.operators import clauses as L
from gradus.operators import oversampling as B

from .test_oversampling import ROWS, spreads, table


def pairs(rows):
    spread, out = spreads(rows), Counter()
    known = [r for r in rows if r[4] is not None]
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if a[4] != b[4]:
                numbers = [0.0 if a[c] is None or b[c] is None else round(abs(a[c] - b[c]) / spread[c - 1], 9) for c in (1, 2)]
                out[(*numbers, float(a[3] is not None and b[3] is not None and a[3] != b[3]))] += 1
    return out


@pytest.mark.parametrize("norm", ["lukasiewicz", "max"])
def test_clauses(spark, monkeypatch, norm):
    monkeypatch.setattr(B, "BLOCK", 8)
    monkeypatch.setattr(L, "STRIP", 3)
    rows = [(k, None if x is None else round(x * 4) / 4, y, s, c) for k, x, y, s, c in table(5, 50)]
    found = L.clauses(spark.createDataFrame(rows, ROWS).repartition(3), ["x", "y"], "c", ["s"]).persist()
    want = pairs(rows)
    same = {tuple(round(d, 7) for d in r.degrees): r.pairs for r in found.collect()}
    assert same == {tuple(round(d, 7) for d in k): n for k, n in want.items()}

    def fold(clause, places):
        own = [clause[i] for i in places]
        return round(min(1.0, sum(own)) if norm == "lukasiewicz" else max([*own, 0.0]), 9)

    subsets = [[], [1], [0, 2], [0, 1, 2]]
    for mean in (True, False):
        values = [[fold(c, s) for c in want] for s in subsets]
        plain = [sum(v) / len(v) if mean else max(0.0, 1 - sum(1 - x for x in v)) if norm == "lukasiewicz" else min(v) for v in values]
        assert all(abs(a - b) < 1e-6 for a, b in zip(L.clause_merits(found, subsets, norm, mean), plain))
    least = {c for c in want if not any(all(x <= y for x, y in zip(o, c)) and o != c and fold(o, range(3)) >= fold(c, range(3)) for o in want)}
    assert {tuple(round(d, 7) for d in r.degrees) for r in L.least_clauses(found, norm).collect()} == {tuple(round(d, 7) for d in c) for c in least}
    chosen = []
    while open_ := [c for c in want if fold(c, chosen) < fold(c, range(3))]:
        rest = [i for i in range(3) if i not in chosen]
        only = [i for i in rest for c in open_ if sum(d > 0 for d in c) == 1 and c[i] > 0]
        chosen.append(min(only) if only else max(rest, key=lambda i: (round(sum(c[i] for c in open_), 6), -i)))
    assert L.greedy_reduct(found, 3, norm) == chosen
    found.unpersist()


def test_no_clauses(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, "u", "a"), (2, 0.1, 2.0, None, "a"), (3, 0.3, 1.0, "u", None)], ROWS)
    found = L.clauses(df, ["x"], "c", ["s"])
    assert found.count() == 0 and L.clause_merits(found, [[0]]) == [1.0] and L.greedy_reduct(found, 2) == []
    assert L.least_clauses(found).count() == 0


def test_copies_meet_once(spark):
    """Clauses of 200,000 rows of ten kinds: copies are a weight, not rows that meet."""
    i = F.col("id")
    df = spark.range(200_000).select((i % 5).cast("double").alias("x"), (i % 2).cast("string").alias("c"))
    found = {tuple(r.degrees): r.pairs for r in L.clauses(df, ["x"], "c").collect()}
    # each of the ten kinds has 20,000 rows
    want = Counter()
    for a in range(5):
        for b in range(5):
            want[(abs(a - b) / 4,)] += 20_000**2
    assert found == want
    assert L.greedy_reduct(L.least_clauses(L.clauses(df, ["x"], "c")), 1) == [0]
