"""Coverage removal in rounds against the walk in order."""

import pytest

from gradus.operators import oversampling as B
from gradus.operators import prototypes as P
from gradus.operators.staging import cut

from .test_oversampling import ROWS, membership, similarity, spreads, table


def walk(rows, kind, threshold, least):
    spread, known = spreads(rows), [r for r in rows if r[4] is not None]
    friend = {r[0]: max([similarity(r, o, spread) for o in known if o[4] == r[4] and o[0] != r[0]], default=0.0) for r in known}
    standard = {r[0]: membership(r, rows, spread) for r in known}
    m = {k: round(v if kind == "standard" else (v + friend[k]) / 2, 9) for k, v in standard.items()}
    order, kept = sorted((r for r in known if friend[r[0]] >= least), key=lambda r: (-m[r[0]], str(r[0]))), []
    for r in order:
        covers = lambda o: round(similarity(o, r, spread), 9) > threshold if threshold >= 0 else round(similarity(o, r, spread), 9) >= round(1 - m[r[0]], 9)
        if not any(o[4] == r[4] and covers(o) for o in kept):
            kept.append(r)
    return sorted(r[0] for r in kept)


@pytest.mark.parametrize("kind, threshold, least", [("standard", -1.0, 0.0), ("combined", 0.6, 0.3)])
def test_prototypes(spark, monkeypatch, kind, threshold, least):
    monkeypatch.setattr(B, "BLOCK", 8)
    rows = table(2)
    found = P.prototypes(spark.createDataFrame(rows, ROWS).repartition(3), "k", ["x", "y"], "c", ["s"], kind, threshold, least)
    assert sorted(r.k for r in found.collect()) == walk(rows, kind, threshold, least)


def test_a_long_chain_takes_one_round(spark, monkeypatch):
    # each row covers the next alone, so every second one is kept; a round for each link took 26 tables
    rows = [(i, float(i), float(i == 0), None, "b" if i == 0 else "a") for i in range(25)]
    threshold, cuts = 1 - 1.5 / 24, []
    monkeypatch.setattr(P, "cut", lambda df: cuts.append(1) or cut(df))
    found = P.prototypes(spark.createDataFrame(rows, ROWS), "k", ["x", "y"], "c", threshold=threshold)
    assert sorted(r.k for r in found.collect()) == walk(rows, "standard", threshold, 0.0)
    assert len(cuts) <= 4


@pytest.mark.parametrize("kind, threshold", [("standard", -1.0), ("combined", 0.9), ("standard", 1.0)])
def test_small_heads_and_equal_rows(spark, monkeypatch, kind, threshold):
    monkeypatch.setattr(P, "HEAD", 8)
    monkeypatch.setattr(P, "STEPS", 20)
    monkeypatch.setattr(P, "TABLE", 16)
    rows = table(3, 40)
    rows = [*rows, *((100 + r[0], *r[1:]) for r in rows[::3])]
    found = P.prototypes(spark.createDataFrame(rows, ROWS).repartition(3), "k", ["x", "y"], "c", ["s"], kind, threshold)
    assert sorted(r.k for r in found.collect()) == walk(rows, kind, threshold, 0.0)


def test_a_long_chain_of_combined_memberships(spark, monkeypatch):
    rows, cuts = [(i, float(i), float(i == 0), None, "b" if i == 0 else "a") for i in range(25)], []
    monkeypatch.setattr(P, "cut", lambda df: cuts.append(1) or cut(df))
    found = P.prototypes(spark.createDataFrame(rows, ROWS), "k", ["x", "y"], "c", kind="combined", threshold=1 - 1.5 / 24)
    assert sorted(r.k for r in found.collect()) == walk(rows, "combined", 1 - 1.5 / 24, 0.0)
    assert len(cuts) <= 4


def test_no_rows(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, "u", None)], ROWS)
    assert P.prototypes(df, "k", ["x"], "c").count() == P.prototypes(df.limit(0), "k", ["x"], "c").count() == 0
    with pytest.raises(ValueError):
        P.prototypes(df, "k", ["x"], "c", kind="none")
