import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import degrees
from gradus.operators import columns as C
from gradus.operators import experiments as X
from gradus.operators import measures as M
from gradus.operators import rows as R
from gradus.operators import selection as S
from gradus.operators import supervised as V
from gradus.sources import tables as T


def test_column_range():
    names = list("abcde")
    assert C.column_range(names, "first-2,last") == ["a", "b", "e"]
    assert C.column_range(names, "!2-3") == ["a", "d", "e"]


def test_fitted_literals_hold_for_later_batches_and_nulls(spark):
    first = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, None)], "id int, x double")
    fitted = C.fit_normalize(first, ["x"])
    later = spark.createDataFrame([(4, 20.0), (5, None)], "id int, x double")
    assert [r["x"] for r in fitted.transform(later).orderBy("id").collect()] == [2.0, None]


def test_empty_and_constant(spark):
    empty = spark.createDataFrame([], "x double")
    assert C.fit_normalize(empty, ["x"]).transform(empty).count() == 0
    same = spark.createDataFrame([(7.0,), (7.0,)], "x double")
    assert {r["x"] for r in C.fit_normalize(same, ["x"]).transform(same).collect()} == {0.0}


def test_connectives_bounds(spark):
    grid = spark.range(121).select((F.col("id") % 11 / 10).alias("a"), (F.floor(F.col("id") / 11) / 10).alias("b"))
    for f in degrees.T_NORMS.values():
        assert grid.where(f(F.col("a"), F.col("b")) > F.least("a", "b") + 1e-9).count() == 0
    for name, f in degrees.S_NORMS.items():
        assert name == "sum" or grid.where(f(F.col("a"), F.col("b")) < F.greatest("a", "b") - 1e-9).count() == 0
    one = grid.where("a = 1 and b = 0")
    assert all(one.select(f(F.col("a"), F.col("b")).alias("v")).first()["v"] == 0 for f in degrees.IMPLICATORS.values())


@pytest.mark.parametrize("implicator", sorted(degrees.IMPLICATORS))
def test_lower_memberships_against_brute_force(spark, implicator):
    rng = np.random.default_rng(3)
    rows = [(float(np.round(rng.normal(), 1)), "abc"[rng.integers(3)]) for _ in range(150)]
    df = spark.createDataFrame(rows, "x double, c string")
    found = {(r["x"], r["c"]): r["lower"] for r in M.lower_memberships_1d(df, "x", "c", implicator=implicator).collect()}
    spread = max(x for x, _ in rows) - min(x for x, _ in rows)
    at = {"lukasiewicz": lambda s: 1 - s, "kleene_dienes": lambda s: 1 - s, "reichenbach": lambda s: 1 - s, "goedel": lambda s: float(s <= 0), "gaines": lambda s: float(s <= 0)}[implicator]
    for x, c in rows:
        best = max((max(0.0, 1 - abs(x - y) / spread) for y, d in rows if d != c), default=0.0)
        assert found[x, c] == pytest.approx(at(best), abs=1e-9)


def test_mdl_finds_the_boundary(spark):
    df = spark.range(400).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 150, "a").otherwise("b").alias("c"))
    assert V.mdl_cuts(df, "x", "c") == [149.5]
    assert V.mdl_cuts(df.withColumn("c", F.lit("a")), "x", "c") == []


def test_folds_partition_rows(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    counts = sorted(r["count"] for r in R.folds(df, "k", 10).groupBy("fold").count().collect())
    assert counts == [10] * 7 + [11] * 3


def test_smote_adds_rows_inside_the_class(spark):
    df = spark.range(60).select(F.col("id").alias("k"), F.rand(1).alias("x"), F.when(F.col("id") < 10, "few").otherwise("many").alias("c"))
    out = V.smote(df, "k", ["x"], "c", "few", 200)
    assert out.where("c = 'few'").count() == 30
    low, high = df.where("c = 'few'").agg(F.min("x"), F.max("x")).first()
    assert out.where("k is null").agg(F.min("x")).first()[0] >= low and out.agg(F.max(F.when(F.col("k").isNull(), F.col("x")))).first()[0] <= high


def test_p_values():
    assert X.t_p_value(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert X.normal_p_value(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, None, 1.5)], "id int, s string, x double")
    T.write_csv(df, f"{tmp_path}/t.csv")
    assert sorted(map(tuple, T.read_table(spark, f"{tmp_path}/t.csv", schema=df.schema).collect())) == [(1, "a,b", None), (2, None, 1.5)]


def test_stream_delta(spark, tmp_path):
    from gradus.streaming.filters import delta_stream

    df = spark.createDataFrame([("u", 1, 1.0), ("u", 2, 4.0), ("v", 1, 2.0)], "k string, t int, x double")
    df.write.parquet(f"{tmp_path}/in")
    stream = delta_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "t", "x")
    run = stream.writeStream.format("memory").queryName("deltas").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r["k"], r["t"], r["delta"]) for r in spark.table("deltas").collect()} == {("u", 1, None), ("u", 2, 3.0), ("v", 1, None)}


def test_smote_neighbours_and_counts_on_a_skewed_column(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(5)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(np.column_stack([np.exp(rng.normal(0, 3, 130)), rng.normal(0, 50, 130)]), 1))]
    points += [(130, 1e9, 0.0), (None, -1e9, 3.0)]
    df = spark.createDataFrame([(*p, "few") for p in points] + [(500 + i, 0.0, 0.0, "many") for i in range(9)], "k long, x double, y double, c string")
    found = {}
    for r in V.nearest_rows(df.where("c = 'few'"), "k", ["x", "y"], 5).collect():
        found.setdefault(r["key"], {})[r["rank"]] = r["other_key"]
    for a in points:
        rest = sorted(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, -1 if b[0] is None else b[0]) for b in points if b is not a)[:5]
        assert [-1 if found[a[0]][i] is None else found[a[0]][i] for i in range(1, 6)] == [k for _, k in rest]
    assert V.smote(df, "k", ["x", "y"], "c", "few", 300).where("c = 'few'").count() == 4 * len(points)


def test_entropy_scores_cut_numeric_attributes(spark):
    df = spark.range(400).select(F.col("id").cast("double").alias("x"), (F.col("id") * 37 % 400).cast("double").alias("noise"), F.when(F.col("id") < 150, "a").otherwise("b").alias("c"))
    found = {r["attribute"]: r for r in S.entropy_scores(df, ["x", "noise"], "c", numeric=["x", "noise"]).collect()}
    assert found["x"]["gain_ratio"] == pytest.approx(1.0) and found["x"]["info_gain"] == pytest.approx(V.entropy([150, 250]))
    assert found["noise"]["info_gain"] == pytest.approx(0.0)
    assert found["noise"]["symmetrical_uncertainty"] == pytest.approx(0.0)


def test_numbering_holds_for_null_textual_and_skewed_keys(spark, monkeypatch):
    from gradus.operators import ordering as O

    monkeypatch.setattr(O, "CELL_ROWS", 20)
    rows = [(None, 0)] + [(f"k{i % 7 * 1000 + i:06d}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int")
    found = [r["k"] for r in O.numbered(df, "k").orderBy("_ord").collect()]
    assert found == [None, *sorted(k for k, _ in rows if k)]
    skewed = spark.createDataFrame([(float(i**5), 1) for i in range(200)], "k double, v int")
    assert [r["_ord"] for r in O.numbered(skewed, "k").orderBy("k").collect()] == list(range(1, 201))


def test_rows_without_a_class_stay(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "ab"[i % 2]) for i in range(40)], "id int, c string")
    assert R.add_noise(df, "id", "c", ["a", "b"], 20).count() == 40
    assert R.class_weights(df, "c").where("c is null").agg({"_weight": "sum"}).first()[0] == 10
    assert R.class_resample(df, "id", "c", 100).count() == 40


def test_mid_ranks_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [("ab"[rng.integers(2)], float(rng.integers(0, 30)) ** 3) for _ in range(200)]
    found = sorted((r["g"], r["v"], r["rank"]) for r in X.mid_ranks(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect())
    expected = []
    for g in "ab":
        values = sorted(v for h, v in rows if h == g)
        expected += [(g, v, np.mean([i + 1 for i, w in enumerate(values) if w == v])) for v in values]
    assert [(a, b, float(c)) for a, b, c in found] == [(a, b, float(c)) for a, b, c in expected]


def test_principal_components_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    apply, values = C.fit_principal_components(df, ["a", "b", "c"], variance=0.9)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert values == pytest.approx(sorted(np.linalg.eigvalsh(np.corrcoef(x.T)), reverse=True))
    out = np.array([[r[c] for c in r.__fields__ if c.startswith("PC")] for r in apply(df).orderBy("id").collect()])
    assert out.var(0, ddof=1) == pytest.approx(values[: out.shape[1]]) and np.cumsum(values)[out.shape[1] - 1] >= 0.9 * 3 - 1e-9
    assert np.linalg.matrix_rank(np.hstack([z, out]), 1e-6) == 3


def test_principal_components_of_hardly_correlated_columns(spark):
    """Two standardised columns have the loads 1 / sqrt(2) however small their correlation is; errors of sums don't turn them."""
    df = spark.range(7 * 11 * 50).select("id", (F.col("id") % 7 * 0.1).alias("a"), (F.floor(F.col("id") / 7) % 11 * 0.3 + F.col("id") % 7 * 1e-9).alias("b"))
    apply, values = C.fit_principal_components(df, ["a", "b"], variance=1.0)
    x = np.array([[r.a, r.b] for r in df.orderBy("id").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    out = np.array([[r.PC1, r.PC2] for r in apply(df).orderBy("id").collect()])
    assert sum(values) == 2.0
    assert np.abs(out - np.stack([z[:, 0] + z[:, 1], z[:, 0] - z[:, 1]], 1) / np.sqrt(2)).max() < 1e-9


def test_labels_of_many_cuts(spark):
    """Conditions of 3,000 cuts nest in steps, and a value equal to a cut belongs below it."""
    cuts = [float(i) for i in range(3000)]
    rows = spark.range(0, 6003).select((F.col("id") / 2 - 1).alias("x"))
    found = {r.x: r.b for r in rows.select("x", C.cut_label(F.col("x"), cuts).alias("b")).collect()}
    assert found == {x: int(np.searchsorted(cuts, x)) for x in found}
    assert spark.sql("select cast(null as double) x").select(C.cut_label(F.col("x"), cuts)).first()[0] is None


def test_words_are_counted_where_the_texts_are(spark):
    """Texts are shuffled, not words: neither counting nor the meeting with the dictionary is an exchange by word. Ids repeat."""
    df = spark.createDataFrame([(1, "a b a"), (1, "A c"), (2, "b"), (3, None), (None, "a")], "k int, t string")
    counts = C.word_counts(df, "k", "t")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "word" in line]
    assert sorted((str(r.k), r.word, r.n, r.df) for r in counts.collect()) == [("1", "a", 3, 2), ("1", "b", 1, 2), ("1", "c", 1, 1), ("2", "b", 1, 2), ("None", "a", 1, 2)]
