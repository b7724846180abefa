"""Label merging, evaluation of classifiers and experiment runs against plain loops, on odd rows too."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions.tails import chi_square_p_value
from gradus.operators import evaluation as E
from gradus.operators import experiments as X
from gradus.operators import merging as G
from gradus.operators import runs as U
from gradus.operators.selection import greedy_forward


def test_chi_square_tail():
    for df in (2, 4, 10, 60):
        for x in (0.1, 1.0, 7.5, 40.0, 120.0):
            closed = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))
            assert abs(chi_square_p_value(x, df) - closed) < 1e-10
    assert abs(chi_square_p_value(2.5, 1) - math.erfc(math.sqrt(1.25))) < 1e-12
    assert chi_square_p_value(0, 3) == chi_square_p_value(5, 0) == 1.0


def plain_merge(counts, level):
    place, rows = list(range(len(counts))), [r.astype(float) for r in counts]
    while len(rows) > 1:
        value, i, j = min((G.chi_square(np.array([rows[i], rows[j]])), i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)))
        if chi_square_p_value(value, len(rows[0]) - 1) <= level:
            whole = chi_square_p_value(G.chi_square(np.array(rows)), (len(rows[0]) - 1) * (len(rows) - 1))
            if whole * G.subsets(len(counts), len(rows)) > level:
                place = [0] * len(place)
            break
        rows[i] = rows[i] + rows.pop(j)
        place = [i if p == j else p - (p > j) for p in place]
    groups = {}
    for label, p in enumerate(place):
        groups.setdefault(p, []).append(label)
    return [groups[p] for p in sorted(groups)]


def test_merges_equal_a_plain_loop():
    g, parts = np.random.default_rng(0), set()
    for _ in range(120):
        labels, classes = int(g.integers(1, 12)), int(g.integers(1, 5))
        kinds = g.dirichlet(np.ones(classes), size=4)
        counts = np.array([g.multinomial(int(g.integers(0, 80)), kinds[g.integers(0, 4)]) for _ in range(labels)])
        found = G.merged_groups(counts, 0.05)
        assert found == plain_merge(counts, 0.05)
        parts.add(len(found))
    assert len(parts) > 3
    assert G.subsets(4, 2) == 7 and G.subsets(10, 3) == 9330
    # two classes are corrected by a half: 10 * (|10 * 0 - ..| - ..) by hand
    assert abs(G.chi_square(np.array([[8, 2], [3, 7]])) - 20 * (abs(8 * 7 - 2 * 3) - 10) ** 2 / (10 * 10 * 11 * 9)) < 1e-9


def test_merges_of_odd_rows(spark):
    rows = [(i, "xy"[i % 2], None, "ab"[i % 2], 1.0) for i in range(40)] + [(100 + i, "z", None, "ab"[i % 2], 2.0) for i in range(40)]
    rows += [(200, None, None, "a", 1.0), (201, "x", None, None, 1.0), (202, "", None, "b", 1.0)]
    df = spark.createDataFrame(rows, "k long, u string, v string, c string, w double")
    for weight in (None, "w"):
        merges = G.label_merges(df, ["u", "v"], "c", weight=weight)
        found = {r.label: r.merged for r in merges.where("attribute = 'u'").collect()}
        counts = np.zeros((4, 2))
        for _, u, _, c, w in rows:
            if u is not None and c is not None:
                counts[["", "x", "y", "z"].index(u), "ab".index(c)] += w if weight else 1
        want = {label: "_or_".join(["", "x", "y", "z"][i] for i in group) for group in plain_merge(counts, 0.05) for label in [["", "x", "y", "z"][i] for i in group]}
        assert found == want and merges.where("attribute = 'v'").count() == 0
    out = G.merge_labels(df, ["u", "v"], merges)
    assert out.columns == ["k", "u_merged_values", "v", "c", "w"] and out.count() == df.count()
    assert out.where("k = 200").first().u_merged_values is None and out.where("k = 0").first().u_merged_values == found["x"]
    assert {r.merged for r in G.label_merges(df, ["u"], "c", short=True).collect()} <= {"1", "2", "3", "4"}
    assert G.label_merges(df.limit(0), ["u"], "c").count() == 0


def table(spark, n=90, seed=3):
    g = np.random.default_rng(seed)
    rows = [(i, ["a", "b", "c"][int(g.integers(0, 3))], None if i % 9 == 0 else str(int(g.integers(0, 4))), float(g.random()), None if i % 30 == 7 else "pq"[int(g.random() < 0.3 + 0.4 * (i % 2))]) for i in range(n)]
    rows = [(k, u if c != "q" or k % 3 else "c", v, x + (c == "q"), c) for k, u, v, x, c in rows]
    return spark.createDataFrame(rows, "k long, u string, v string, x double, c string")


def plain_bayes(data, train, columns, row, classes):
    scores = []
    for c in classes:
        own = [r for r in train if r.c == c]
        s = math.log((len(own) + 1) / (len(train) + len(classes)))
        for a in columns:
            if row[a] is not None:
                s += math.log((sum(r[a] == row[a] for r in own) + 1) / (sum(r[a] is not None for r in own) + len({r[a] for r in data} - {None})))
        scores.append((-round(s, 9), c))
    return min(scores)[1]


@pytest.mark.parametrize("columns", [["u", "v"], []])
def test_bayes_by_folds(spark, columns):
    rows = E.with_folds(table(spark), "k", "c", 4)
    data = rows.collect()
    assert len(data) == 87 and max(sum(r._fold == f and r.c == c for r in data) for f in (1, 2, 3, 4) for c in "pq") - min(sum(r._fold == f and r.c == c for r in data) for f in (1, 2, 3, 4) for c in "pq") < 15
    found = {r.k: r.predicted for r in E.predictions(rows, "k", columns, "c", E.naive_bayes).collect()}
    most = {r.k: r.predicted for r in E.predictions(rows, "k", columns, "c", E.majority).collect()}
    for r in data:
        train = [t for t in data if t._fold != r._fold]
        assert found[r.k] == plain_bayes(data, train, columns, r, ["p", "q"])
        assert most[r.k] == max("pq", key=lambda c: (sum(t.c == c for t in train), c == "p"))
    empty = rows.limit(0)
    assert E.predictions(empty, "k", columns, "c", E.naive_bayes).count() == 0


def test_class_measures(spark):
    pairs = [("p", "p")] * 5 + [("p", "q")] * 2 + [("q", "q")] * 3 + [("q", "p")] + [("q", None)]
    m = E.class_measures(spark.createDataFrame(pairs, "actual string, predicted string")).first()
    assert (m.n, m.correct, m.incorrect, m.unclassified) == (12, 8, 3, 1)
    assert abs(m.precision - (7 * 5 / 6 + 5 * 3 / 5) / 12) < 1e-12 and abs(m.recall - 8 / 12) < 1e-12
    chance = (7 * 6 + 5 * 5) / 144
    assert abs(m.kappa - (8 / 12 - chance) / (1 - chance)) < 1e-12
    n = E.number_measures(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "actual double, predicted double")).first()
    assert abs(n.mae - 2 / 3) < 1e-12 and abs(n.rmse - math.sqrt(2 / 3)) < 1e-12


def test_wrapper_repeats_until_steady(spark):
    df = table(spark)
    once = []
    for seed in range(1, 4):
        rows = E.with_folds(df, "k", "c", 3, seed)
        once.append(E.merit_of(E.predictions(rows, "k", ["u", "v"], "c", E.naive_bayes), "accuracy"))

    def plain(threshold):
        for n in range(2, 4):
            errors = [1 - v for v in once[:n]]
            mean = sum(errors) / n
            if not math.sqrt(sum((e - mean) ** 2 for e in errors) / n) > threshold * mean:
                break
        return sum(once[:n]) / n

    for threshold, want in ((-1, once[0]), (0.5, plain(0.5)), (0.0, plain(0.0))):
        assert abs(E.wrapper_merit(df, "k", ["u", "v"], "c", E.naive_bayes, 3, threshold, most=3)(frozenset("uv")) - want) < 1e-12


def test_wrapper_drives_a_search(spark):
    df = table(spark)
    rows = E.with_folds(df, "k", "c", 3)
    data = rows.collect()

    def plain(subset):
        columns = [c for c in ("u", "v") if c in subset]
        return sum(plain_bayes(data, [t for t in data if t._fold != r._fold], columns, r, ["p", "q"]) == r.c for r in data) / len(data)

    merit = E.wrapper_merit(df, "k", ["u", "v"], "c", E.naive_bayes, 3, threshold=-1)
    assert greedy_forward(["u", "v"], merit) == greedy_forward(["u", "v"], plain)
    for subset in ((), ("u",), ("v",), ("u", "v")):
        assert abs(merit(frozenset(subset)) - plain(subset)) < 1e-12
    left = E.attribute_merits(["u", "v"], merit, leave_out=True)
    assert abs(left["u"] - (plain("uv") - plain("v"))) < 1e-12
    merit.release()
    assert merit(frozenset("u")) == merit(frozenset(["u"]))


def test_classifier_merit_and_ml(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.regression import LinearRegression

    df = table(spark)
    known = df.where("c is not null").collect()
    merit = E.classifier_merit(df, "k", ["u", "v"], "c", E.naive_bayes)
    assert abs(merit(frozenset("u")) - sum(plain_bayes(known, known, ["u"], r, ["p", "q"]) == r.c for r in known) / len(known)) < 1e-12
    split = E.with_split(df, "k", "c", 66).collect()
    train = [r for r in split if r._fold == 0]
    test = [r for r in split if r._fold == 1]
    want = sum(plain_bayes(split, train, ["u"], r, ["p", "q"]) == r.c for r in test) / len(test)
    assert abs(E.classifier_merit(df, "k", ["u", "v"], "c", E.naive_bayes, percent=66)(frozenset("u")) - want) < 1e-12
    other = table(spark, 40, 8).withColumn("k", F.col("k") + 1000)
    hold = other.where("c is not null").collect()
    want = sum(plain_bayes(known + hold, known, ["u"], r, ["p", "q"]) == r.c for r in hold) / len(hold)
    assert abs(E.classifier_merit(df, "k", ["u", "v"], "c", E.naive_bayes, holdout=other)(frozenset("u")) - want) < 1e-12
    tree = E.ml_scheme(lambda: DecisionTreeClassifier(maxDepth=2))
    holes = df.withColumn("x", F.when(F.col("k") != 3, F.col("x")))
    m = E.class_measures(E.predictions(E.with_folds(holes, "k", "c", 3), "k", ["x"], "c", tree)).first()
    assert m.n == 87 and m.unclassified == 0 and m.percent_correct > 90
    line = E.ml_scheme(LinearRegression, numeric_target=True)
    rows = df.select("k", "x", (2 * F.col("x") + 1).alias("y"), (F.col("k") % 2).cast("int").alias("_fold"))
    assert E.number_measures(E.predictions(rows, "k", ["x"], "y", line)).first().rmse < 1e-6


def test_experiment_taken_up_again(spark, tmp_path):
    df = table(spark, 60)
    data = {"key": "k", "target": "c", "columns": ["u", "v"], "table": "all", "test": "new"}
    read = lambda name: df if name == "all" else df.withColumn("k", F.col("k") + 500)
    d = U.Definition({"one": data}, ["naive_bayes", "majority"], last=2, folds=2)
    d.save(spark, f"{tmp_path}/definition")
    d = U.Definition.load(spark, f"{tmp_path}/definition")
    path = f"{tmp_path}/results"
    assert U.run(spark, d, path, read, most=1) == 1 and len(U.stored(spark, path)) == 1
    assert U.run(spark, d, path, read) == 3 and U.run(spark, d, path, read) == 0
    whole = spark.read.parquet(path)
    assert sorted(map(str, whole.collect())) == sorted(map(str, U.results(d, read).select(whole.columns).collect()))
    assert whole.count() == 2 * 2 * 2
    tested = X.paired(whole, "naive_bayes", "percent_correct", ratio=1.0).collect()
    assert sorted((r.dataset, r.n) for r in tested) == [("one", 4)]
    d.producer, d.last = "random_split", 1
    one = U.one_run(d, read, "one", "naive_bayes", 1).first()
    assert one.fold == 1 and one["size"] + one.n == df.where("c is not null").count()
    d.producer = "test_set"
    assert U.one_run(d, read, "one", "majority", 1).first().n == one["size"] + one.n
    d.producer, d.step, d.upper = "learning_rate", 20, 45
    assert sorted({r.total for r in U.one_run(d, read, "one", "majority", 1).collect()}) == [20, 40]
    for bad in ({"producer": "x"}, {"schemes": ["none"]}):
        with pytest.raises(ValueError):
            U.Definition(**({"datasets": {}, "schemes": []} | bad))


def test_probabilities():
    from itertools import product

    for n in (1, 4, 7):
        for w in (0, 2, 5):
            sums = [sum(i + 1 for i, s in enumerate(signs) if s) for signs in product((0, 1), repeat=n)]
            assert abs(X.signed_rank_p_value(w, n) - min(1.0, 2 * sum(s <= w for s in sums) / 2**n)) < 1e-12
    # of one and of two degrees there are closed forms; F of one degree is the square of t
    assert abs(X.t_p_value(2.0, 1) - (1 - 2 * math.atan(2.0) / math.pi)) < 1e-10
    assert abs(X.f_p_value(3.0, 2, 8) - (1 + 2 * 3.0 / 8) ** -4) < 1e-10
    assert abs(X.f_p_value(2.5**2, 1, 9) - X.t_p_value(2.5, 9)) < 1e-10 and X.f_p_value(0.0, 2, 3) == 1.0


def test_tests_of_odd_results(spark):
    rows = [("d", s, 1, f, v) for s, values in (("a", [1.0, 2.0, 3.0]), ("b", [1.0, 2.0, 3.0]), ("c", [0.5, 1.5, 2.5])) for f, v in enumerate(values)] + [("e", "a", 1, 0, 1.0), ("e", "b", 1, 0, 2.0)]
    df = spark.createDataFrame(rows, "dataset string, scheme string, run int, fold int, value double")
    found = {(r.dataset, r.scheme): (r.t, r.p_value, r.verdict) for r in X.paired_tested(df, "a", "value").collect()}
    assert found == {("d", "b"): (None, None, 0), ("d", "c"): (None, None, 1), ("e", "b"): (None, None, 0)}
    assert {r.scheme: (r.wins, r.ties, r.losses) for r in X.cross_table(X.paired_tested(df, "a", "value")).collect()} == {"b": (0, 2, 0), "c": (0, 0, 1)}


def test_draws_are_staged(spark):
    """A scheme reads drawn rows many times: they come from a stage, not from the table and its windows anew."""
    rows = spark.range(60).selectExpr("id AS k", "if(id % 3 = 0, 'a', 'b') AS c", "concat('v', id % 4) AS x")
    d = U.Definition({"t": {"table": "t", "key": "k", "target": "c", "columns": ["x"]}}, ["naive_bayes"], "learning_rate", last=1, folds=2, lower=20, step=20, upper=40)
    found = U.results(d, lambda _: rows)
    assert "_cell" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.total, r.n + r.size) for r in found.collect()) == [(20, 20), (20, 20), (40, 40), (40, 40)]


@pytest.mark.parametrize("size", [0, 1, 499, 3000, 9000])
def test_resample_takes_the_smallest_draws(spark, size):
    from gradus.operators import rows as R

    df = spark.range(9000).withColumnRenamed("id", "k")
    draws = sorted((r.d, r.k) for r in df.select("k", R.draw("k", 3).alias("d")).collect())
    assert sorted(r.k for r in R.resample(df, "k", size, 3).collect()) == sorted(k for _, k in draws[:size])


def test_mann_whitney_without_windows_over_a_group(spark):
    """Against counting pairs, with ties and nulls of the group's columns; no window holds the rows of a group."""
    rows = [(None if i % 5 == 0 else i % 2, float(i * 7 % 13), "uvv"[i % 3]) for i in range(60)]
    found = X.mann_whitney(spark.createDataFrame(rows, "g int, v double, s string"), "v", "s", ["g"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("Window [" in line and ("min(v" in line or "max(v" in line) for line in plan.splitlines())
    for r in found.collect():
        a, b = ([v for g, v, s in rows if g == r.g and s == t] for t in "uv")
        assert (r.n1, r.n2, r.u) == (len(a), len(b), sum((x > y) + (x == y) / 2 for x in a for y in b))
