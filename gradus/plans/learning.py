"""Queries of merging, wrapper evaluation and experiment runs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import experiments as X
from ..operators import merging as G
from ..operators import runs as U
from ..operators.selection import greedy_forward
from .further import draw
from .queries import RESULTS, query, results, rounded

#: Orders with two labels made from the customer's number: ``mixed`` depends on the status, ``plain`` doesn't.
LABELS = """SELECT o_orderkey, o_orderstatus, o_orderpriority, 'm' || CASE WHEN o_custkey % 12 < 4 THEN o_custkey % 12 WHEN o_orderstatus = 'F' THEN 4 + o_custkey % 3 WHEN o_orderstatus = 'O' THEN 5 + o_custkey % 4 ELSE 7 + o_custkey % 2 END AS mixed,
'p' || (o_custkey % 7) AS plain FROM orders"""
ATTRIBUTES = ["mixed", "plain", "o_orderpriority"]


def labelled(df):
    m = F.col("o_custkey") % 12
    status, key = F.col("o_orderstatus"), F.col("o_custkey")
    number = F.when(m < 4, m).when(status == "F", 4 + key % 3).when(status == "O", 5 + key % 4).otherwise(7 + key % 2)
    return df.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.concat(F.lit("m"), number.cast("string")).alias("mixed"), F.concat(F.lit("p"), (F.col("o_custkey") % 7).cast("string")).alias("plain"))


# with three classes a pair has two degrees of freedom and no correction: its p value is exp(-x / 2), the whole table's a finite sum
MERGES = f"""WITH RECURSIVE rows_ AS ({LABELS}), long AS (
  SELECT a.attribute, a.label, o_orderstatus AS c FROM (SELECT unnest([{{'attribute': 'mixed', 'label': mixed}}, {{'attribute': 'plain', 'label': plain}}, {{'attribute': 'o_orderpriority', 'label': o_orderpriority}}]) AS a, o_orderstatus FROM rows_)
), counts AS (
  SELECT attribute, label, [count(*) FILTER (WHERE c = 'F'), count(*) FILTER (WHERE c = 'O'), count(*) FILTER (WHERE c = 'P')]::DOUBLE[] AS n FROM long GROUP BY 1, 2
), start AS (
  SELECT attribute, list({{'labels': [label], 'n': n}} ORDER BY label) AS g, count(*) AS labels FROM counts GROUP BY 1
), merging AS (
  SELECT attribute, g, labels, 0 AS round, false AS done FROM start
  UNION ALL
  SELECT attribute, CASE WHEN exp(-x / 2) <= 0.05 THEN g ELSE list_concat(list_concat(g[: i - 1], [{{'labels': list_sort(list_concat(g[i].labels, g[j].labels)), 'n': [g[i].n[1] + g[j].n[1], g[i].n[2] + g[j].n[2], g[i].n[3] + g[j].n[3]]}}]), list_concat(g[i + 1 : j - 1], g[j + 1 :])) END, labels, round + 1, exp(-x / 2) <= 0.05
  FROM (
    SELECT attribute, any_value(g) AS g, any_value(labels) AS labels, any_value(round) AS round, arg_min({{'x': x, 'i': i, 'j': j}}, [x, i, j]).i AS i, arg_min({{'x': x, 'i': i, 'j': j}}, [x, i, j]).j AS j, min(x) AS x
    FROM (
      SELECT *, list_sum(list_transform([1, 2, 3], lambda k: CASE WHEN a[k] + b[k] = 0 THEN 0 ELSE (a[k] - (a[k] + b[k]) * list_sum(a) / (list_sum(a) + list_sum(b))) ** 2 / ((a[k] + b[k]) * list_sum(a) / (list_sum(a) + list_sum(b))) + (b[k] - (a[k] + b[k]) * list_sum(b) / (list_sum(a) + list_sum(b))) ** 2 / ((a[k] + b[k]) * list_sum(b) / (list_sum(a) + list_sum(b))) END)) AS x
      FROM (SELECT attribute, g, labels, round, ij.i AS i, ij.j AS j, g[ij.i].n AS a, g[ij.j].n AS b FROM (SELECT *, unnest(flatten(list_transform(range(1, len(g)), lambda i: list_transform(range(i + 1, len(g) + 1), lambda j: {{'i': i, 'j': j}})))) AS ij FROM merging WHERE NOT done AND len(g) > 1))
    ) GROUP BY attribute
  )
), ended AS (
  SELECT * FROM merging QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY round DESC) = 1
), tested AS (
  SELECT *, len(g) AS r, list_sum(list_transform(g, lambda y: list_sum(list_transform([1, 2, 3], lambda k: (y.n[k] - list_sum(y.n) * c[k] / list_sum(c)) ** 2 / (list_sum(y.n) * c[k] / list_sum(c)))))) AS x
  FROM (SELECT *, list_transform([1, 2, 3], lambda k: list_sum(list_transform(g, lambda y: y.n[k]))) AS c FROM ended)
), judged AS (
  SELECT *, NOT done OR exp(-x / 2) * list_sum(list_transform(range(r - 1), lambda i: (x / 2) ** i / gamma(i + 1))) * list_sum(list_transform(range(r), lambda i: (-1) ** i * (r - i)::DOUBLE ** labels / (gamma(i + 1) * gamma(r - i + 1)))) <= 0.05 AS significant
  FROM tested
), grouped AS (
  SELECT attribute, unnest(CASE WHEN significant THEN list_transform(g, lambda y: y.labels) ELSE [list_sort(flatten(list_transform(g, lambda y: y.labels)))] END) AS own, CASE WHEN significant THEN r ELSE 1 END AS groups FROM judged
)"""


@query(MERGES + " SELECT attribute, unnest(own) AS label, array_to_string(own, '_or_') AS merged, groups::INT AS groups FROM grouped", "orders")
def label_merges(df):
    return G.label_merges(labelled(df), ATTRIBUTES, "o_orderstatus")


@query(MERGES + f""", m AS (SELECT attribute, unnest(own) AS label, array_to_string(own, '_or_') AS merged FROM grouped)
SELECT o_orderkey, a.merged AS mixed_merged_values, b.merged AS plain_merged_values FROM ({LABELS}) JOIN m a ON a.attribute = 'mixed' AND a.label = mixed JOIN m b ON b.attribute = 'plain' AND b.label = plain""", "orders")
def merge_nominal_values(df):
    rows = labelled(df)
    merges = G.label_merges(rows, ["mixed", "plain"], "o_orderstatus")
    return G.merge_labels(rows, ["mixed", "plain"], merges).select("o_orderkey", "mixed_merged_values", "plain_merged_values")


def folded(seed: int, n: int, rows: str = LABELS) -> str:
    return f"SELECT *, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {draw('o_orderkey', seed)}, o_orderkey) - 1) % {n} + 1)::INT AS fold FROM ({rows})"


def bayes(folds: str, attributes: list[str] = ATTRIBUTES) -> str:
    """Common tables that end in ``votes`` (o_orderkey, o_orderstatus, fold, attribute, c, v) and ``priors`` (fold, c, p)."""
    cells = ", ".join(f"{{'attribute': '{a}', 'label': {a}}}" for a in attributes)
    return f"""f AS ({folds}), classes AS (SELECT DISTINCT o_orderstatus AS c FROM f), parts AS (SELECT DISTINCT fold FROM f),
    long AS (SELECT o_orderkey, o_orderstatus, fold, a.attribute AS attribute, a.label AS label FROM (SELECT *, unnest([{cells}]) AS a FROM f)),
    counts AS (SELECT attribute, label, fold, o_orderstatus AS c, count(*) AS n FROM long GROUP BY ALL),
    domain AS (SELECT attribute, count(DISTINCT label) AS labels FROM long GROUP BY 1),
    cells AS (SELECT parts.fold, attribute, label, c, sum(n) AS n FROM counts JOIN parts ON parts.fold <> counts.fold GROUP BY ALL),
    sizes AS (SELECT fold, attribute, c, sum(n) AS n FROM cells GROUP BY ALL),
    priors AS (SELECT p.fold, classes.c, ln((count(*) FILTER (WHERE o_orderstatus = classes.c) + 1) / (count(*) + (SELECT count(*) FROM classes))::DOUBLE) AS p FROM parts p JOIN f ON p.fold <> f.fold, classes GROUP BY 1, 2),
    votes AS (SELECT o_orderkey, o_orderstatus, long.fold, long.attribute, classes.c, ln((coalesce(cells.n, 0) + 1) / (coalesce(sizes.n, 0) + labels)::DOUBLE) AS v
      FROM long CROSS JOIN classes JOIN domain ON domain.attribute = long.attribute LEFT JOIN cells ON cells.fold = long.fold AND cells.attribute = long.attribute AND cells.label = long.label AND cells.c = classes.c
      LEFT JOIN sizes ON sizes.fold = long.fold AND sizes.attribute = long.attribute AND sizes.c = classes.c)"""


def chosen(where: str = "true", by: str = "") -> str:
    """Predictions by the votes of some attributes."""
    return f"""(SELECT {by} o_orderkey, fold, o_orderstatus, c AS predicted FROM (SELECT {by} o_orderkey, votes.fold, o_orderstatus, votes.c, round(sum(v) + any_value(p), 9) AS s FROM votes JOIN priors ON priors.fold = votes.fold AND priors.c = votes.c WHERE {where} GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY {by} o_orderkey ORDER BY s DESC, c) = 1)"""


@query(f"WITH {bayes(folded(1, 5))} SELECT o_orderkey, fold, predicted FROM {chosen()}", "orders")
def bayes_predictions(df):
    rows = E.with_folds(labelled(df), "o_orderkey", "o_orderstatus", 5)
    return E.predictions(rows, "o_orderkey", ATTRIBUTES, "o_orderstatus", E.naive_bayes).select("o_orderkey", F.col("_fold").alias("fold"), "predicted")


MEASURED = """, e AS (SELECT * FROM {found}), k AS (SELECT fold, c, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = c) AS a, count(*) FILTER (WHERE predicted = c) AS p, count(*) FILTER (WHERE predicted = c AND o_orderstatus = c) AS t FROM e, classes GROUP BY 1, 2),
w AS (SELECT fold, any_value(n) AS n, sum(t)::BIGINT AS correct, sum(t) / any_value(n) AS o, sum(a * p) / any_value(n)::DOUBLE / any_value(n) AS ch, sum(a * CASE WHEN p > 0 THEN t / p ELSE 0 END) / sum(a) AS precision, sum(t) / sum(a) AS recall, sum(a * 2 * t / (a + p)) / sum(a) AS f_measure FROM k WHERE a + p > 0 GROUP BY 1)"""


@query(f"WITH {bayes(folded(1, 5))}" + MEASURED.format(found=chosen()) + """ SELECT fold, n, correct, n - correct AS incorrect, round(100 * o, 6) AS percent_correct, round((o - ch) / (1 - ch), 6) AS kappa,
round(precision, 6) AS precision, round(recall, 6) AS recall, round(f_measure, 6) AS f_measure FROM w""", "orders")
def bayes_measures(df):
    rows = E.with_folds(labelled(df), "o_orderkey", "o_orderstatus", 5)
    found = E.class_measures(E.predictions(rows, "o_orderkey", ATTRIBUTES, "o_orderstatus", E.naive_bayes), ["_fold"])
    return rounded(found.select(F.col("_fold").alias("fold"), "n", "correct", "incorrect", "percent_correct", "kappa", "precision", "recall", "f_measure"))


SUBSETS = f"""WITH {bayes(folded(1, 5))}, masks AS (SELECT mask, a.i AS bit, a.attribute AS attribute FROM range(1, 8) t(mask), (VALUES (0, 'mixed'), (1, 'plain'), (2, 'o_orderpriority')) a(i, attribute) WHERE (mask >> a.i) & 1 = 1),
m AS (SELECT mask, avg((predicted = o_orderstatus)::INT) AS merit FROM (SELECT mask, o_orderkey, o_orderstatus, c AS predicted FROM (SELECT mask, o_orderkey, o_orderstatus, votes.c, round(sum(v) + any_value(p), 9) AS s FROM votes JOIN masks USING (attribute) JOIN priors ON priors.fold = votes.fold AND priors.c = votes.c GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY mask, o_orderkey ORDER BY s DESC, c) = 1) GROUP BY 1
UNION ALL SELECT 0, avg((predicted = o_orderstatus)::INT) FROM (SELECT f.o_orderkey, f.o_orderstatus, c AS predicted FROM f JOIN priors USING (fold) QUALIFY row_number() OVER (PARTITION BY f.o_orderkey ORDER BY round(p, 9) DESC, c) = 1))"""


def merit(df):
    return E.wrapper_merit(labelled(df), "o_orderkey", ATTRIBUTES, "o_orderstatus", E.naive_bayes, threshold=-1)


@query(SUBSETS + """, one AS (SELECT attribute, m.merit - (SELECT merit FROM m WHERE mask = 0) AS alone, (SELECT merit FROM m WHERE mask = 7) - rest.merit AS left_out FROM masks JOIN m ON m.mask = masks.mask JOIN m rest ON rest.mask = 7 - masks.mask WHERE masks.mask IN (1, 2, 4))
SELECT attribute, round(alone, 6) AS alone, round(left_out, 6) AS left_out FROM one""", "orders")
def classifier_attribute_merits(df):
    found = merit(df)
    alone, left = E.attribute_merits(ATTRIBUTES, found), E.attribute_merits(ATTRIBUTES, found, leave_out=True)
    found.release()
    return rounded(df.sparkSession.createDataFrame([(a, alone[a], left[a]) for a in ATTRIBUTES], "attribute string, alone double, left_out double"))


@query(SUBSETS + """, a AS (SELECT mask, attribute, merit FROM masks JOIN m USING (mask) WHERE mask IN (1, 2, 4) ORDER BY merit DESC, attribute DESC LIMIT 1),
b AS (SELECT a.mask + x.mask AS mask, x.attribute, m.merit FROM a JOIN masks x ON x.mask IN (1, 2, 4) AND x.mask <> a.mask JOIN m ON m.mask = a.mask + x.mask WHERE m.merit > a.merit ORDER BY m.merit DESC, x.attribute DESC LIMIT 1),
c AS (SELECT x.attribute, m.merit FROM b JOIN masks x ON x.mask IN (1, 2, 4) AND x.mask = 7 - b.mask JOIN m ON m.mask = 7 WHERE m.merit > b.merit)
SELECT 1 AS place, attribute, round(merit, 6) AS merit FROM a UNION ALL SELECT 2, attribute, round(merit, 6) FROM b UNION ALL SELECT 3, attribute, round(merit, 6) FROM c""", "orders")
def wrapper_selection(df):
    found = merit(df)
    chosen = greedy_forward(ATTRIBUTES, found)
    rows = [(i + 1, c, found(frozenset(chosen[: i + 1]))) for i, c in enumerate(chosen)]
    found.release()
    return rounded(df.sparkSession.createDataFrame(rows, "place int, attribute string, merit double"))


def definition(**more) -> U.Definition:
    data = {"table": "orders", "key": "o_orderkey", "target": "o_orderstatus", "columns": ["mixed", "plain"]}
    return U.Definition({"orders": data}, ["naive_bayes", "majority"], last=2, **more)


def _run(seed: int, rows: str = LABELS) -> str:
    found = f"{chosen()}"
    most = "(SELECT o_orderkey, f.fold, o_orderstatus, predicted FROM f JOIN (SELECT p.fold, o.o_orderstatus AS predicted FROM parts p JOIN f o ON p.fold <> o.fold GROUP BY p.fold, o.o_orderstatus QUALIFY row_number() OVER (PARTITION BY p.fold ORDER BY count(*) DESC, o.o_orderstatus) = 1) USING (fold))"
    return f"""(WITH {bayes(folded(seed, 3, rows), ["mixed", "plain"])} SELECT 'orders' AS dataset, scheme, {seed}::INT AS run, fold, count(*) AS n, (SELECT count(*) FROM f) - count(*) AS size, (count(*) FILTER (WHERE predicted = o_orderstatus))::BIGINT AS correct
    FROM (SELECT 'naive_bayes' AS scheme, * FROM {found} UNION ALL SELECT 'majority', * FROM {most}) GROUP BY 1, 2, 3, fold)"""


@query(f"SELECT * FROM {_run(1)} UNION ALL SELECT * FROM {_run(2)}", "orders")
def experiment_results(df):
    return U.results(definition(folds=3), lambda _: labelled(df)).select("dataset", "scheme", "run", "fold", "n", "size", "correct")


@query(f"""WITH r AS (SELECT *, correct / n AS value FROM (SELECT * FROM {_run(1)} UNION ALL SELECT * FROM {_run(2)})), d AS (SELECT a.value - b.value AS d FROM r a JOIN r b ON a.run = b.run AND a.fold = b.fold AND a.scheme = 'naive_bayes' AND b.scheme = 'majority')
SELECT 'orders' AS dataset, 'majority' AS scheme, count(*) AS n, round(avg(d) * 100, 6) AS mean_diff, round(avg(d) / (stddev_samp(d) * sqrt(1 / count(*) + 0.5)), 4) AS t FROM d""", "orders")
def experiment_test(df):
    found = U.results(definition(folds=3), lambda _: labelled(df))
    out = X.paired(found, "naive_bayes", "percent_correct", ratio=0.5).select("dataset", "scheme", "n", "mean_diff", "t")
    return out.select("dataset", "scheme", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 4).alias("t"))


@query(" UNION ALL ".join(f"SELECT *, {size}::INT AS total FROM {_run(1, f'SELECT * FROM ({LABELS}) QUALIFY row_number() OVER (ORDER BY ' + draw('o_orderkey', 1) + f') <= {size}')}" for size in (600, 1200)), "orders")
def learning_curve(df):
    d = definition(folds=3, producer="learning_rate", lower=600, step=600, upper=1200)
    d.last = 1
    return U.results(d, lambda _: labelled(df)).select("dataset", "scheme", "run", "fold", "n", "size", "correct", "total")


FRIEDMAN = """, m AS (SELECT dataset, scheme, avg(value) v FROM r GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY v) AS rank FROM m),
q AS (SELECT sum(s * s) q FROM (SELECT sum(rank) s FROM k GROUP BY scheme)), n AS (SELECT count(DISTINCT dataset) n, count(DISTINCT scheme) k FROM k), x AS (SELECT n, k, 12.0 / (n * k * (k + 1)) * q - 3 * n * (k + 1) AS x FROM n, q),
f AS (SELECT *, (n - 1) * x / (n * (k - 1) - x) AS f FROM x)"""


# three schemes: two degrees of freedom
@query(RESULTS + FRIEDMAN + " SELECT n AS datasets, k AS schemes, round(x, 6) AS statistic, round(exp(-x / 2), 6) AS p_value, round(f, 6) AS f_statistic, round(pow(1 + f / (n - 1), 1 - n), 6) AS f_p_value FROM f", "orders")
def friedman_tested(df):
    return rounded(X.friedman_tested(results(df), "value"))


T_TAIL = """1 - CASE WHEN df % 2 = 0 THEN sin(a) * list_sum(list_transform(range(df // 2), lambda j: exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4) + 2 * j * ln(cos(a)))))
WHEN df = 1 THEN 2 * a / pi() ELSE 2 / pi() * (a + sin(a) * list_sum(list_transform(range((df - 1) // 2), lambda j: exp(2 * lgamma(j + 1) - lgamma(2 * j + 2) + j * ln(4) + (2 * j + 1) * ln(cos(a)))))) END"""
PAIRED = f""", d AS (SELECT a.dataset, b.scheme, count(*) AS n, avg(a.value - b.value) AS m, avg(a.value - b.value) / (stddev_samp(a.value - b.value) * sqrt(1.0 / count(*) + 0.1)) AS t FROM r a JOIN r b USING (dataset, run, fold) WHERE a.scheme = 'F' AND b.scheme <> 'F' GROUP BY 1, 2),
p AS (SELECT *, {T_TAIL} AS p FROM (SELECT *, atan(abs(t) / sqrt(n - 1)) AS a, n - 1 AS df FROM d)), v AS (SELECT *, CASE WHEN p <= 0.05 THEN sign(m) ELSE 0 END::INT AS verdict FROM p)"""


@query(RESULTS + PAIRED + " SELECT dataset, scheme, n, round(t, 5) AS t, round(p, 6) AS p_value, verdict FROM v", "orders")
def paired_tested(df):
    return X.paired_tested(results(df), "F", "value", ratio=0.1).select("dataset", "scheme", "n", F.round("t", 5).alias("t"), F.round("p_value", 6).alias("p_value"), "verdict")


@query(RESULTS + PAIRED + " SELECT scheme, count(*) FILTER (WHERE verdict < 0) AS wins, count(*) FILTER (WHERE verdict = 0) AS ties, count(*) FILTER (WHERE verdict > 0) AS losses FROM v GROUP BY 1", "orders")
def cross_table(df):
    return X.cross_table(X.paired_tested(results(df), "F", "value", ratio=0.1))


@query(RESULTS + """, d AS (SELECT a.dataset, a.run, a.value - b.value AS d FROM r a JOIN r b USING (dataset, run, fold) WHERE a.scheme = 'F' AND b.scheme = 'O' AND a.value <> b.value),
k AS (SELECT *, rank() OVER (PARTITION BY dataset, run ORDER BY abs(d)) AS rank FROM d), w AS (SELECT dataset, run, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rank ELSE 0 END), sum(CASE WHEN d < 0 THEN rank ELSE 0 END)) AS w FROM k GROUP BY 1, 2),
s AS (SELECT mask, list_sum(list_transform(range(12), lambda i: ((mask >> i) & 1) * (i + 1))) AS s FROM range(4096) t(mask))
SELECT dataset, run, n, round(least(1, 2 * count(*) / (1 << n)::DOUBLE), 6) AS p_value FROM w JOIN s ON mask < (1 << n) AND s <= w GROUP BY dataset, run, n""", "orders")
def wilcoxon_tested(df):
    r = results(df)
    a, b = (r.where(F.col("scheme") == s).select("dataset", "run", "fold", F.col("value").alias(n)) for s, n in (("F", "a"), ("O", "b")))
    return rounded(X.wilcoxon_tested(a.join(b, ["dataset", "run", "fold"]), "a", "b", ["dataset", "run"]).select("dataset", "run", "n", "p_value"))
