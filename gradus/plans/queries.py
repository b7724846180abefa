"""Queries over the sample tables, each beside the SQL that says the same. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import degrees
from ..operators import columns as C
from ..operators import experiments as X
from ..operators import measures as M
from ..operators import neighbours as N
from ..operators import ordering as O
from ..operators import rows as R
from ..operators import selection as S
from ..operators import supervised as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, table: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(read(spark, sf_dir, table))) if table else f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(f"""WITH s AS (SELECT min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) p0, max(l_extendedprice) p1 FROM lineitem)
SELECT {LINE}, round((l_quantity - q0) / (q1 - q0), 6) AS l_quantity, round((l_extendedprice - p0) / (p1 - p0), 6) AS l_extendedprice FROM lineitem, s
WHERE l_discount > 0.05 AND l_returnflag = 'R'""", "lineitem")
def normalize(df):
    fitted = C.fit_normalize(df, ["l_quantity", "l_extendedprice"])
    kept = R.subset_by_expression(df, "l_discount > 0.05 and l_returnflag = 'R'")
    return rounded(fitted.transform(kept).select(*KEYS, "l_quantity", "l_extendedprice"))


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 5) AS c_acctbal FROM customer", "customer")
def standardize(df):
    return rounded(C.fit_standardize(df, ["c_acctbal"]).transform(df).select("c_custkey", "c_acctbal"), 5)


@query("SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 5) AS c_acctbal FROM customer", "customer")
def center(df):
    return rounded(C.fit_center(df, ["c_acctbal"]).transform(df).select("c_custkey", "c_acctbal"), 5)


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 5000 THEN 5000 ELSE floor(c_acctbal * 10 + 0.5) / 10 END::DOUBLE AS c_acctbal FROM customer", "customer")
def numeric_cleaner(df):
    return C.numeric_clean(df, ["c_acctbal"], low=0, low_value=0, high=5000, high_value=5000, decimals=1).select("c_custkey", "c_acctbal")


@query(f"SELECT {LINE}, CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END::INT AS l_discount_binarized FROM lineitem", "lineitem")
def numeric_to_binary(df):
    return C.numeric_to_binary(df, ["l_discount"]).select(*KEYS, "l_discount_binarized")


@query("SELECT o_orderkey, round((o_totalprice - a) / b * n, 3) AS o_totalprice FROM orders, (SELECT avg(o_totalprice) a, max(o_totalprice) b, count(*) n FROM orders)", "orders")
def math_expression(df):
    return rounded(C.fit_math(df, ["o_totalprice"], lambda x, s: (x - s["MEAN"]) / s["MAX"] * s["COUNT"]).transform(df).select("o_orderkey", "o_totalprice"), 3)


@query(f"SELECT {LINE}, round(ln(l_extendedprice) + sqrt(l_quantity) * pow(1 - l_discount, 2), 6) AS score FROM lineitem", "lineitem")
def add_expression(df):
    return rounded(C.add_expression(df, "score", "ln(l_extendedprice) + sqrt(l_quantity) * pow(1 - l_discount, 2)").select(*KEYS, "score"))


@query("""SELECT c_custkey, round(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal >= 0)), 5) AS c_acctbal,
coalesce(nullif(c_mktsegment, 'BUILDING'), (SELECT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM customer""", "customer")
def replace_missing(df):
    holes = df.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return rounded(C.fit_replace_missing(holes, ["c_acctbal"], ["c_mktsegment"]).transform(holes), 5)


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'unknown') AS c_mktsegment FROM customer", "customer")
def replace_with_constant(df):
    return C.replace_missing_with(df.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment")), {"c_mktsegment": "unknown"})


@query(f"SELECT {LINE}, l_returnflag || '_x_' || l_linestatus AS both FROM lineitem", "lineitem")
def cartesian_product(df):
    return C.cartesian_product(df, ["l_returnflag", "l_linestatus"], "both").select(*KEYS, "both")


@query("SELECT o_orderkey, o_orderstatus, o_orderstatus AS \"Copy of o_orderstatus\", NULL::DOUBLE AS extra, 'x' AS tag FROM orders", "orders")
def copy_and_add(df):
    out = C.add_constants(C.add_column(C.copy_columns(df, ["o_orderstatus"]), "extra", "double"), [("tag", "string", "x")])
    return out.select("o_orderkey", "o_orderstatus", "Copy of o_orderstatus", "extra", "tag")


@query(f"SELECT {LINE}, round(l_extendedprice - l_quantity, 6) AS \"FO l_extendedprice\", round(l_discount - l_extendedprice, 6) AS \"FO l_discount\" FROM lineitem", "lineitem")
def first_order(df):
    return rounded(C.first_order(df.select(*KEYS, "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT o_orderkey, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS o_orderpriority FROM orders", "orders")
def make_indicator(df):
    return C.make_indicator(df, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '1-URGENT_2-HIGH' ELSE o_orderpriority END AS o_orderpriority FROM orders", "orders")
def merge_two_values(df):
    return C.merge_values(df, "o_orderpriority", ["1-URGENT", "2-HIGH"], "1-URGENT_2-HIGH").select("o_orderkey", "o_orderpriority")


@query(f"SELECT {LINE}, CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'R' THEN 'A' ELSE l_returnflag END AS l_returnflag FROM lineitem", "lineitem")
def swap_values(df):
    return C.swap_values(df, "l_returnflag", "A", "R").select(*KEYS, "l_returnflag")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE c_mktsegment END AS c_mktsegment FROM customer", "customer")
def rename_values(df):
    return C.rename_values(df, ["c_mktsegment"], {"BUILDING": "b", "MACHINERY": "m"}).select("c_custkey", "c_mktsegment")


@query("""WITH n AS (SELECT p_brand, count(*) c FROM part GROUP BY 1), r AS (SELECT p_brand FROM n WHERE c < (SELECT avg(c) FROM n)), m AS (SELECT string_agg(p_brand, '_or_' ORDER BY p_brand) AS name, count(*) k FROM r)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM r) AND k > 1 THEN name ELSE p_brand END AS p_brand FROM part, m""", "part")
def merge_infrequent(df):
    mean = df.groupBy("p_brand").count().agg(F.avg("count")).first()[0]
    return C.fit_merge_infrequent(df, "p_brand", mean).transform(df).select("p_partkey", "p_brand")


@query(f"SELECT {LINE}, (l_returnflag = 'A')::INT::DOUBLE AS \"l_returnflag=A\", (l_returnflag = 'N')::INT::DOUBLE AS \"l_returnflag=N\", (l_returnflag = 'R')::INT::DOUBLE AS \"l_returnflag=R\" FROM lineitem", "lineitem")
def nominal_to_binary(df):
    return C.one_hot(df.select(*KEYS, "l_returnflag"), "l_returnflag", C.labels_of(df, "l_returnflag"))


@query("SELECT o_orderkey, epoch_ms(date_trunc('month', o_orderdate))::DOUBLE AS month_ms FROM orders", "orders")
def date_filters(df):
    out = C.change_date_format(df, "o_orderdate", "yyyy-MM").withColumnRenamed("o_orderdate", "month_ms")
    return C.date_to_numeric(out, ["month_ms"]).select("o_orderkey", "month_ms")


@query("SELECT c_custkey AS custkey, c_acctbal AS acctbal, c_acctbal AS acctbal_2 FROM customer", "customer")
def rename_reorder_remove(df):
    short = C.rename_by_pattern(C.remove_by_name(df, "c_(name|mkt.*|nationkey)"), "^c_", "")
    return C.reorder(short, ["custkey", "acctbal", "acctbal"])


@query("SELECT p_partkey, p_size, p_retailprice FROM part", "part")
def remove_types_and_useless(df):
    return C.remove_useless(C.remove_type(df.withColumn("same", F.lit(1)), {"string"}))


@query("""SELECT c_custkey, CASE WHEN c_acctbal <= lo + (hi - lo) / 10 THEN 0 WHEN c_acctbal <= lo + (hi - lo) / 10 * 2 THEN 1 WHEN c_acctbal <= lo + (hi - lo) / 10 * 3 THEN 2 WHEN c_acctbal <= lo + (hi - lo) / 10 * 4 THEN 3
WHEN c_acctbal <= lo + (hi - lo) / 10 * 5 THEN 4 WHEN c_acctbal <= lo + (hi - lo) / 10 * 6 THEN 5 WHEN c_acctbal <= lo + (hi - lo) / 10 * 7 THEN 6 WHEN c_acctbal <= lo + (hi - lo) / 10 * 8 THEN 7 WHEN c_acctbal <= lo + (hi - lo) / 10 * 9 THEN 8 ELSE 9 END AS c_acctbal
FROM customer, (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer)""", "customer")
def discretize_equal_width(df):
    return C.fit_equal_width(df, ["c_acctbal"]).transform(df).select("c_custkey", "c_acctbal")


EQUAL_FREQUENCY = """WITH k AS (SELECT c_acctbal AS v, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1), t AS (SELECT v, n, ceil(sum(n) OVER (ORDER BY v) * {bins} / (SELECT sum(n) FROM k)::DOUBLE) AS share FROM k)
SELECT (dense_rank() OVER (ORDER BY share) - 1)::INT AS c_acctbal, sum(n)::BIGINT AS count FROM t GROUP BY share"""


@query(EQUAL_FREQUENCY.format(bins="8"), "customer")
def discretize_equal_frequency(df):
    return C.fit_equal_frequency(df, "c_acctbal", 8).transform(df).groupBy("c_acctbal").count()


@query(EQUAL_FREQUENCY.format(bins="floor(sqrt((SELECT count(*) FROM customer)))"), "customer")
def discretize_pki(df):
    return C.fit_equal_frequency(df, "c_acctbal").transform(df).groupBy("c_acctbal").count()


@query(None, "lineitem")
def discretize_supervised(df):
    return V.fit_discretize(df, ["l_quantity", "l_discount"], "l_returnflag").transform(df).groupBy("l_quantity", "l_discount").count()


@query("""WITH v AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part), h AS (SELECT n, n // 2 AS half, n // 2 // 2 AS q FROM v LIMIT 1),
q AS (SELECT CASE WHEN half % 2 = 1 THEN (SELECT v FROM v WHERE i = q) ELSE (SELECT avg(v) FROM v WHERE i IN (q, q + 1)) END AS q1,
CASE WHEN half % 2 = 1 THEN (SELECT v FROM v WHERE i = h.n - q - 1) ELSE (SELECT avg(v) FROM v WHERE i IN (h.n - q - 1, h.n - q)) END AS q3 FROM h)
SELECT p_partkey, p_retailprice > q3 + 1.5 * (q3 - q1) OR p_retailprice < q1 - 1.5 * (q3 - q1) AS outlier FROM part, q""", "part")
def quartile_outliers(df):
    state = C.fit_quartile_flags(df, "p_retailprice", 1.5, 1e9).state
    return df.select("p_partkey", state["outlier"].alias("outlier"))


@query(f"SELECT {LINE}, l_quantity FROM lineitem WHERE l_quantity * (1 - l_discount) > 20 AND NOT (l_returnflag = 'A')", "lineitem")
def subset_by_expression(df):
    return R.subset_by_expression(df, "l_quantity * (1 - l_discount) > 20 and not (l_returnflag = 'A')").select(*KEYS, "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT o_totalprice < 100000", "orders")
def remove_with_values(df):
    return R.remove_with_values(df, "o_totalprice", below=100000).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)", "customer")
def keep_frequent_values(df):
    return R.keep_frequent_values(df, "c_mktsegment", 2).select("c_custkey", "c_mktsegment")


@query("SELECT min(l_orderkey) AS l_orderkey, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", "lineitem")
def remove_duplicates(df):
    return R.remove_duplicates(df.select("l_orderkey", "l_returnflag", "l_linestatus"), "l_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r NOT BETWEEN 11 AND 200", "orders")
def remove_range(df):
    return R.remove_range(df, "o_orderkey", 11, 200).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, floor(count(*) OVER () * 35 / 100.0 + 0.5) AS k FROM orders) WHERE r > k", "orders")
def remove_percentage(df):
    return R.remove_percentage(df, "o_orderkey", 35).select("o_orderkey")


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey)::INT AS fold FROM orders", "orders")
def folds(df):
    return R.folds(df, "o_orderkey", 7).select("o_orderkey", "fold")


@query("SELECT o_orderstatus, fold, count(*) AS n FROM (SELECT o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 + 1)::INT AS fold FROM orders) GROUP BY ALL", "orders")
def stratified_folds(df):
    return R.stratified_folds(df, "o_orderkey", "o_orderstatus", 5).groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT least(1000, count(*)) AS n, least(1000, count(*)) AS d FROM orders", "orders")
def resample(df):
    return R.resample(df, "o_orderkey", 1000).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("d"))


@query("SELECT count(*) AS n FROM orders", "orders")
def resample_with_replacement(df):
    return R.resample_with_replacement(df, "o_orderkey", df.count()).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, round((SELECT count(*) FROM customer) / (SELECT count(DISTINCT c_mktsegment) FROM customer), 6) AS total FROM customer GROUP BY 1", "customer")
def class_balancer(df):
    return rounded(R.class_weights(df, "c_mktsegment").groupBy("c_mktsegment").agg(F.sum("_weight").alias("total")))


@query("WITH n AS (SELECT o_orderstatus, count(*) c FROM orders GROUP BY 1) SELECT o_orderstatus, least(c, (SELECT floor(min(c) * 1.5)::BIGINT FROM n)) AS n FROM n", "orders")
def spread_subsample(df):
    return R.spread_subsample(df, "o_orderkey", "o_orderstatus", 1.5).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("WITH n AS (SELECT o_orderstatus, count(*) c FROM orders GROUP BY 1) SELECT sum(floor(c * 10 / 100.0 + 0.5))::BIGINT AS changed FROM n", "orders")
def add_noise(df):
    labels = C.labels_of(df, "o_orderstatus")
    noisy = R.add_noise(df, "o_orderkey", "o_orderstatus", labels, 10).select("o_orderkey", F.col("o_orderstatus").alias("new"))
    return df.join(noisy, "o_orderkey").where("new <> o_orderstatus").agg(F.count(F.lit(1)).alias("changed"))


@query("SELECT event_id, round(value - lag(value, 2) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS value FROM events", "events")
def time_series_delta(df):
    return rounded(O.shifted(df.select("event_id", "user_id", "value"), "event_id", ["value"], -2, ["user_id"], delta=True).select("event_id", "value"))


@query("SELECT o_orderkey, lag(o_totalprice, 3) OVER (ORDER BY o_orderkey) AS o_totalprice FROM orders", "orders")
def time_series_translate(df):
    return O.shifted(df.select("o_orderkey", "o_totalprice"), "o_orderkey", ["o_totalprice"], -3)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders", "orders")
def add_id(df):
    return O.numbered(df, "o_orderkey", "id").select("o_orderkey", "id")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, word, n, round(ln(1 + n), 6) AS tf, count(*) OVER (PARTITION BY word) AS df FROM c""", "documents")
def word_counts(df):
    return rounded(C.word_counts(df, "doc_id", "text"))


ENTROPY = """WITH long AS (SELECT l_linestatus AS c, unnest(['l_returnflag', 'l_linenumber', 'l_quantity']) AS attribute, unnest([l_returnflag, l_linenumber::VARCHAR, l_quantity::VARCHAR]) AS v FROM lineitem),
n AS (SELECT count(*)::DOUBLE AS n FROM lineitem),
j AS (SELECT attribute, -sum(k / n * log2(k / n)) AS h FROM (SELECT attribute, v, c, count(*) k FROM long GROUP BY ALL), n GROUP BY 1),
a AS (SELECT attribute, -sum(k / n * log2(k / n)) AS h FROM (SELECT attribute, v, count(*) k FROM long GROUP BY ALL), n GROUP BY 1),
b AS (SELECT attribute, -sum(k / n * log2(k / n)) AS h FROM (SELECT attribute, c, count(*) k FROM long GROUP BY ALL), n GROUP BY 1)
SELECT attribute, round(a.h + b.h - j.h, 6) AS info_gain, round((a.h + b.h - j.h) / a.h, 6) AS gain_ratio, round(2 * (a.h + b.h - j.h) / (a.h + b.h), 6) AS symmetrical_uncertainty FROM j JOIN a USING (attribute) JOIN b USING (attribute)"""


@query(ENTROPY, "lineitem")
def entropy_scores(df):
    return rounded(S.entropy_scores(df, ["l_returnflag", "l_linenumber", "l_quantity"], "l_linestatus"))


@query("""SELECT attribute, round(sum(m) * 100.0 / sum(t), 6) AS accuracy FROM (SELECT attribute, v, max(k) m, sum(k) t FROM (
SELECT attribute, v, c, count(*) k FROM (SELECT l_returnflag AS c, unnest(['l_linestatus', 'l_linenumber']) AS attribute, unnest([l_linestatus, l_linenumber::VARCHAR]) AS v FROM lineitem) GROUP BY ALL) GROUP BY ALL) GROUP BY 1""", "lineitem")
def one_rule_scores(df):
    return rounded(S.one_rule_scores(df, ["l_linestatus", "l_linenumber"], "l_returnflag"))


@query("SELECT 'l_quantity' AS attribute, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_discount, l_extendedprice), 6) FROM lineitem", "lineitem")
def correlation_scores(df):
    return rounded(S.correlation_scores(df, ["l_quantity", "l_discount"], "l_extendedprice"))


CFS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


# four attributes have fifteen subsets; the best-first search reaches the best of them
@query("WITH RECURSIVE r AS (" + " UNION ALL ".join(f"SELECT {1 << i} AS a, {1 << j if j < 4 else 0} AS b, abs(corr({a}, {b})) AS r FROM lineitem" for i, a in enumerate(CFS) for j, b in enumerate([*CFS, "l_extendedprice"]) if j > i) + f"""),
m AS (SELECT mask, sum(CASE WHEN b = 0 THEN r ELSE 0 END) / sqrt(bit_count(mask) + 2 * sum(CASE WHEN b > 0 THEN r ELSE 0 END)) AS merit FROM range(1, 16) t(mask), r WHERE mask & a = a AND mask & b = b GROUP BY 1),
walk AS (SELECT 0 AS place, 0::BIGINT AS mask, -1e9::DOUBLE AS merit, NULL::BIGINT AS bit UNION ALL
SELECT any_value(place) + 1, arg_max(m.mask, m.merit), max(m.merit), arg_max(m.mask - walk.mask, m.merit) FROM walk JOIN m ON bit_count(m.mask) = place + 1 AND m.mask & walk.mask = walk.mask AND m.merit > walk.merit GROUP BY place),
best AS (SELECT mask FROM m ORDER BY merit DESC LIMIT 1), n AS (SELECT unnest({CFS}) AS attribute, unnest([1, 2, 4, 8]) AS bit)
SELECT 'forward' AS search, place - 1 AS place, attribute FROM walk JOIN n USING (bit) UNION ALL SELECT 'best_first', row_number() OVER (ORDER BY n.bit) - 1, attribute FROM n, best WHERE mask & n.bit > 0""", "lineitem")
def cfs_selection(df):
    names = CFS
    merit = S.cfs_merit(S.correlations(df, names, "l_extendedprice"), "l_extendedprice")
    rows = [(way, i, c) for way, found in (("forward", S.greedy_forward(names, merit)), ("best_first", S.best_first(names, merit))) for i, c in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, "search string, place int, attribute string")


@query("""SELECT n_regionkey, n_name, p FROM (WITH k AS (SELECT n_regionkey, n_name, count(*) n FROM nation GROUP BY ALL) SELECT n_regionkey, n_name, round((n + 1)::DOUBLE / (sum(n) OVER (PARTITION BY n_regionkey) + (SELECT count(DISTINCT n_name) FROM nation)), 6) AS p FROM k)""", "nation")
def class_conditional(df):
    return rounded(V.class_conditional(df, "n_name", "n_regionkey"))


@query("SELECT CASE WHEN s_nationkey < 5 THEN 'few' ELSE 'many' END AS kind, count(*) * CASE WHEN s_nationkey < 5 AND count(*) > 1 THEN 3 ELSE 1 END AS count FROM supplier GROUP BY s_nationkey < 5", "supplier")
def smote(df):
    few = df.withColumn("kind", F.when(F.col("s_nationkey") < 5, "few").otherwise("many")).select("s_suppkey", "s_acctbal", "kind")
    return V.smote(few, "s_suppkey", ["s_acctbal"], "kind", "few", 200).groupBy("kind").count()


CONNECTIVES = {
    "t_algebraic": "a * b", "t_min": "least(a, b)", "t_lukasiewicz": "greatest(a + b - 1, 0)", "s_algebraic": "a + b - a * b", "s_max": "greatest(a, b)", "s_lukasiewicz": "least(1, a + b)", "s_einstein": "(a + b) / (1 + a * b)",
    "s_drastic": "CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE 1 END", "s_sum": "a + b", "i_lukasiewicz": "least(1, 1 - a + b)", "i_kleene_dienes": "greatest(1 - a, b)", "i_reichenbach": "1 - a + a * b",
    "i_goedel": "CASE WHEN a <= b THEN 1 ELSE b END", "i_gaines": "CASE WHEN a <= b THEN 1 ELSE b / a END",
}


@query(f"SELECT {LINE}, a, b, " + ", ".join(f"round({f}, 6)::DOUBLE AS {name}" for name, f in CONNECTIVES.items()) + f" FROM (SELECT {LINE}, round(l_discount * 10, 4) AS a, round(l_tax * 12.5, 4) AS b FROM lineitem)", "lineitem")
def connectives(df):
    rows = df.select(*KEYS, F.round(F.col("l_discount") * 10, 4).alias("a"), F.round(F.col("l_tax") * 12.5, 4).alias("b"))
    groups = (("t", degrees.T_NORMS), ("s", degrees.S_NORMS), ("i", degrees.IMPLICATORS))
    return rounded(rows.select(*KEYS, "a", "b", *[f(F.col("a"), F.col("b")).cast("double").alias(f"{p}_{n}") for p, g in groups for n, f in g.items()]))


PAIRS = """WITH s AS (SELECT max(s_acctbal) - min(s_acctbal) AS r, max(s_suppkey) - min(s_suppkey) AS q FROM supplier),
p AS (SELECT a.s_suppkey AS x, a.s_nationkey = b.s_nationkey AS same, greatest(greatest(0, 1 - abs(a.s_acctbal - b.s_acctbal) / r) + greatest(0, 1 - abs(a.s_suppkey - b.s_suppkey) / q) - 1, 0) AS sim FROM supplier a, supplier b, s)"""


@query(PAIRS + " SELECT round(avg(m), 6) AS gamma, round(min(m), 6) AS delta FROM (SELECT x, min(CASE WHEN same THEN 1 ELSE least(1, 1 - sim) END) AS m FROM p GROUP BY x)", "supplier")
def fuzzy_gamma(df):
    return rounded(M.gamma(df, ["s_acctbal", "s_suppkey"], "s_nationkey"))


@query("""WITH s AS (SELECT max(c_acctbal) - min(c_acctbal) AS r FROM customer), p AS (SELECT a.c_custkey AS x, max(greatest(0, 1 - abs(a.c_acctbal - b.c_acctbal) / r)) AS best FROM customer a JOIN customer b ON a.c_mktsegment <> b.c_mktsegment, s GROUP BY 1)
SELECT round(avg(1 - best), 6) AS gamma, round(min(1 - best), 6) AS delta FROM p""", "customer")
def fuzzy_gamma_one_attribute(df):
    return rounded(M.gamma(df, ["c_acctbal"], "c_mktsegment"))


@query(PAIRS + """ SELECT round(avg(CASE WHEN r <= 0.2 THEN 0 WHEN r <= 0.6 THEN 2 * pow((r - 0.2) / 0.8, 2) ELSE 1 - 2 * pow((r - 1) / 0.8, 2) END), 6) AS vqrs
FROM (SELECT x, sum(CASE WHEN same THEN sim ELSE 0 END) / sum(sim) AS r FROM p GROUP BY x)""", "supplier")
def fuzzy_vqrs(df):
    return rounded(M.vqrs(df, ["s_acctbal", "s_suppkey"], "s_nationkey"))


@query(PAIRS + " SELECT round(1 - sum(CASE WHEN same THEN 0 ELSE sim END) / (SELECT count(*) * (count(*) - 1) FROM supplier), 6) AS discernibility FROM p", "supplier")
def fuzzy_discernibility(df):
    return rounded(M.discernibility(df, ["s_acctbal", "s_suppkey"], "s_nationkey"))


@query(PAIRS + " SELECT round(avg(sim), 6) AS granularity FROM p", "supplier")
def fuzzy_granularity(df):
    return rounded(M.granularity(df, ["s_acctbal", "s_suppkey"], "s_nationkey"))


NEAR = """WITH s AS (SELECT max(s_acctbal) - min(s_acctbal) AS r, max(s_suppkey) - min(s_suppkey) AS q FROM supplier),
p AS (SELECT a.s_suppkey AS query, b.s_suppkey, b.s_nationkey, (greatest(0, 1 - abs(a.s_acctbal - b.s_acctbal) / r) + greatest(0, 1 - abs(a.s_suppkey - b.s_suppkey) / q)) / 2 AS sim FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey, s),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, s_suppkey) <= 5)"""


@query(NEAR + " SELECT query, s_nationkey AS class, round(sum(sim) / any_value(t), 6) AS score FROM n JOIN (SELECT query, sum(sim) t FROM n GROUP BY 1) USING (query) GROUP BY 1, 2", "supplier")
def fuzzy_nn(df):
    return rounded(N.fuzzy_nn(N.nearest(df, df, "s_suppkey", ["s_acctbal", "s_suppkey"], "s_nationkey", 5), "s_nationkey"))


@query(NEAR + """, w AS (SELECT query, s_nationkey, sim / max(sim) OVER (PARTITION BY query) AS w FROM n), c AS (SELECT DISTINCT query, s_nationkey AS class FROM n)
SELECT query, class, round((min(greatest(1 - w, (s_nationkey = class)::INT)) + max(least(w, (s_nationkey = class)::INT))) / 2, 6) AS score FROM w JOIN c USING (query) GROUP BY 1, 2""", "supplier")
def fuzzy_rough_nn(df):
    return rounded(N.fuzzy_rough_nn(N.nearest(df, df, "s_suppkey", ["s_acctbal", "s_suppkey"], "s_nationkey", 5), "s_nationkey"))


@query(None, "supplier")
def vague_quantifier_nn(df):
    return rounded(N.vague_quantifier_nn(N.nearest(df, df, "s_suppkey", ["s_acctbal", "s_suppkey"], "s_nationkey", 5), "s_nationkey"))


@query(NEAR + " SELECT query, s_nationkey AS class, round(sum(CASE WHEN sim > 0 THEN exp(-1 / sim) ELSE 0 END) / 5, 6) AS score FROM n GROUP BY 1, 2", "supplier")
def ownership_nn(df):
    return rounded(N.ownership_nn(N.nearest(df, df, "s_suppkey", ["s_acctbal", "s_suppkey"], "s_nationkey", 5), "s_nationkey", 5))


RESULTS = "WITH r AS (SELECT o_orderpriority AS dataset, o_orderstatus AS scheme, (year(o_orderdate))::INT AS run, (month(o_orderdate))::INT AS fold, max(o_totalprice) AS value FROM orders GROUP BY ALL)"


def results(df):
    return df.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("scheme"), F.year("o_orderdate").alias("run"), F.month("o_orderdate").alias("fold")).agg(F.max("o_totalprice").alias("value"))


@query(RESULTS + " SELECT dataset, scheme, run, count(*) AS n, round(avg(value), 6) AS avg_value, round(stddev_samp(value), 6) AS sd_value FROM r GROUP BY ALL", "orders")
def averaged_results(df):
    return rounded(X.averaged(results(df), ["dataset", "scheme", "run"], ["value"]), 6)


@query(RESULTS + """, d AS (SELECT a.dataset, b.scheme, a.value AS x, b.value AS y FROM r a JOIN r b USING (dataset, run, fold) WHERE a.scheme = 'F' AND b.scheme <> 'F')
SELECT dataset, scheme, count(*) AS n, round(avg(x - y), 3) AS mean_diff, round(stddev_samp(x - y), 3) AS sd_diff, round(corr(x, y), 3) AS correlation, round(avg(x - y) / (stddev_samp(x - y) * sqrt(1.0 / count(*) + 0.1)), 3) AS t FROM d GROUP BY 1, 2""", "orders")
def paired_t_corrected(df):
    return rounded(X.paired(results(df), "F", "value", ratio=0.1), 3)


@query(RESULTS + """, m AS (SELECT dataset, scheme, avg(value) v FROM r GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY v) + (count(*) OVER (PARTITION BY dataset, v) - 1) / 2.0 AS rank FROM m),
q AS (SELECT sum(s * s) q FROM (SELECT sum(rank) s FROM k GROUP BY scheme)), n AS (SELECT count(DISTINCT dataset) n, count(DISTINCT scheme) k FROM k)
SELECT n AS datasets, k AS schemes, round(12.0 / (n * k * (k + 1)) * q - 3 * n * (k + 1), 6) AS statistic FROM n, q""", "orders")
def friedman(df):
    return rounded(X.friedman(results(df), "value"))


@query(RESULTS + """, d AS (SELECT a.dataset, a.value - b.value AS d FROM r a JOIN r b USING (dataset, run, fold) WHERE a.scheme = 'F' AND b.scheme = 'O' AND a.value <> b.value),
k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, abs(d)) - 1) / 2.0 AS rank FROM d)
SELECT dataset, count(*) AS n, sum(CASE WHEN d > 0 THEN rank ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN rank ELSE 0 END)::DOUBLE AS w_minus,
round((abs(sum(CASE WHEN d > 0 THEN rank ELSE 0 END) - count(*) * (count(*) + 1) / 4.0) - 0.5) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0), 6) AS z FROM k GROUP BY 1""", "orders")
def wilcoxon(df):
    r = results(df)
    a, b = (r.where(F.col("scheme") == s).select("dataset", "run", "fold", F.col("value").alias(n)) for s, n in (("F", "a"), ("O", "b")))
    return rounded(X.wilcoxon(a.join(b, ["dataset", "run", "fold"]), "a", "b", ["dataset"]))


@query("""WITH k AS (SELECT l_linestatus AS g, l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rank, l_linestatus = min(l_linestatus) OVER (PARTITION BY l_returnflag) AS f FROM lineitem),
u AS (SELECT l_returnflag, count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2, sum(CASE WHEN f THEN rank ELSE 0 END)::DOUBLE AS r FROM k GROUP BY 1)
SELECT l_returnflag, n1, n2, r - n1 * (n1 + 1) / 2.0 AS u, round((r - n1 * (n1 + 1) / 2.0 - n1::DOUBLE * n2 / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12.0), 6) AS z FROM u WHERE n2 > 0""", "lineitem")
def mann_whitney(df):
    return rounded(X.mann_whitney(df, "l_extendedprice", "l_linestatus", ["l_returnflag"]).where("n2 > 0"))


@query("""WITH c AS (SELECT l_linestatus AS a, CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END AS p FROM lineitem), l AS (SELECT unnest(['F', 'O']) AS label),
k AS (SELECT label, count(*) FILTER (WHERE a = label AND p = label) AS tp, count(*) FILTER (WHERE a <> label AND p = label) AS fp, count(*) FILTER (WHERE a = label AND p <> label) AS fn FROM l, c GROUP BY 1)
SELECT label, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k""", "lineitem")
def classification_metrics(df):
    return rounded(X.classification_metrics(df.withColumn("p", F.when(F.col("l_returnflag") == "N", "O").otherwise("F")), "l_linestatus", "p"))


@query("""WITH m AS (SELECT avg(l_extendedprice) m FROM lineitem), e AS (SELECT l_extendedprice y, l_quantity * 1500 AS p FROM lineitem)
SELECT count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(sum(abs(p - y)) * 100 / sum(abs(y - m)), 4) AS rae, round(sqrt(sum((p - y) * (p - y)) / sum((y - m) * (y - m))) * 100, 4) AS rrse, round(corr(y, p), 4) AS correlation FROM e, m""", "lineitem")
def regression_metrics(df):
    mean = df.agg(F.avg("l_extendedprice")).first()[0]
    return rounded(X.regression_metrics(df.withColumn("p", F.col("l_quantity") * 1500), "l_extendedprice", "p", mean), 4)
