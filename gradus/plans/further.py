"""More queries over the sample tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import experiments as X
from ..operators import graded as G
from ..operators import instances as I
from ..operators import measures as M
from ..operators import ordering as O
from ..operators import rows as R
from ..operators import supervised as V
from .queries import KEYS, LINE, NEAR, RESULTS, SQL, query, results, rounded

DRAW = "('0x' || substr(md5('{seed}|' || {key}::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE"


def draw(key: str, seed: int = 1) -> str:
    return DRAW.format(key=key, seed=seed)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'soon' ELSE o_orderpriority END AS o_orderpriority FROM orders", "orders")
def merge_many_values(df):
    return C.merge_values(df, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "soon").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, date_trunc('second', o_orderdate)::TIMESTAMP AS o_orderdate FROM orders", "orders")
def numeric_to_date(df):
    return C.numeric_to_date(C.date_to_numeric(df, ["o_orderdate"]), ["o_orderdate"]).select("o_orderkey", F.date_trunc("second", "o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query(f"SELECT {LINE}, round(sqrt(l_extendedprice), 6) AS l_extendedprice FROM lineitem", "lineitem")
def numeric_transform(df):
    return rounded(C.numeric_transform(df, ["l_extendedprice"], "sqrt").select(*KEYS, "l_extendedprice"))


@query("SELECT o_orderkey AS \"A1\", CASE o_orderstatus WHEN 'F' THEN 'V1' WHEN 'O' THEN 'V2' WHEN 'P' THEN 'V3' END AS \"A2\" FROM orders", "orders")
def obfuscate(df):
    return C.obfuscate(df.select("o_orderkey", "o_orderstatus"), {"o_orderstatus": ["F", "O", "P"]})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END::DOUBLE AS o_orderstatus FROM orders", "orders")
def ordinal_to_numeric(df):
    return C.ordinal_to_numeric(df, "o_orderstatus", ["F", "O", "P"]).select("o_orderkey", "o_orderstatus")


@query(f"SELECT c_custkey, CASE WHEN {draw('c_custkey', 2)} >= 0.3 THEN c_acctbal END AS c_acctbal FROM customer", "customer")
def replace_with_missing(df):
    return R.replace_with_missing(df.select("c_custkey", "c_acctbal"), "c_custkey", ["c_acctbal"], 0.3)


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {draw('o_orderkey')}) AS place FROM orders", "orders")
def randomize(df):
    return R.shuffled(df, "o_orderkey").select("o_orderkey", "place")


@query(f"SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {draw('o_orderkey')}) <= 1000", "orders")
def resample_rows(df):
    return R.resample(df, "o_orderkey", 1000).select("o_orderkey")


@query(f"""WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)
SELECT o_orderkey, count(*) AS times FROM (SELECT floor({draw('i')} * n)::BIGINT + 1 AS r FROM n, (SELECT unnest(range(0, 5000)) AS i)) JOIN k USING (r) GROUP BY 1""", "orders")
def resample_with_replacement_rows(df):
    return R.resample_with_replacement(df, "o_orderkey", 5000).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))


@query(f"""SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {draw('o_orderkey')}) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n, count(*) OVER () AS total,
(SELECT count(DISTINCT o_orderstatus) FROM orders) AS k FROM orders) WHERE r <= floor(0.5::DOUBLE * (0.5::DOUBLE * n + 0.5::DOUBLE * (total / k)))""", "orders")
def class_resample(df):
    return R.class_resample(df, "o_orderkey", "o_orderstatus", 50, 0.5).select("o_orderkey", "o_orderstatus")


@query(f"""WITH n AS (SELECT floor(min(c) * 1.5) AS cap FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus))
SELECT o_orderkey FROM orders, n QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY {draw('o_orderkey')}) <= any_value(cap) OVER ()""", "orders")
def spread_subsample_rows(df):
    return R.spread_subsample(df, "o_orderkey", "o_orderstatus", 1.5).select("o_orderkey")


@query(f"""SELECT o_orderkey, CASE WHEN r <= floor(n * 10 / 100.0 + 0.5) THEN CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE 'F' END ELSE o_orderstatus END AS o_orderstatus
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {draw('o_orderkey')}) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""", "orders")
def class_noise(df):
    return R.add_noise(df, "o_orderkey", "o_orderstatus", ["F", "O", "P"], 10).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, round((SELECT count(*) FROM customer)::DOUBLE / (SELECT count(DISTINCT c_mktsegment) FROM customer) / count(*) OVER (PARTITION BY c_mktsegment), 6) AS weight FROM customer", "customer")
def class_weights(df):
    return rounded(R.class_weights(df, "c_mktsegment").select("c_custkey", F.col("_weight").alias("weight")))


@query(f"""WITH s AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi, stddev_samp(c_acctbal) sd FROM customer), u AS (SELECT *, {draw('c_custkey', 3)} AS u, {draw('c_custkey', 4)} AS v, {draw('c_custkey', 1002)} AS w FROM customer)
SELECT c_custkey, round(CASE WHEN w < 0.2 THEN greatest(lo, least(hi, c_acctbal + sqrt(-2 * ln(1 - u)) * cos(v * 6.283185307179586) * 0.5 * sd)) ELSE c_acctbal END, 4) AS c_acctbal FROM u, s""", "customer")
def conditional_noise(df):
    two = df.select("c_custkey", "c_acctbal")
    return rounded(R.conditional_noise(two, "c_custkey", ["c_acctbal"], 0.2, 0.5, C.statistics(df, ["c_acctbal"])), 4)


@query("""SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_totalprice, (SELECT max(o_totalprice) FROM orders)) > 150000, false)""", "orders")
def subset_with_unknowns(df):
    top = df.agg(F.max("o_totalprice")).first()[0]
    price = F.nullif("o_totalprice", F.lit(top))
    return R.subset(df, ~R.holds(price > 150000)).select("o_orderkey")


@query("""WITH v AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part), h AS (SELECT n, n // 2 AS half, n // 2 // 2 AS q FROM v LIMIT 1),
q AS (SELECT CASE WHEN half % 2 = 1 THEN (SELECT v FROM v WHERE i = q) ELSE (SELECT avg(v) FROM v WHERE i IN (q, q + 1)) END AS q1,
CASE WHEN half % 2 = 1 THEN (SELECT v FROM v WHERE i = h.n - q - 1) ELSE (SELECT avg(v) FROM v WHERE i IN (h.n - q - 1, h.n - q)) END AS q3 FROM h),
f AS (SELECT p_partkey, p_retailprice > q3 + 0.3 * (q3 - q1) OR p_retailprice < q1 - 0.3 * (q3 - q1) AS extreme, p_retailprice > q3 + 0.1 * (q3 - q1) OR p_retailprice < q1 - 0.1 * (q3 - q1) AS far FROM part, q)
SELECT p_partkey, far AND NOT extreme AS outlier, extreme FROM f""", "part")
def quartile_flags(df):
    state = C.fit_quartile_flags(df, "p_retailprice", 0.1, 0.3).state
    return df.select("p_partkey", state["outlier"].alias("outlier"), state["extreme"].alias("extreme"))


@query("SELECT s_suppkey, s_nationkey::VARCHAR AS s_nationkey FROM supplier", "supplier")
def numeric_to_nominal(df):
    return C.numeric_to_nominal(df, ["s_nationkey"]).select("s_suppkey", "s_nationkey")


@query("""WITH l AS (SELECT c_mktsegment AS label, (row_number() OVER (ORDER BY count(*), c_mktsegment) - 1)::INT AS by_count, (row_number() OVER (ORDER BY c_mktsegment DESC) - 1)::INT AS by_name FROM customer GROUP BY 1)
SELECT c_custkey, by_count, by_name FROM customer JOIN l ON label = c_mktsegment""", "customer")
def class_order(df):
    out = C.with_label_place(df, "c_mktsegment", C.label_table(df, "c_mktsegment", "frequency"), "by_count")
    return C.with_label_place(out, "c_mktsegment", C.label_table(df, "c_mktsegment", descending=True), "by_name").select("c_custkey", "by_count", "by_name")


@query(f"""SELECT {LINE}, round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 6) AS l_quantity,
round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_samp(l_extendedprice) FROM lineitem), 5) AS l_extendedprice FROM lineitem""", "lineitem")
def multi_filter(df):
    out = C.multi_filter(df, [(["l_quantity"], C.fit_normalize), (["l_extendedprice"], C.fit_standardize)])
    return out.select(*KEYS, F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 5).alias("l_extendedprice"))


@query("""SELECT 'n_regionkey' AS attribute, """ + ", ".join(f"max(CASE WHEN n_nationkey = {i} THEN n_regionkey END)::DOUBLE AS \"{i}\"" for i in range(25)) + " FROM nation", "nation")
def transpose(df):
    return C.transpose(df.select("n_nationkey", "n_regionkey"), "n_nationkey")


@query(f"""WITH s AS (SELECT avg(l_quantity) a, stddev_samp(l_quantity) b, avg(l_extendedprice) c, stddev_samp(l_extendedprice) d, CASE WHEN corr(l_quantity, l_extendedprice) < 0 THEN -1 ELSE 1 END AS sign FROM lineitem)
SELECT {LINE}, round(((l_quantity - a) / b + sign * (l_extendedprice - c) / d) / sqrt(2), 4) + 0.0::DOUBLE AS "PC1", round(((l_quantity - a) / b - sign * (l_extendedprice - c) / d) / sqrt(2), 4) + 0.0::DOUBLE AS "PC2" FROM lineitem, s""", "lineitem")
def principal_components(df):
    apply, _ = C.fit_principal_components(df, ["l_quantity", "l_extendedprice"], variance=1.0)
    # no negative zeros
    return apply(df).select(*KEYS, *[(F.round(c, 4) + 0.0).alias(c) for c in ("PC1", "PC2")])


WORDS = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), d AS (SELECT word, sum(n) AS total, count(*) AS df FROM c GROUP BY 1)"


@query(WORDS + """, t AS (SELECT word, df FROM d WHERE total >= 5 AND word NOT IN ('the', 'of') ORDER BY total DESC, word LIMIT 200),
v AS (SELECT doc_id, word, ln(1 + n) * ln((SELECT count(*) FROM documents)::DOUBLE / df) AS weight FROM c JOIN t USING (word)), l AS (SELECT doc_id, sqrt(sum(weight * weight)) AS l FROM v GROUP BY 1)
SELECT doc_id, word, round(CASE WHEN l > 0 THEN weight * (SELECT avg(l) FROM l) / l ELSE 0 END, 4) AS weight FROM v JOIN l USING (doc_id)""", "documents")
def word_vectors(df):
    return rounded(C.word_vectors(df, "doc_id", "text", words=200, least=5, stop=("the", "of"), tf=True, idf=True, normalize=True), 4)


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS word FROM documents) SELECT doc_id, word, count(*)::DOUBLE AS weight FROM w WHERE word IN ('the', 'and', 'que', 'der') GROUP BY ALL""", "documents")
def dictionary_vectors(df):
    words = df.sparkSession.createDataFrame([("the",), ("and",), ("que",), ("der",)], "word string")
    return C.word_vectors(df, "doc_id", "text", words)


@query("SELECT o_orderkey, sum(o_totalprice::DECIMAL(18, 2)) OVER (ORDER BY o_orderkey) AS upto FROM orders", "orders")
def running_sums(df):
    return O.running(df.select("o_orderkey", "o_totalprice"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)"), "upto").select("o_orderkey", "upto")


GRADED = """WITH r AS (SELECT max(s_acctbal) - min(s_acctbal) AS r, max(s_suppkey) - min(s_suppkey) AS q FROM supplier), rows_ AS (SELECT s_suppkey, s_acctbal, (s_nationkey % 4)::VARCHAR AS c FROM supplier),
p AS (SELECT a.s_suppkey AS x, a.c AS cx, b.c AS cy, greatest(greatest(0, 1 - abs(a.s_acctbal - b.s_acctbal) / r) + greatest(0, 1 - abs(a.s_suppkey - b.s_suppkey) / q) - 1, 0) AS sim, (a.c = b.c)::INT::DOUBLE AS dec FROM rows_ a, rows_ b, r)"""


def graded_pairs(df, of=G.graded_pairs):
    rows = df.select("s_suppkey", "s_acctbal", (F.col("s_nationkey") % 4).cast("string").alias("c"))
    return of(rows, ["s_acctbal", "s_suppkey"], "c")


def by_class(df):
    return graded_pairs(df, lambda *of: M.class_similarities(*of, parts=("total",)))


@query("""WITH r AS (SELECT max(s_acctbal) - min(s_acctbal) AS r, max(s_suppkey) - min(s_suppkey) AS q FROM supplier),
p AS (SELECT a.s_suppkey AS x, least(1, 1 - greatest(0, 1 - abs(a.s_suppkey - b.s_suppkey) / q) + greatest(0, 1 - abs(a.s_acctbal - b.s_acctbal) / r)) AS i FROM supplier a, supplier b, r)
SELECT round(avg(m), 6) AS weak_gamma, round(min(m), 6) AS weak_delta FROM (SELECT x, min(i) AS m FROM p GROUP BY 1)""", "supplier")
def weak_lower(df):
    return rounded(G.weak_lower_of(df.select("s_suppkey", "s_acctbal"), ["s_suppkey"], "s_acctbal"))


QUANTIFIER = "CASE WHEN {x} <= 0.2 THEN 0 WHEN {x} <= 0.6 THEN 2 * pow(({x} - 0.2) / 0.8, 2) WHEN {x} <= 1 THEN 1 - 2 * pow(({x} - 1) / 0.8, 2) ELSE 1 END"


@query(GRADED + f""", o AS (SELECT x, least(1, 1 - sim + dec) AS i, row_number() OVER (PARTITION BY x ORDER BY least(1, 1 - sim + dec) DESC)::DOUBLE AS k, count(*) OVER (PARTITION BY x)::DOUBLE AS n FROM p),
w AS (SELECT x, i, ({QUANTIFIER.format(x='(k / n)')}) - ({QUANTIFIER.format(x='((k - 1) / n)')}) AS w FROM o) SELECT round(avg(low), 6) AS weak_gamma_owa FROM (SELECT x, sum(i * w) AS low FROM w GROUP BY 1)""", "supplier")
def weak_owa(df):
    return rounded(graded_pairs(df, G.weak_owa_of))


@query(GRADED + """, c AS (SELECT DISTINCT cx AS c FROM p), m AS (SELECT x, c, max(CASE WHEN cy = c THEN sim ELSE 0 END) AS up, min(CASE WHEN cy = c THEN 1 ELSE least(1, 1 - sim) END) AS low FROM p, c GROUP BY 1, 2)
SELECT round(1 - avg(up - low), 6) AS boundary FROM m""", "supplier")
def boundary_region(df):
    return rounded(G.boundary_region(graded_pairs(df, M.class_nearest)))


@query(GRADED + """, s AS (SELECT x, cy, sum(sim) AS s FROM p GROUP BY 1, 2), q AS (SELECT x, s, s / sum(s) OVER (PARTITION BY x) AS p FROM s), h AS (SELECT x, sum(s) AS card, sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) AS h FROM q GROUP BY 1)
SELECT round(1 - sum(card * h) / sum(card) / log2((SELECT count(DISTINCT cx) FROM p)), 6) AS fuzzy_entropy FROM h""", "supplier")
def fuzzy_entropy(df):
    return rounded(G.fuzzy_entropy(by_class(df)))


@query(GRADED + """, g AS (SELECT x, sum(sim) AS s, sum(dec) AS d, sum(least(sim, dec)) AS j, count(*)::DOUBLE AS n FROM p GROUP BY 1),
e AS (SELECT avg(-log2(s / n)) AS hs, avg(-log2(d / n)) AS hd, avg(-log2(j / n)) AS hj, avg((n - s) / (n - 1)) AS us, avg((n - d) / (n - 1)) AS ud, avg((n - j) / (n - 1)) AS uj FROM g)
SELECT round((hs + hd - hj) / hj, 6) AS gain_ratio, round(hs + hd - hj, 6) AS mutual_information, round(us + ud - uj, 6) AS rough_information FROM e""", "supplier")
def fuzzy_information(df):
    return rounded(G.fuzzy_information_by_class(by_class(df)))


MERIT = "least(1, (SELECT avg(m) FROM (SELECT x, min(least(1, 1 - {s} + dec)) AS m FROM t GROUP BY 1)) / (SELECT avg(m) FROM (SELECT x, min(least(1, 1 - greatest(s1 + s2 - 1, 0) + dec)) AS m FROM t GROUP BY 1)))"


@query("""WITH r AS (SELECT max(s_acctbal) - min(s_acctbal) AS r, max(s_suppkey) - min(s_suppkey) AS q FROM supplier), rows_ AS (SELECT s_suppkey, s_acctbal, (s_nationkey % 4)::VARCHAR AS c FROM supplier),
t AS (SELECT a.s_suppkey AS x, greatest(0, 1 - abs(a.s_acctbal - b.s_acctbal) / r) AS s1, greatest(0, 1 - abs(a.s_suppkey - b.s_suppkey) / q) AS s2, (a.c = b.c)::INT::DOUBLE AS dec FROM rows_ a, rows_ b, r)
SELECT 's_acctbal' AS attributes, round(""" + MERIT.format(s="s1") + ", 6) AS merit UNION ALL SELECT 's_suppkey', round(" + MERIT.format(s="s2") + ", 6) UNION ALL SELECT 's_acctbal,s_suppkey', 1.0", "supplier")
def fuzzy_rough_merits(df):
    names = ["s_acctbal", "s_suppkey"]
    merit = G.dependency_merit(df.select("s_suppkey", "s_acctbal", (F.col("s_nationkey") % 4).cast("string").alias("c")), names, "c")
    rows = [(",".join(s), round(merit(frozenset(s)), 6)) for s in (names[:1], names[1:], names)]
    return df.sparkSession.createDataFrame(rows, "attributes string, merit double")


@query("""WITH s AS (SELECT max(c_acctbal) - min(c_acctbal) AS r, max(c_nationkey) - min(c_nationkey) AS q, count(*)::DOUBLE AS n FROM customer), a AS (SELECT * FROM customer),
m AS (SELECT a.c_custkey AS x, a.c_mktsegment AS xc, b.c_mktsegment AS c, b.c_custkey AS k, abs(a.c_acctbal - b.c_acctbal) / r AS d1, abs(a.c_nationkey - b.c_nationkey)::DOUBLE / q AS d2 FROM a JOIN customer b ON a.c_custkey <> b.c_custkey, s),
k AS (SELECT x, xc, c, avg(d1) AS d1, avg(d2) AS d2 FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY x, c ORDER BY d1 + d2, k) <= 5) GROUP BY 1, 2, 3),
p AS (SELECT c_mktsegment AS c, count(*) / (SELECT n FROM s) AS p FROM customer GROUP BY 1),
w AS (SELECT d1, d2, CASE WHEN k.c = xc THEN -1 ELSE p.p / (1 - o.p) END AS w FROM k JOIN p ON p.c = k.c JOIN p o ON o.c = k.xc)
SELECT 'c_acctbal' AS attribute, round(sum(w * d1) / (SELECT count(*) FROM a), 6) AS weight FROM w UNION ALL SELECT 'c_nationkey', round(sum(w * d2) / (SELECT count(*) FROM a), 6) FROM w""", "customer")
def relief_scores(df):
    return rounded(G.relief_scores(df, "c_custkey", ["c_acctbal", "c_nationkey"], "c_mktsegment", k=5))


@query(RESULTS + """, d AS (SELECT a.dataset, a.scheme, b.scheme AS other, avg(a.value - b.value) / nullif(stddev_samp(a.value - b.value) * sqrt(1.0 / count(*) + 0.1), 0) AS t FROM r a JOIN r b USING (dataset, run, fold) WHERE a.scheme <> b.scheme GROUP BY 1, 2, 3)
SELECT scheme, other, count(*) FILTER (WHERE t > 1.96) AS wins, count(*) FILTER (WHERE t < -1.96) AS losses, count(*) FILTER (WHERE t > 1.96) - count(*) FILTER (WHERE t < -1.96) AS difference FROM d GROUP BY 1, 2""", "orders")
def win_loss(df):
    r = results(df)
    tests = None
    for base in ("F", "O", "P"):
        one = X.paired(r, base, "value", ratio=0.1).select("dataset", F.lit(base).alias("scheme"), F.col("scheme").alias("other"), "t")
        tests = one if tests is None else tests.union(one)
    return X.win_loss(tests)


@query("""WITH t AS (SELECT n_nationkey, (n_nationkey + 1) * (n_nationkey + 1) / 2000.0 AS p FROM nation), s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p AS step FROM t)
SELECT n_nationkey, round(least(1, max(step) OVER (ORDER BY p)), 6)::DOUBLE AS adjusted FROM s""", "nation")
def holm_adjusted(df):
    tests = df.select("n_nationkey", ((F.col("n_nationkey") + 1) * (F.col("n_nationkey") + 1) / F.lit(2000.0)).alias("p"))
    return rounded(X.holm(tests, "p").select("n_nationkey", "adjusted"))


@query("""WITH n AS (SELECT *, (greatest(0, 1 - abs(s_acctbal - q_a) / r) + greatest(0, 1 - abs(s_suppkey - query) / q)) / 2 AS sim FROM (SELECT a.s_suppkey AS query, a.s_acctbal AS q_a, b.* FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey),
(SELECT max(s_acctbal) - min(s_acctbal) AS r, max(s_suppkey) - min(s_suppkey) AS q FROM supplier) QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, s_suppkey) <= 5),
w AS (SELECT query, s_nationkey, sim / max(sim) OVER (PARTITION BY query) AS w FROM n), c AS (SELECT DISTINCT query, s_nationkey AS class FROM n),
v AS (SELECT query, class, sum(least(w, (s_nationkey = class)::INT)) / sum(w) AS r FROM w JOIN c USING (query) GROUP BY 1, 2)
SELECT query, class, round(((CASE WHEN r <= 0.1 THEN 0 WHEN r <= 0.35 THEN 2 * pow((r - 0.1) / 0.5, 2) WHEN r <= 0.6 THEN 1 - 2 * pow((r - 0.6) / 0.5, 2) ELSE 1 END) + """ + "(" + QUANTIFIER.format(x="r") + ")) / 2, 6) AS score FROM v", "supplier")
def vague_quantifier_neighbours(df):
    from ..operators import neighbours as N

    return rounded(N.vague_quantifier_nn(N.nearest(df, df, "s_suppkey", ["s_acctbal", "s_suppkey"], "s_nationkey", 5), "s_nationkey"))


SQL["vague_quantifier_nn"] = SQL["vague_quantifier_neighbours"]


@query(f"SELECT {LINE}, (l_quantity > 17)::INT + (l_quantity > 35)::INT AS l_quantity FROM lineitem", "lineitem")
def discretize_mdl(df):
    known = df.withColumn("kind", F.when((F.col("l_quantity") > 17) & (F.col("l_quantity") <= 35), "middle").otherwise("outside"))
    return V.fit_discretize(known, ["l_quantity"], "kind").transform(known).select(*KEYS, "l_quantity")


SOME = "(CASE WHEN {x} <= 0.1 THEN 0 WHEN {x} <= 0.35 THEN 2 * pow(({x} - 0.1) / 0.5, 2) WHEN {x} <= 0.6 THEN 1 - 2 * pow(({x} - 0.6) / 0.5, 2) ELSE 1 END)"
LOWER = """WITH g AS (SELECT (max(s_acctbal) - min(s_acctbal))::DOUBLE AS r, (max(s_suppkey) - min(s_suppkey))::DOUBLE AS q FROM supplier), t AS (SELECT *, {label} AS kind FROM supplier),
l AS (SELECT a.s_suppkey, any_value(a.kind) AS kind, 1 - greatest(0, coalesce(max(1 - abs(a.s_acctbal - b.s_acctbal) / r - abs(a.s_suppkey - b.s_suppkey) / q), 0)) AS lower
FROM t a LEFT JOIN t b ON a.kind <> b.kind, g GROUP BY 1)"""
KIND = "CASE WHEN s_nationkey < 8 THEN 'few' ELSE 'many' END"


def kinds(df):
    return df.select("s_suppkey", "s_acctbal", F.expr(KIND).alias("kind"))


@query(LOWER.format(label="s_nationkey") + " SELECT s_suppkey, round(lower, 6) AS lower FROM l", "supplier")
def lower_memberships(df):
    return rounded(I.with_lower(df, ["s_acctbal", "s_suppkey"], "s_nationkey").select("s_suppkey", "lower"))


@query(LOWER.format(label=KIND) + """, k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(lower * 1e9), md5(s_suppkey::VARCHAR)) AS no FROM l)
SELECT s_suppkey, kind FROM k WHERE kind = 'few' OR no <= (SELECT count(*) FROM l WHERE kind = 'few')""", "supplier")
def undersample_safest(df):
    return I.undersample_safest(kinds(df), "s_suppkey", ["s_acctbal", "s_suppkey"], "kind", "many").select("s_suppkey", "kind")


@query(LOWER.format(label=KIND) + " SELECT s_suppkey, kind, round(lower, 6) AS lower FROM l WHERE kind = 'few' OR lower < 0.05", "supplier")
def keep_boundary(df):
    return rounded(I.keep_boundary(kinds(df), ["s_acctbal", "s_suppkey"], "kind", "many", 0.05).select("s_suppkey", "kind", "lower"))


@query("""WITH k AS (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0), g AS (SELECT max(s_nationkey) - min(s_nationkey) AS r, max(s_suppkey) - min(s_suppkey) AS q FROM k),
p AS (SELECT a.s_suppkey AS query, b.s_suppkey, b.s_acctbal, (greatest(0, 1 - abs(a.s_nationkey - b.s_nationkey) / r) + greatest(0, 1 - abs(a.s_suppkey - b.s_suppkey) / q)) / 2 AS sim FROM supplier a JOIN k b ON a.s_suppkey % 7 = 0, g),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, s_suppkey) <= 5)
SELECT s_suppkey, s_acctbal::DOUBLE AS s_acctbal FROM k UNION ALL SELECT query, round(sum(sim * s_acctbal) / sum(sim), 4) FROM n GROUP BY 1""", "supplier")
def impute_by_neighbours(df):
    holes = df.select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    return rounded(I.impute(holes, "s_suppkey", ["s_nationkey", "s_suppkey"], "s_acctbal").select("s_suppkey", "s_acctbal"), 4)


VOTES = NEAR + """, v AS (SELECT query, s_nationkey AS class FROM n GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY sum(sim) DESC, s_nationkey) = 1)
SELECT s_suppkey, {columns} FROM supplier JOIN v ON query = s_suppkey"""


@query(VOTES.format(columns="class AS classification, (class <> s_nationkey)::INT AS error"), "supplier")
def add_classification(df):
    return I.add_classification(df, "s_suppkey", ["s_acctbal", "s_suppkey"], "s_nationkey").select("s_suppkey", "classification", "error")


@query(VOTES.format(columns="s_nationkey") + " WHERE class = s_nationkey", "supplier")
def remove_misclassified(df):
    return I.remove_misclassified(df, "s_suppkey", ["s_acctbal", "s_suppkey"], "s_nationkey").select("s_suppkey", "s_nationkey")


@query(NEAR + """, w AS (SELECT query, s_nationkey, sim / max(sim) OVER (PARTITION BY query) AS w FROM n), c AS (SELECT DISTINCT query, s_nationkey AS class FROM n),
x AS (SELECT query, class, greatest(1 - w, (s_nationkey = class)::INT) AS i, least(w, (s_nationkey = class)::INT) AS t FROM w JOIN c USING (query)),
o AS (SELECT *, count(*) OVER (PARTITION BY query, class) AS n, row_number() OVER (PARTITION BY query, class ORDER BY i DESC) AS a, row_number() OVER (PARTITION BY query, class ORDER BY t DESC) AS b FROM x)
SELECT query, class, round((sum(i * (""" + QUANTIFIER.format(x="(a / n)") + " - " + QUANTIFIER.format(x="((a - 1) / n)") + ")) + sum(t * (" + SOME.format(x="(b / n)") + " - " + SOME.format(x="((b - 1) / n)") + "))) / 2, 6) AS score FROM o GROUP BY 1, 2", "supplier")
def owa_neighbours(df):
    from ..operators import neighbours as N

    return rounded(N.owa_nn(N.nearest(df, df, "s_suppkey", ["s_acctbal", "s_suppkey"], "s_nationkey", 5), "s_nationkey"))
