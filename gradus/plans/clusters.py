"""Queries of cluster memberships, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import densities as D
from ..operators import instances as I
from ..operators import partitions as T
from .queries import query, rounded

COLUMNS = ["c_acctbal", "c_nationkey"]
GAUSS = "CASE WHEN {x} IS NULL THEN 0 ELSE -0.5 * pow(({x} - {m}) / {s}, 2) - ln({s}) - 0.5 * ln(2 * pi()) END"


@query(f"""WITH t AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS x, c_nationkey AS y FROM customer),
p AS (SELECT c_mktsegment AS c, count(*) / (SELECT count(*) FROM t)::DOUBLE AS prior, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM t GROUP BY 1),
d AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c) - 1 AS i, ln(prior) + {GAUSS.format(x="x", m="mx", s="sx")} + {GAUSS.format(x="y", m="my", s="sy")} AS l FROM t, p),
s AS (SELECT c_custkey, i, exp(l - max(l) OVER (PARTITION BY c_custkey)) AS e FROM d), n AS (SELECT c_custkey, i, e / sum(e) OVER (PARTITION BY c_custkey) AS p FROM s)
SELECT c_custkey, """ + ", ".join(f'round(max(p) FILTER (WHERE i = {i}), 6) AS "pCluster_{i}_0"' for i in range(5)) + " FROM n GROUP BY 1", "customer")
def cluster_membership(df):
    rows = df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    return rounded(D.cluster_membership(rows, COLUMNS, D.fit_mixtures(rows, COLUMNS, "c_mktsegment"), ["c_custkey"]))


#: Two rounds from the start that ``densities`` states, for one class of two clusters over one column.
_SHARE = "exp({w}l{i} - greatest({w}l0, {w}l1)) / (exp({w}l0 - greatest({w}l0, {w}l1)) + exp({w}l1 - greatest({w}l0, {w}l1)))"


def _round(of: str) -> str:
    logs = ", ".join(f"ln(w{i}) - 0.5 * pow((x - m{i}) / s{i}, 2) - ln(s{i}) AS l{i}" for i in (0, 1))
    shares = ", ".join(_SHARE.format(w="", i=i) + f" AS r{i}" for i in (0, 1))
    sums = ", ".join(f"avg(r{i}) AS w{i}, sum(r{i} * x) / sum(r{i}) AS m{i}, sqrt(sum(r{i} * pow(x - any_m{i}, 2)) / sum(r{i}) - pow(sum(r{i} * (x - any_m{i})) / sum(r{i}), 2)) AS s{i}" for i in (0, 1))
    return f"(SELECT {sums} FROM (SELECT x, m0 AS any_m0, m1 AS any_m1, {shares} FROM (SELECT *, {logs} FROM t, {of})))"


@query(f"""WITH t AS (SELECT c_custkey, c_acctbal + CASE WHEN c_nationkey < 9 THEN 12000 ELSE 0 END AS x FROM customer), a AS (SELECT 0.5 AS w0, avg(x) - 0.75 * stddev_pop(x) AS m0, stddev_pop(x) AS s0, 0.5 AS w1, avg(x) + 0.75 * stddev_pop(x) AS m1, stddev_pop(x) AS s1 FROM t),
b AS {_round("a")}, c AS {_round("b")}, l AS (SELECT c_custkey, ln(w0) - 0.5 * pow((x - m0) / s0, 2) - ln(s0) AS l0, ln(w1) - 0.5 * pow((x - m1) / s1, 2) - ln(s1) AS l1 FROM t, c)
SELECT c_custkey, round({_SHARE.format(w="", i=0)}, 5) AS "pCluster_0_0", round({_SHARE.format(w="", i=1)}, 5) AS "pCluster_0_1" FROM l""", "customer")
def mixture_membership(df):
    rows = df.select("c_custkey", (F.col("c_acctbal") + F.when(F.col("c_nationkey") < 9, 12000).otherwise(0)).alias("x"))
    return rounded(D.cluster_membership(rows, ["x"], D.fit_mixtures(rows, ["x"], k=2, rounds=2), ["c_custkey"]), 5)


@query("SELECT s_suppkey, (s_nationkey < 12)::INT AS cluster FROM supplier", "supplier")
def add_cluster(df):
    """Two groups that lie far apart, numbered in the order of their least values."""
    far = df.select("s_suppkey", (F.col("s_acctbal") + F.when(F.col("s_nationkey") < 12, 10**6).otherwise(0)).alias("x"))
    found = I.add_cluster(far, ["x"])
    first = found.groupBy("cluster").agg(F.min("x").alias("_low"))
    high = first.agg(F.max("_low").alias("_high"))
    return found.join(first, "cluster").crossJoin(high).select("s_suppkey", ((F.col("_low") == F.col("_high")) & (F.col("_high") > 500_000)).cast("int").alias("cluster"))


@query("""SELECT o_orderkey, CASE WHEN known THEN (m <= 2)::INT END AS partition_0, CASE WHEN known THEN (m > 2 AND m <= 5)::INT END AS partition_1, CASE WHEN known THEN (m > 5)::INT END AS partition_2
FROM (SELECT o_orderkey, o_custkey % 8 AS m, o_orderkey % 9 <> 0 AS known FROM orders)""", "orders")
def partition_membership(df):
    rows = df.select("o_orderkey", (F.col("o_custkey") % 8).alias("m"))
    kind = F.when(F.col("m") <= 2, "a").when(F.col("m") <= 5, "b").otherwise("c")
    model = T.fit_partition(rows.withColumn("kind", kind), ["m"], "kind")
    holes = rows.withColumn("m", F.when(F.col("o_orderkey") % 9 != 0, F.col("m")))
    return T.partition_membership(holes, "o_orderkey", ["m"], model)
