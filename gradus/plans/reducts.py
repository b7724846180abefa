"""Queries of discernibility clauses, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clauses as L
from ..operators import grouping as P
from .queries import query, rounded

NUMERIC, NOMINAL = ["level", "size"], ["nation"]
PARTS = """SELECT floor(c_acctbal / 2500) AS level, (c_custkey % 5)::DOUBLE AS size, (c_nationkey % 3)::VARCHAR AS nation, c_mktsegment AS kind FROM customer"""
CLAUSES = f"""WITH RECURSIVE r AS (SELECT *, count(*) AS w FROM ({PARTS}) GROUP BY ALL), g AS (SELECT max(level) - min(level) AS a, max(size) - min(size) AS b FROM r),
c AS (SELECT round(abs(x.level / a - y.level / a), 9) AS d0, round(abs(x.size / b - y.size / b), 9) AS d1, (x.nation <> y.nation)::INT::DOUBLE AS d2, (sum(x.w * y.w) // 2)::BIGINT AS pairs FROM r x JOIN r y ON x.kind <> y.kind, g GROUP BY 1, 2, 3)"""


def parts(df):
    return df.select(F.floor(F.col("c_acctbal") / 2500).cast("double").alias("level"), (F.col("c_custkey") % 5).cast("double").alias("size"), (F.col("c_nationkey") % 3).cast("string").alias("nation"), F.col("c_mktsegment").alias("kind"))


@query(CLAUSES + " SELECT round(d0, 6) AS d0, round(d1, 6) AS d1, d2, pairs FROM c", "customer")
def discernibility_clauses(df):
    table = L.clauses(parts(df), NUMERIC, "kind", NOMINAL)
    return rounded(table.select(*[F.col("degrees")[i].alias(f"d{i}") for i in range(3)], "pairs"))


SUBSETS = [[0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]]
_SUM = lambda s: "least(1, " + " + ".join(f"d{i}" for i in s) + ")"
_MAX = lambda s: "greatest(0, " + ", ".join(f"d{i}" for i in s) + ")"


@query(CLAUSES + " UNION ALL ".join(f" SELECT '{','.join(map(str, s))}' AS columns, round(avg({_SUM(s)}), 6) AS mean, round(min({_MAX(s)}), 6) AS least FROM c" for s in SUBSETS), "customer")
def clause_merits(df):
    table = L.clauses(parts(df), NUMERIC, "kind", NOMINAL).persist()
    mean, least = L.clause_merits(table, SUBSETS), L.clause_merits(table, SUBSETS, "min", mean=False)
    table.unpersist()
    return rounded(df.sparkSession.createDataFrame([(",".join(map(str, s)), m, v) for s, m, v in zip(SUBSETS, mean, least)], "columns string, mean double, least double"))


@query(CLAUSES + """ SELECT round(d0, 6) AS d0, round(d1, 6) AS d1, d2, pairs FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.d0 <= c.d0 AND o.d1 <= c.d1 AND o.d2 <= c.d2 AND (o.d0 < c.d0 OR o.d1 < c.d1 OR o.d2 < c.d2)
AND round(least(1, o.d0 + o.d1 + o.d2), 9) >= round(least(1, c.d0 + c.d1 + c.d2), 9))""", "customer")
def least_clauses(df):
    table = L.least_clauses(L.clauses(parts(df), NUMERIC, "kind", NOMINAL))
    return rounded(table.select(*[F.col("degrees")[i].alias(f"d{i}") for i in range(3)], "pairs"))


@query(CLAUSES + """, walk AS (SELECT 0 AS place, []::INT[] AS chosen UNION ALL
SELECT place + 1, list_append(chosen, CASE WHEN a0 > 0 THEN 0 WHEN a1 > 0 THEN 1 WHEN a2 > 0 THEN 2 WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END) FROM (
  SELECT place, chosen, count(*) FILTER (WHERE one AND d0 > 0 AND NOT list_contains(chosen, 0)) AS a0, count(*) FILTER (WHERE one AND d1 > 0 AND NOT list_contains(chosen, 1)) AS a1, count(*) FILTER (WHERE one AND d2 > 0 AND NOT list_contains(chosen, 2)) AS a2,
  round(sum(CASE WHEN list_contains(chosen, 0) THEN -1 ELSE d0 END), 6) AS s0, round(sum(CASE WHEN list_contains(chosen, 1) THEN -1 ELSE d1 END), 6) AS s1, round(sum(CASE WHEN list_contains(chosen, 2) THEN -1 ELSE d2 END), 6) AS s2
  FROM (SELECT *, (d0 > 0)::INT + (d1 > 0)::INT + (d2 > 0)::INT = 1 AS one FROM walk, c
    WHERE round(least(1, CASE WHEN list_contains(chosen, 0) THEN d0 ELSE 0 END + CASE WHEN list_contains(chosen, 1) THEN d1 ELSE 0 END + CASE WHEN list_contains(chosen, 2) THEN d2 ELSE 0 END), 9) < round(least(1, d0 + d1 + d2), 9)) GROUP BY place, chosen))
SELECT place, ['level', 'size', 'nation'][1 + chosen[place]] AS attribute FROM walk WHERE place > 0""", "customer")
def greedy_reduct(df):
    table = L.clauses(parts(df), NUMERIC, "kind", NOMINAL).persist()
    chosen = L.greedy_reduct(table, 3)
    table.unpersist()
    return df.sparkSession.createDataFrame([(i + 1, [*NUMERIC, *NOMINAL][c]) for i, c in enumerate(chosen)], "place int, attribute string")


LINES = ["l_quantity", "l_extendedprice", "double", "noisy", "l_tax", "mixed"]
MADE = "SELECT l_quantity, l_extendedprice, 2 * l_quantity + 1 AS double, l_quantity + 40 * l_tax AS noisy, l_tax, l_discount * 100 + l_quantity AS mixed, l_quantity + 200 * l_discount AS y FROM lineitem"


def made(df):
    q, t, d = (F.col(f"l_{c}") for c in ("quantity", "tax", "discount"))
    return df.select("l_quantity", "l_extendedprice", (2 * q + 1).alias("double"), (q + 40 * t).alias("noisy"), "l_tax", (d * 100 + q).alias("mixed"), (q + 200 * d).alias("y"))


_PAIRS = [(a, b) for i, a in enumerate(LINES) for b in [*LINES, "y"][i + 1 :]]


@query(f"WITH RECURSIVE m AS ({MADE}), r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, least(1, abs(corr({a}, {b}))) AS r FROM m" for a, b in _PAIRS) + f"""),
pairs AS (SELECT a, b, r FROM r WHERE b <> 'y' UNION ALL SELECT b, a, r FROM r WHERE b <> 'y'), place AS (SELECT unnest({LINES}) AS a, unnest(range({len(LINES)})) AS i),
ranked AS (SELECT a, row_number() OVER (ORDER BY round(r, 9) DESC, i) AS no FROM r JOIN place USING (a) WHERE b = 'y'),
links AS (SELECT ranked.no, ranked.a, coalesce(list(pairs.b) FILTER (WHERE r >= 1 - 1e-9), []) AS same, coalesce(list(pairs.b) FILTER (WHERE r >= 0.7 AND r < 1 - 1e-9), []) AS near FROM ranked LEFT JOIN pairs ON pairs.a = ranked.a GROUP BY 1, 2),
walk AS (SELECT 0::BIGINT AS no, []::VARCHAR[] AS needless, NULL::VARCHAR AS a, []::VARCHAR[] AS members
UNION ALL SELECT links.no, CASE WHEN list_contains(needless, links.a) THEN needless ELSE list_distinct(list_concat(needless, same)) END, links.a, CASE WHEN list_contains(needless, links.a) THEN [] ELSE list_sort(list_append(list_filter(near, lambda x: NOT list_contains(needless, x)), links.a)) END FROM walk JOIN links ON links.no = walk.no + 1)
SELECT no AS place, a AS attribute, array_to_string(members, ',') AS members FROM walk WHERE no > 0""", "lineitem")
def correlation_groups(df):
    groups = P.correlation_groups(made(df), LINES, "y", threshold=0.7, cutoff=1 - 1e-9)
    rows = [(i + 1, a, ",".join(sorted(groups.members.get(a, ())))) for i, a in enumerate(groups.order)]
    return df.sparkSession.createDataFrame(rows, "place long, attribute string, members string")
