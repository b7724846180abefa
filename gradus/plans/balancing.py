"""Queries of oversampling by memberships, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as D
from ..operators import oversampling as B
from ..operators import prototypes as P
from .queries import query, rounded

#: Customers of three unequal kinds, with two numbers and a label.
CUSTOMERS = "SELECT c_custkey, c_acctbal, (c_custkey * 7919 % 1000)::DOUBLE AS part, c_mktsegment, CASE WHEN c_nationkey < 5 THEN 'few' WHEN c_nationkey < 12 THEN 'mid' ELSE 'many' END AS kind FROM customer"
NUMERIC, NOMINAL = ["c_acctbal", "part"], ["c_mktsegment"]


def customers(df):
    kind = F.when(F.col("c_nationkey") < 5, "few").when(F.col("c_nationkey") < 12, "mid").otherwise("many")
    return df.select("c_custkey", "c_acctbal", (F.col("c_custkey") * 7919 % 1000).cast("double").alias("part"), "c_mktsegment", kind.alias("kind"))


def new_rows(df):
    return rounded(df.where("c_custkey is null").select("kind", *NUMERIC, *NOMINAL), 4)


def u(*parts: str) -> str:
    return f"('0x' || substr(md5('1|' || {' || chr(124) || '.join(parts)}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE"


def distance(a: str, b: str) -> str:
    return f"(abs({a}.x / rx - {b}.x / rx) + abs({a}.y / ry - {b}.y / ry) + ({a}.s <> {b}.s)::INT)"


TABLES = f"""WITH r AS (SELECT c_custkey::VARCHAR AS id, c_acctbal AS x, part AS y, c_mktsegment AS s, kind FROM ({CUSTOMERS})), g AS (SELECT max(x) - min(x) AS rx, max(y) - min(y) AS ry FROM r),
m AS (SELECT a.id, any_value(a.kind) AS kind, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.s) AS s, round(1 - greatest(0, max(1 - {distance("a", "b")})), 9) AS m FROM r a JOIN r b ON a.kind <> b.kind, g GROUP BY 1),
sizes AS (SELECT kind, count(*) AS n FROM r GROUP BY 1), large AS (SELECT kind, n FROM sizes ORDER BY n DESC, kind LIMIT 1),
slots AS (SELECT sizes.kind, unnest(range(1, (floor(large.n - sizes.n) + 1)::BIGINT)) AS slot FROM sizes, large WHERE sizes.kind <> large.kind),
w AS (SELECT *, greatest(1, total // count(*) OVER (PARTITION BY kind)) AS step FROM (SELECT *, sum(w) OVER (PARTITION BY kind ORDER BY md5(id)) - w AS before, sum(w) OVER (PARTITION BY kind) AS total FROM (SELECT *, round(m * 1048576)::BIGINT AS w FROM m)) WHERE w > 0)"""


@query(TABLES + " SELECT id AS c_custkey, kind, round(m, 6) AS membership FROM m", "customer")
def class_memberships(df):
    found = B.memberships(customers(df), "c_custkey", NUMERIC, "kind", NOMINAL)
    return rounded(found.select(F.col("id").alias("c_custkey"), F.col("class").alias("kind"), "membership"))


def box(average: bool) -> str:
    level = "avg" if average else "min"
    return TABLES + f""", box AS (SELECT kind, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round({level}(m), 9) AS level FROM m GROUP BY 1), labels AS (SELECT list(DISTINCT s ORDER BY s) AS labels FROM r),
t AS (SELECT kind, slot, i, level, x0 + {u("kind", "slot", "i", "0")} * (x1 - x0) AS x, y0 + {u("kind", "slot", "i", "1")} * (y1 - y0) AS y, labels[1 + floor({u("kind", "slot", "i", "2")} * len(labels))::INT] AS s FROM slots JOIN box USING (kind), range(1, 12) n(i), labels),
f AS (SELECT t.kind, t.slot, t.i, t.x, t.y, t.s FROM t JOIN r b ON t.kind <> b.kind, g GROUP BY ALL HAVING round(1 - greatest(0, max(1 - {distance("t", "b")})), 9) >= any_value(t.level))
SELECT kind, round(x, 4) AS c_acctbal, round(y, 4) AS part, s AS c_mktsegment FROM f QUALIFY row_number() OVER (PARTITION BY kind, slot ORDER BY i) = 1"""


@query(box(False), "customer")
def oversample_in_box(df):
    return new_rows(B.oversample_in_box(customers(df), "c_custkey", NUMERIC, "kind", NOMINAL))


@query(box(True), "customer")
def oversample_in_box_by_mean(df):
    return new_rows(B.oversample_in_box(customers(df), "c_custkey", NUMERIC, "kind", NOMINAL, average=True))


@query(TABLES + f""", one AS (SELECT slots.kind, slot, a.x, a.y, a.s, a.m, a.w, a.before, a.total FROM slots JOIN (SELECT kind, any_value(total) AS t FROM w GROUP BY 1) USING (kind) JOIN w a ON a.kind = slots.kind AND floor({u("slots.kind", "slot", "1")} * t) >= a.before AND floor({u("slots.kind", "slot", "1")} * t) < a.before + a.w),
placed AS (SELECT *, CASE WHEN q >= before THEN q + w ELSE q END AS place FROM (SELECT *, floor({u("kind", "slot", "2")} * (total - w)) AS q FROM one))
SELECT a.kind, round(a.x * (a.m / (a.m + b.m)) + b.x * (b.m / (a.m + b.m)), 4) AS c_acctbal, round(a.y * (a.m / (a.m + b.m)) + b.y * (b.m / (a.m + b.m)), 4) AS part, CASE WHEN a.m >= b.m THEN a.s ELSE b.s END AS c_mktsegment
FROM placed a JOIN w b ON b.kind = a.kind AND place >= b.before AND place < b.before + b.w""", "customer")
def oversample_by_pairs(df):
    return new_rows(B.oversample_by_pairs(customers(df), "c_custkey", NUMERIC, "kind", NOMINAL))


@query(TABLES + f""", small AS (SELECT kind, n FROM sizes ORDER BY n, kind LIMIT 1), p AS (SELECT * FROM w WHERE kind = (SELECT kind FROM small)),
near AS (SELECT a.id, b.id AS other, b.x, b.y, b.s, row_number() OVER (PARTITION BY a.id ORDER BY round({distance("a", "b")}, 9), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id, g QUALIFY rank <= 5),
votes AS (SELECT id, s, count(*) AS n FROM (SELECT id, s FROM near UNION ALL SELECT id, s FROM p) GROUP BY 1, 2), label AS (SELECT id, s FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, s) = 1),
new AS (SELECT kind, unnest(range(1, (floor(1.5 * n + 0.5) + 1)::BIGINT)) AS slot FROM small),
one AS (SELECT new.kind, slot, a.id, a.x, a.y, 1 + floor({u("new.kind", "slot", "2")} * (SELECT count(*) FROM near WHERE near.id = a.id)) AS rank, {u("new.kind", "slot", "3")} AS share
  FROM new JOIN p a ON floor({u("new.kind", "slot", "1")} * a.total) >= a.before AND floor({u("new.kind", "slot", "1")} * a.total) < a.before + a.w)
SELECT kind, round(one.x + share * (near.x - one.x), 4) AS c_acctbal, round(one.y + share * (near.y - one.y), 4) AS part, label.s AS c_mktsegment FROM one JOIN near ON near.id = one.id AND near.rank = one.rank JOIN label ON label.id = one.id""", "customer")
def graded_smote(df):
    return new_rows(B.graded_smote(customers(df), "c_custkey", NUMERIC, "kind", NOMINAL, percent=150))


SUPPLIERS = "SELECT s_suppkey, s_acctbal, (s_suppkey * 7919 % 100)::DOUBLE AS part, CASE WHEN s_acctbal + (s_suppkey * 7919 % 100) * 40 < 5000 THEN 'low' ELSE 'high' END AS kind FROM supplier"


def kept(kind: str, threshold: float) -> str:
    cover = "round(sim, 9) >= round(1 - b.m, 9)" if threshold < 0 else f"round(sim, 9) > {threshold}"
    m = "1 - near" if kind == "standard" else "(1 - near + friend) / 2"
    return f"""WITH RECURSIVE r AS (SELECT s_suppkey::VARCHAR AS id, s_acctbal AS x, part AS y, kind FROM ({SUPPLIERS})), g AS (SELECT max(x) - min(x) AS rx, max(y) - min(y) AS ry FROM r),
pairs AS (SELECT a.id, b.id AS other, a.kind = b.kind AS same, greatest(0, 1 - abs(a.x / rx - b.x / rx) - abs(a.y / ry - b.y / ry)) AS sim FROM r a JOIN r b ON a.id <> b.id, g),
m AS (SELECT id, round({m}, 9) AS m FROM (SELECT id, coalesce(max(sim) FILTER (WHERE NOT same), 0) AS near, coalesce(max(sim) FILTER (WHERE same), 0) AS friend FROM pairs GROUP BY 1)),
o AS (SELECT id, m, row_number() OVER (ORDER BY m DESC, id) AS no FROM m),
c AS (SELECT b.no, coalesce(list(a.no) FILTER (WHERE a.no < b.no AND same AND {cover}), []) AS by_ FROM o b LEFT JOIN pairs p ON p.id = b.id LEFT JOIN o a ON a.id = p.other GROUP BY 1),
walk AS (SELECT 0::BIGINT AS no, []::BIGINT[] AS kept UNION ALL SELECT c.no, CASE WHEN len(list_intersect(by_, kept)) = 0 THEN list_append(kept, c.no) ELSE kept END FROM walk JOIN c ON c.no = walk.no + 1)
SELECT s_suppkey, kind FROM ({SUPPLIERS}) s JOIN o ON o.id = s.s_suppkey::VARCHAR WHERE list_contains((SELECT kept FROM walk ORDER BY no DESC LIMIT 1), o.no)"""


def suppliers(df):
    part = (F.col("s_suppkey") * 7919 % 100).cast("double")
    return df.select("s_suppkey", "s_acctbal", part.alias("part"), F.when(F.col("s_acctbal") + part * 40 < 5000, "low").otherwise("high").alias("kind"))


@query(kept("standard", -1), "supplier")
def keep_prototypes(df):
    return P.prototypes(suppliers(df), "s_suppkey", ["s_acctbal", "part"], "kind").select("s_suppkey", "kind")


@query(kept("combined", 0.8), "supplier")
def keep_combined_prototypes(df):
    return P.prototypes(suppliers(df), "s_suppkey", ["s_acctbal", "part"], "kind", kind="combined", threshold=0.8).select("s_suppkey", "kind")


COUNTS = "SELECT c_custkey, c_nationkey::DOUBLE AS a, (c_custkey % 7)::DOUBLE AS b, (10 + c_custkey % 60)::DOUBLE AS d, c_mktsegment AS kind FROM customer"
COLUMNS = ["a", "b", "d"]


def counts(df):
    key = F.col("c_custkey")
    return df.select("c_custkey", F.col("c_nationkey").cast("double").alias("a"), (key % 7).cast("double").alias("b"), (10 + key % 60).cast("double").alias("d"), F.col("c_mktsegment").alias("kind"))


def drawn(df, kind: str):
    return rounded(D.resample_from_distributions(counts(df), COLUMNS, "kind", kind, 40, ["BUILDING", "MACHINERY"]).select("kind", *COLUMNS), 5)


def _normal(*parts: str) -> str:
    r, t = u(*parts, "'r'"), u(*parts, "'t'")
    return f"sqrt(-2 * ln(1 - {r})) * cos(2 * pi() * {t})"


def _poisson(mean: str, *parts: str) -> str:
    below = f"list_sum(list_transform(range(151), lambda k: CASE WHEN list_sum(list_transform(range(k + 1), lambda j: exp(j * ln({mean}) - {mean} - lgamma(j + 1)))) < {u(*parts)} THEN 1 ELSE 0 END))"
    return f"CASE WHEN {mean} < 30 THEN {below} ELSE greatest(0, floor({mean} + sqrt({mean}) * {_normal(*parts)} + 0.5)) END::DOUBLE"


FITTED = f"""WITH r AS ({COUNTS}), p AS (SELECT kind, count(*) AS n, """ + ", ".join(f"min({c}) AS low_{c}, max({c}) AS high_{c}, avg({c}) AS mean_{c}, stddev_samp({c}) AS sd_{c}, sum({c}) AS total_{c}" for c in COLUMNS) + " FROM r WHERE kind IN ('BUILDING', 'MACHINERY') GROUP BY 1), s AS (SELECT *, unnest(range(1, 41)) AS slot FROM p)"
REST = " UNION ALL SELECT kind, a, b, d FROM r WHERE kind NOT IN ('BUILDING', 'MACHINERY')"


def _drawn(of) -> str:
    return FITTED + " SELECT kind, " + ", ".join(f"round(greatest(0, {of(c, i)}), 5) AS {c}" for i, c in enumerate(COLUMNS)) + " FROM s" + REST


@query(_drawn(lambda c, i: f"low_{c} + {u('kind', 'slot', repr(str(i)))} * (high_{c} - low_{c})"), "customer")
def resample_uniform(df):
    return drawn(df, "uniform")


@query(_drawn(lambda c, i: f"mean_{c} + {_normal('kind', 'slot', repr(str(i)))} * sd_{c}"), "customer")
def resample_gaussian(df):
    return drawn(df, "gaussian")


@query(_drawn(lambda c, i: _poisson(f"mean_{c}", "kind", "slot", repr(str(i)))), "customer")
def resample_poisson(df):
    return drawn(df, "poisson")


@query(FITTED + f""", t AS (SELECT kind, slot, total_a / w AS x, (total_a + total_b) / w AS y, {_poisson("(w / n)", "kind", "slot", "'n'")} AS trials FROM (SELECT *, total_a + total_b + total_d AS w FROM s)),
e AS (SELECT kind, slot, (v >= x)::INT + (v >= y)::INT AS spot FROM (SELECT *, {u('kind', 'slot', 'k')} AS v FROM (SELECT *, unnest(range(1, trials::BIGINT + 1)) AS k FROM t)))
SELECT kind, count(*) FILTER (WHERE spot = 0)::DOUBLE AS a, count(*) FILTER (WHERE spot = 1)::DOUBLE AS b, count(*) FILTER (WHERE spot = 2)::DOUBLE AS d FROM (SELECT t.kind, t.slot, spot FROM t LEFT JOIN e USING (kind, slot)) GROUP BY kind, slot""" + REST, "customer")
def resample_multinomial(df):
    return drawn(df, "multinomial")
