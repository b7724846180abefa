"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws a hash of (document id, child's path) as an
exponential waiting time at the rate of the weight below it, and the shortest wait wins: a child is taken in proportion
to its weight, and no draw depends on another child. A change of weights so moves documents only into or out of the
subtrees whose weights change.

A shard that joined an old rack would raise the weights of the rack and its region too, and documents that these draw
from elsewhere could fall on the rack's older shards. So ``grow`` opens a region of its own for each new shard: it takes
documents only into itself, in proportion to its weight.

The law is ``key``: the id and the tree decide, whatever the text. Rows without an id go by one key, so to one shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
#: Hex digits of the row's digest that split the rows of one shard when they are numbered: 4096 cells.
CELL_DIGITS = 3
#: A map task's rows of one document and text are counted in runs of this many bits of the row's number.
RUN_BITS = 16


def layout(shards: int = 16, regions: int = 2, racks: int = 2) -> Tree:
    """``shards`` shards of weight 1, dealt out evenly in order over ``regions`` regions of ``racks`` racks."""
    tree: Tree = {}
    for s in range(shards):
        place = s * regions * racks // shards
        tree.setdefault(f"region{place // racks}", {}).setdefault(f"rack{place % racks}", {})[s] = 1.0
    return tree


def grow(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """``tree`` with one more shard, in a region of its own."""
    if any(shard in leaves for racks in tree.values() for leaves in racks.values()):
        raise ValueError(f"shard {shard} is there already")
    return tree | {f"region{len(tree)}": {"rack0": {shard: weight}}}


def _wait(path: Column, weight: float) -> Column:
    """A waiting time that the path's digest draws; 52 bits, so that the number is exact as a double."""
    u = (F.conv(F.substring(F.md5(path), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
    return -F.ln(u) / F.lit(float(weight))


def _draw(key: Column, path: str, children: dict) -> Column:
    """The child of the shortest wait (of equal waits the first by name), among those of a positive weight."""
    names = sorted(c for c, w in children.items() if w > 0)
    if len(names) < 2:
        return F.lit(names[0] if names else None)
    return F.array_min(F.array(*[F.struct(_wait(F.concat(key, F.lit(f"{path}/{c}")), children[c]).alias("w"), F.lit(c).alias("c")) for c in names]))["c"]


def _chosen(values: list, then: list[Column], by: list[Column]) -> Column:
    """``then[i]`` where ``by`` equal ``values[i]``."""
    cases = [(reduce(lambda a, b: a & b, [c == F.lit(x) for c, x in zip(by, v)]), t) for v, t in zip(values, then)]
    return reduce(lambda out, case: F.when(case[0], case[1]) if out is None else out.when(case[0], case[1]), cases, None)


def descended(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """``df`` with ``{prefix}region``, ``{prefix}rack`` and ``{prefix}shard``, the leaf to which the string ``key`` descends."""
    region, rack, shard = (f"{prefix}{c}" for c in ("region", "rack", "shard"))
    below = {r: {k: sum(w for w in leaves.values() if w > 0) for k, leaves in racks.items()} for r, racks in tree.items()}
    if not any(w > 0 for racks in below.values() for w in racks.values()):
        raise ValueError("the tree has no shard of a positive weight")
    df = df.withColumn(region, _draw(key, "", {r: sum(racks.values()) for r, racks in below.items()}))
    df = df.withColumn(rack, _chosen([(r,) for r in tree], [_draw(key, f"/{r}", below[r]) for r in tree], [F.col(region)]))
    racks = [(r, k) for r in tree for k in tree[r]]
    leaf = _chosen(racks, [_draw(key, f"/{r}/{k}", tree[r][k]).cast("int") for r, k in racks], [F.col(region), F.col(rack)])
    # never null, and said so: else a join by shard would draw anew below the exchange to filter nulls
    return df.withColumn(shard, F.coalesce(leaf, F.lit(-1)))


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def shard_documents(docs: DataFrame, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard) for each row of ``docs`` (doc_id, text).

    ``size`` is the text's bytes plus 1 (null: 1) and ``text_crc32`` its checksum (null: that of an empty text);
    ``grown_shard`` is the shard in ``grown``, by default the tree with one more. ``slot`` numbers the rows of a shard
    from 0 without gaps, in the order of a digest of id, checksum and size. Rows that agree in all three can't be told
    apart in the result: they are counted by map task and each count is spread out again, so that no task ever sorts or
    holds a document's or a shard's rows as a whole. Null ids are one key; an empty table gives no rows; other columns
    are ignored.
    """
    tree = tree or layout()
    grown = grown or grow(tree, 1 + max(s for racks in tree.values() for leaves in racks.values() for s in leaves))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftright(F.monotonically_increasing_id(), RUN_BITS).alias("_run"))
    counted = rows.groupBy("doc_id", "size", "text_crc32", "_run").agg(F.count(F.lit(1)).alias("_n"))
    placed = descended(descended(counted, _key(), tree), _key(), grown, "_grown_")
    placed = placed.withColumn("_digest", F.md5(F.concat_ws("|", _key(), "text_crc32", "size"))).withColumn("_cell", F.substring("_digest", 1, CELL_DIGITS))
    cells = placed.groupBy("shard", "_cell").agg(F.sum("_n").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("_m")
    cells = cells.select("shard", "_cell", before.alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("shard", "_cell").orderBy("_digest", "doc_id", "text_crc32", "size", "_run")) - F.col("_n")
    first = (F.col("_before") + F.col("_in_cell")).cast("long")
    return (
        placed.withColumn("_in_cell", inside)
        .join(cells, ["shard", "_cell"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"), F.col("_grown_shard").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, tree: Tree | None = None, files: int = 1) -> None:
    """``docs`` itself as Parquet, one folder a shard (``_shard=0`` and so on) with about ``files`` files each."""
    part = F.pmod(F.xxhash64(*docs.columns), F.lit(files))
    dealt = descended(docs, _key(), tree or layout(), "_").withColumn("_part", part).repartition("_shard", "_part")
    dealt.drop("_region", "_rack", "_part").write.partitionBy("_shard").parquet(path)


def _sql() -> str:
    def wait(path: str, weight: int) -> str:
        return f"-ln((('0x' || substr(md5(k || {path}), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496) / {weight}"

    return f"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i))
), bytes AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), sums AS (
  SELECT doc_id, k, size, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range((size - 1)::BIGINT), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c // 256, tab[1 + xor(c % 256, b)]))) AS text_crc32
  FROM bytes, tab
), regions AS (
  SELECT *, {wait("'/region2'", 1)} AS w2, list_min([{{'w': {wait("'/region0'", 8)}, 'c': 0}}, {{'w': {wait("'/region1'", 8)}, 'c': 1}}]) AS r FROM sums
), racks AS (
  SELECT *, list_min(list_transform([0, 1], lambda i: {{'w': {wait("'/region' || r.c || '/rack' || i", 4)}, 'c': i}})).c AS rack FROM regions
), shards AS (
  SELECT *, list_min(list_transform(range(8 * r.c + 4 * rack, 8 * r.c + 4 * rack + 4), lambda i: {{'w': {wait("'/region' || r.c || '/rack' || rack || '/' || i", 1)}, 'c': i}})).c::INT AS shard FROM racks
)
SELECT doc_id, size, text_crc32, 'key' AS law, 'region' || r.c AS region, 'rack' || rack AS rack, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k || '|' || text_crc32 || '|' || size), doc_id) - 1 AS slot,
  CASE WHEN w2 < r.w THEN 16 ELSE shard END::INT AS grown_shard
FROM shards
"""


SQL = _sql()


def query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
