"""Mixing sources to target weights by systematic sampling.

Each document's expected copies (its source's target over its source's size) are summed up within the source, one
random offset is added, and the document is emitted once for each integer boundary that its step crosses.

The order inside a source is (size, digest of the id, id): neighbours in that order have like sizes, so the words
taken stay within about one document of the target. The running sum is taken on three levels, (source, size),
(source, size, digest prefix) and the rows of one such cell, so no task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, scratch, staged

WORD = "[^\\x20\\x09-\\x0D]+"
#: Hex digits of the id's digest that split rows of one source and size: 4096 cells.
CELL_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _offset(source: Column, seed: int) -> Column:
    """A fixed random number in [0, 1) for each source."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, take ``weights`` in turn and share all words by them; a target stops at ``most``
    times its size and the excess goes to the others by weight. The stop levels are found in closed form: in order of
    most * size / weight, the sources below the final level are the stopped ones.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("long")
    placed = sizes.withColumn("_place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("_w", w)
    level = Window.orderBy(F.lit(most) * F.col("source_size") / F.col("_w"), "_place")
    whole = Window.partitionBy()
    below = level.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        placed.withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_stopped", F.coalesce(F.lit(most) * F.sum("source_size").over(below), F.lit(0)))
        .withColumn("_free_w", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(below), F.lit(0)))
        # were all from here on free, each would get this much for each unit of weight
        .withColumn("_share", (F.col("_total") - F.col("_stopped")).cast("double") / F.col("_free_w"))
        .withColumn("_fits", F.col("_share") * F.col("_w") <= F.lit(most) * F.col("source_size"))
        .withColumn("_level", F.min(F.when(F.col("_fits"), F.struct(F.lit(most) * F.col("source_size") / F.col("_w"), "_place", "_share"))).over(whole)["_share"])
    )
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    return out.select("source", "source_size", F.least(cap, F.coalesce(F.col("_level") * F.col("_w"), cap)).alias("target"))


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of ``docs`` (doc_id, text, source).

    Null texts have size 0; null sources are one source; repeated rows count each; an empty table gives no rows; a
    source without words has target 0 and no copies. Other columns are ignored.
    """
    return _copies(docs, weights, most, seed).drop("_row")


def _copies(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """``mix_copies`` with the number of the row in ``_row``, which ``docs`` may have."""
    row = F.col("_row") if "_row" in docs.columns else F.lit(None).cast("long").alias("_row")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = staged(docs.select(row, "doc_id", "source", key.alias("_key"), word_count(F.col("text")).alias("size")))
    base = base.withColumn("_digest", digest).withColumn("_cell", F.substring("_digest", 1, CELL_DIGITS))
    cells = base.groupBy("_key", "size", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.first("source").alias("source"))
    cells = cells.withColumn("_in_size", F.sum("_n").over(Window.partitionBy("_key", "size").orderBy("_cell")) - F.col("_n"))
    bysize = cells.groupBy("_key", "size").agg(F.sum("_n").alias("_m"), F.first("source").alias("source"))
    running = Window.partitionBy("_key").orderBy("size")
    bysize = bysize.withColumn("_in_source", F.sum("_m").over(running) - F.col("_m"))
    targets = source_targets(bysize.groupBy("source").agg(F.sum(F.col("size") * F.col("_m")).alias("source_size")), weights, most)
    targets = targets.withColumn("_key", key).withColumn("_u", _offset(F.col("source"), seed)).drop("source")
    placed = cells.drop("source").join(bysize.select("_key", "size", "_in_source").join(targets, "_key"), ["_key", "size"])
    rank = F.row_number().over(Window.partitionBy("_key", "size", "_cell").orderBy("_digest", "doc_id", "_row")) + F.col("_in_size") + F.col("_in_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(rank * rate + F.col("_u")) - F.floor((rank - 1) * rate + F.col("_u"))
    return (
        base.select("_row", "doc_id", "_key", "size", "_cell", "_digest")
        .join(placed, ["_key", "size", "_cell"])
        .withColumn("copies", F.least(crossed, F.lit(most).cast("long")))
        .select("_row", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, numbered by ``copy``.

    Ids may be null or repeat: rows are told apart by number. A column ``copy`` of ``docs`` is replaced; no other column
    is touched, ``_row`` and ``_times`` must not be any. Rows of size 0 are taken at their source's rate like others.
    """
    with scratch(docs.sparkSession) as keep:
        rows = numbered(docs)
        copies = staged(_copies(rows, weights, most, seed).where("copies > 0").select("_row", F.col("copies").cast("int").alias("_times")))
        keep(rows)
        keep(copies)
    rest = [c for c in docs.columns if c != "copy"]
    return rows.join(copies.hint("shuffle_hash"), "_row").select(*rest, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy"))


SQL = """
WITH base AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM sizes
), levels AS (
  SELECT *, sum(source_size) OVER () AS total, 3 * source_size / w AS ratio,
    coalesce(3 * sum(source_size) OVER below, 0) AS stopped, sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS free_w
  FROM placed WINDOW below AS (ORDER BY 3 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT *, (total - stopped)::DOUBLE / free_w AS share FROM levels
), targets AS (
  SELECT source, coalesce('s' || source, 'n') AS k, source_size,
    least(3.0::DOUBLE * source_size, coalesce((SELECT share FROM shares s WHERE s.share * s.w <= 3 * s.source_size ORDER BY s.ratio, s.place LIMIT 1) * w, 3.0::DOUBLE * source_size))::DOUBLE AS target,
    (('0x' || substr(md5('7|' || coalesce('s' || source, 'n')), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM shares
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) AS r FROM base
), steps AS (
  SELECT doc_id, size, source_size, target, r, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END::DOUBLE AS rate FROM ranked JOIN targets USING (k)
), copied AS (
  SELECT *, least(3, floor(r * rate + u) - floor((r - 1) * rate + u))::BIGINT AS copies FROM steps
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM copied
"""


def query(spark, sf_dir: str) -> DataFrame:
    return mix_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
