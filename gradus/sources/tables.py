"""Reading and writing tables: files by extension, templated test files, JDBC, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "orc": "orc", "txt": "text"}


def read_table(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """A file or folder by its extension; NaN becomes null."""
    kind = FORMATS[path.rstrip("/").rsplit(".", 1)[-1]]
    reader = spark.read.format(kind).options(**({"header": True, "nullValue": "?"} if kind == "csv" else {}), **options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_test_set(spark: SparkSession, folder: str, name: str, prefix: str = "", suffix: str = "_test.parquet") -> DataFrame:
    return read_table(spark, f"{folder}/{prefix}{name}{suffix}")


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Quoted CSV with ``?`` for null."""
    df.write.mode("overwrite").option("nullValue", "?").option("header", True).option("quoteAll", True).option("compression", compression).csv(path)


def missing_keys(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` that have no stored result yet."""
    return wanted.join(stored.select(*keys), keys, "left_anti")


def point_read(stored: DataFrame, key: dict, column: str):
    """The value of a column in the row of a key; LookupError unless there is exactly one such row."""
    wanted = stored
    for name, value in key.items():
        wanted = wanted.where(F.col(name).eqNullSafe(F.lit(value)))
    rows = wanted.select(column).head(2)
    if len(rows) != 1:
        raise LookupError(f"{'no row' if not rows else 'several rows'} of {key}")
    return rows[0][0]
