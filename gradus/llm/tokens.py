"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; running and suffix sums over the histogram answer totals, quantiles and
truncated totals for every context limit without another look at a text.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's owner splits a text before merging (a fixed value of that tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths summed in one window partition.
SPAN = 4096


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, length): the tokens of each whole text, null 0. Special tokens' strings are ordinary text."""

    def count(batches):
        import pyarrow as pa

        encoding = _encoding(vocabulary)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(text)) if text else 0 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "length"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs) of (.., length)."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def context_report(histogram: DataFrame) -> DataFrame:
    """One row for each encoded length that occurs, taken as a context limit.

    n_docs have exactly that length; docs_within and tokens_within are at most that long; docs_over are longer;
    tokens_truncated is what is left of all documents when each is cut at the limit; share_within is the quantile
    that the limit is. Between two rows, truncated totals grow by docs_over for each token of the limit. No rows for
    an empty table.
    """
    h = histogram.withColumn("_span", F.floor(F.col("length") / SPAN))
    spans = h.groupBy("_span").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("length")).alias("_t"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spans = spans.select(
        "_span",
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
        F.sum("_d").over(whole).alias("_docs"),
        F.sum("_t").over(whole).alias("total_tokens"),
    )
    upto = Window.partitionBy("_span").orderBy("length")
    within = F.col("_d0") + F.sum("n_docs").over(upto)
    tokens = F.col("_t0") + F.sum(F.col("n_docs") * F.col("length")).over(upto)
    return (
        h.join(spans, "_span")
        .withColumn("docs_within", within)
        .withColumn("tokens_within", tokens)
        .withColumn("docs_over", F.col("_docs") - F.col("docs_within"))
        .select("length", "n_docs", "docs_within", "tokens_within", "docs_over", (F.col("tokens_within") + F.col("docs_over") * F.col("length")).alias("tokens_truncated"), "total_tokens", (F.col("docs_within") / F.col("_docs")).alias("share_within"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return context_report(staged(length_histogram(encoded_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))))
