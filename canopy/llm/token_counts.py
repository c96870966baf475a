"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the lengths answer totals, quantiles and
totals under truncation for every context limit, without another pass over the corpus.

Defined results: null and empty texts have length 0; repeated rows count each, as do ties in length; very long
texts are encoded whole; all other columns are left out; no rows give no rows, a total of 0 and a null quantile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.shared import quoted, small_batches, table


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("canopy", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    path = path or rank_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(0)], pa.int64())], ["length"])

    return small_batches(docs).select(F.col(quoted(text))).mapInArrow(run, "length long")


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """One row per length that occurs: documents and tokens of that length and of at least that length
    (suffix sums), the corpus total if every document is cut to that length, and the share of documents that are
    no longer. As many rows as lengths, at most as the longest text has tokens, so one task orders them."""
    counts = lengths(docs, text, path).groupBy("length").agg(F.count("*").alias("n_docs")).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    up = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = counts.withColumn("docs_from", F.sum("n_docs").over(up)).withColumn("tokens_from", F.sum("n_tokens").over(up))
    below, all_docs = F.sum("n_tokens").over(every) - F.col("tokens_from"), F.sum("n_docs").over(every)
    out = out.withColumns({"truncated_total": below + F.col("length") * F.col("docs_from"), "share_upto": (all_docs - F.col("docs_from") + F.col("n_docs")) / all_docs})
    return out.select("length", "n_docs", "n_tokens", "docs_from", "tokens_from", "truncated_total", "share_upto")


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens left if every document is cut to ``limit``: the suffix sums at the first length that reaches it."""
    reached = F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("length") >= limit, F.col("length")))
    one = histogram.agg(F.coalesce(F.max("tokens_from"), F.lit(0)).alias("all"), reached.alias("r"))
    return one.select(F.coalesce(F.col("all") - F.col("r.tokens_from") + limit * F.col("r.docs_from"), "all").alias("n_tokens"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents does not exceed."""
    return histogram.where(F.col("share_upto") >= q).agg(F.min("length").alias("length"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"))
