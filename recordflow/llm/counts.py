"""Token counts: an exact length histogram with suffix sums.

Documents are reduced to one number, their encoded length, and pre-aggregated to
(length, documents) before any shuffle. Suffix sums run in two levels (within blocks of
``BLOCK`` lengths, and over blocks), so that no task sees more than one block of lengths.

Cases: null text counts as empty (length 0); repeated rows count each; an empty table
gives an empty histogram; text of any length is encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordflow.llm.shared import settle

BLOCK = 1024
_encoders: dict[tuple[str, str], tiktoken.Encoding] = {}


def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens of every row: its text's length under the rank file at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern).encode_ordinary
        for batch in batches:
            yield pa.record_batch([pa.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """n_tokens, n_docs: partial sums per task go into the shuffle, not documents."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L that occurs: n_docs, docs_over and tokens_over (of documents longer
    than L), docs_at_most, total_docs, total_tokens, truncated_tokens (what is left when
    every document is cut to L), dropped_tokens, quantile (share of documents of at most
    L tokens). hist is read three times: pass a settled table."""
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("block", zero(F.sum("b_docs").over(above)).alias("docs_above"), zero(F.sum("b_tokens").over(above)).alias("tokens_above"), F.sum("b_docs").over(every).alias("total_docs"), F.sum("b_tokens").over(every).alias("total_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.withColumn("docs_in", zero(F.sum("n_docs").over(within))).withColumn("tokens_in", zero(F.sum("tokens").over(within))).join(blocks, "block")
    out = out.withColumn("docs_over", F.col("docs_in") + F.col("docs_above")).withColumn("tokens_over", F.col("tokens_in") + F.col("tokens_above"))
    kept = F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")
    at_most = F.col("total_docs") - F.col("docs_over")
    return out.select("n_tokens", "n_docs", "docs_over", "tokens_over", at_most.alias("docs_at_most"), "total_docs", "total_tokens", kept.alias("truncated_tokens"), (F.col("total_tokens") - kept).alias("dropped_tokens"), (at_most / F.col("total_docs")).alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, truncated_tokens, dropped_tokens for any limits: a limit
    between two lengths has the sums of the next shorter length."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    first = sums.join(F.broadcast(wanted), F.expr("n_tokens <= context_limit")).groupBy("context_limit").agg(F.max_by(F.struct("docs_over", "tokens_over", "total_tokens"), "n_tokens").alias("s"))
    got = wanted.join(first, "context_limit", "left")
    alone = sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("t"))
    got = got.join(F.broadcast(alone), F.lit(True))  # one row
    docs_over, tokens_over = F.coalesce("s.docs_over", "d"), F.coalesce("s.tokens_over", "t")
    kept = F.col("t") - tokens_over + F.col("context_limit") * docs_over
    return got.select("context_limit", docs_over.alias("docs_over"), kept.alias("truncated_tokens"), (F.col("t") - kept).alias("dropped_tokens"))


def at_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of documents
    doesn't exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(wanted), F.expr("quantile >= share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    return suffix_sums(settle(histogram(lengths(docs, path, pattern, text_col))))
