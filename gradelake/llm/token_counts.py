"""Exact length histogram: documents by encoded length, and suffix sums that answer questions for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.bpe import Encoded, with_tokens
from gradelake.llm.common import cut


def lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and n_tokens. A null text counts as empty (0 tokens); repeated ids stay rows of their own; very long texts are counted whole.

    An empty table gives no rows; further columns, whatever their names, are not looked at.
    """

    def make(e: Encoded, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(e.counts(), pa.int64())], [id_col, "n_tokens"])

    return with_tokens(docs, path, [id_col], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long", make, text_col)


def histogram(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (n_tokens, n_docs), one for each length that occurs."""
    return lengths(docs, path, id_col, text_col).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def answers(hist: DataFrame, width: int = 1024) -> DataFrame:
    """For each length L that occurs, taken as a context limit: what suffix sums of the histogram say. Between two such limits the counts do not change.

    n_docs: documents of length L; docs_over, tokens_over: of documents longer than L; docs_total, tokens_total: of all;
    truncated_total: tokens left when each document is cut at L; tokens_lost: the rest; share_within: share of documents no longer than L, so the
    q-quantile of the lengths is the least L with share_within >= q. An empty histogram gives no rows.
    Lengths without documents, nulls and repeated lengths do not occur in a histogram; columns besides its two are not looked at. Sums run within blocks of
    `width` lengths, then over the blocks, so no task holds more than one block or the short list of blocks. The histogram is written once and used twice.
    """
    h = cut(hist.select("n_tokens", "n_docs"), "histogram")
    h = h.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / width).alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    blocks = blocks.select(
        F.col("block").alias("b"), F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("t0"),
        F.sum("bd").over(every).alias("docs_total"), F.sum("bt").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    own = h.select("n_tokens", "n_docs", "block", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("d1"), F.coalesce(F.sum("t").over(inside), F.lit(0)).alias("t1"))
    docs_over, tokens_over, limit = F.col("d0") + F.col("d1"), F.col("t0") + F.col("t1"), F.col("n_tokens")
    return own.join(blocks, F.col("block") == F.col("b")).select(
        limit.alias("context_limit"), "n_docs", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"), "docs_total", "tokens_total",
        (F.col("tokens_total") - tokens_over + limit * docs_over).alias("truncated_total"), (tokens_over - limit * docs_over).alias("tokens_lost"),
        (1 - docs_over / F.col("docs_total")).alias("share_within"),
    )
