"""Token counts by an exact length histogram.

Every document is encoded once and only its length is kept: each task sums its own lengths before anything is shuffled,
so what moves is at most one row for each length and task. Suffix sums over the lengths then answer totals, quantiles
and truncated totals for every context limit, without the documents.

Nulls and empty texts have 0 tokens and count as documents. Repeated rows count each. An empty table gives an empty
histogram. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, narrow, written
from .encode import encoder

#: Lengths are summed in blocks of so many first, so that no window holds all of them.
BLOCK = 1024


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, n_docs: how many documents have so many tokens."""

    def count(batches):
        e, found = encoder(path), Counter()
        for b in batches:
            col = b.column(0)
            for i in range(0, len(col), 512):
                found.update(len(x) // 4 for x in e.encoded(col.slice(i, 512).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["n_tokens", "n_docs"])

    return bounded(narrow(docs, "text")).mapInArrow(count, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """For each length that occurs: its documents; the documents at least as long and their tokens; the documents at most as
    long; and the tokens that remain if every document is cut at it."""
    h = written(docs.sparkSession, lengths(docs, path), "token-lengths")  # read twice below: nothing is encoded again
    h = h.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of lengths
    zero = F.lit(0).cast("long")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(whole), zero).alias("docs_above"), F.coalesce(F.sum("t").over(whole), zero).alias("tokens_above"), F.sum("d").over(every.orderBy("block")).alias("all_docs"), F.sum("t").over(every.orderBy("block")).alias("all_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    h = h.join(blocks, "block").select("n_tokens", "n_docs", (F.col("docs_above") + F.sum("n_docs").over(own)).alias("docs_from"), (F.col("tokens_above") + F.sum("tokens").over(own)).alias("tokens_from"), "all_docs", "all_tokens")
    return h.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_to"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("kept_at_limit"),
        F.col("all_docs").alias("total_docs"),
        F.col("all_tokens").alias("total_tokens"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """The tokens that remain at any context limit, also one that is no document's length: one row, kept long."""
    long = F.col("n_tokens") > limit
    return hist.agg(F.coalesce(F.sum(F.col("n_docs") * F.when(long, F.lit(limit)).otherwise(F.col("n_tokens"))), F.lit(0)).cast("long").alias("kept"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The smallest length that a share q of the documents doesn't exceed: one row, null for no documents."""
    return hist.filter(F.col("docs_to") >= F.ceil(F.lit(float(q)) * F.col("total_docs"))).agg(F.min("n_tokens").alias("n_tokens"))
