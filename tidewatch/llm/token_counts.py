"""Token totals under every context limit, from one exact histogram of encoded lengths.

Documents are encoded once and grouped by length; everything else is suffix sums over the histogram. Lengths are
dealt out in blocks of ``BLOCK``: sums within a block are windows over at most ``BLOCK`` rows, and only one row a
block is summed up across blocks, so no task sees the whole histogram.

Null and empty texts have length 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.bpe import token_lengths
from tidewatch.llm.runtime import Stash

BLOCK = 256


def histogram(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length. It is written, so that whatever is asked of it
    encodes the corpus once."""
    lengths = token_lengths(docs.select(text), vocabulary, text).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    return Stash(docs.sparkSession, "lengths").keep(lengths, "histogram")


def limits(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: n_docs of this length, docs_within (not longer),
    docs_over (longer, so cut), total_tokens of the documents within, kept_tokens if every document is cut to the
    limit, lost_tokens by that, and quantile: the share of documents that are not longer."""
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    over = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(over), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("bt").over(over), F.lit(0)).alias("later_tokens"),
        F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    more_docs = F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("later_docs")
    more_tokens = F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("later_tokens")
    s = h.join(blocks, "block").select("n_tokens", "n_docs", "all_docs", "all_tokens", more_docs.alias("docs_over"), more_tokens.alias("over"))
    kept = F.col("all_tokens") - F.col("over") + F.col("docs_over") * F.col("n_tokens")
    return s.select(
        "n_tokens", "n_docs", (F.col("all_docs") - F.col("docs_over")).alias("docs_within"), "docs_over",
        (F.col("all_tokens") - F.col("over")).alias("total_tokens"), kept.alias("kept_tokens"), (F.col("all_tokens") - kept).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(hist: DataFrame, wanted: list[int]) -> DataFrame:
    """The row of ``limits`` without n_docs for context limits that need not occur as a length: context_limit,
    docs_within, docs_over, total_tokens, kept_tokens, lost_tokens. One pass over the histogram."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    rows = []
    for limit in wanted:
        within = n <= limit
        rows.append(F.struct(
            F.lit(int(limit)).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(within, d)), F.lit(0)).alias("docs_within"), F.coalesce(F.sum(F.when(~within, d)), F.lit(0)).alias("docs_over"),
            F.coalesce(F.sum(F.when(within, n * d)), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(F.least(n, F.lit(int(limit))) * d), F.lit(0)).alias("kept_tokens"),
            F.coalesce(F.sum(F.greatest(n - limit, F.lit(0)) * d), F.lit(0)).alias("lost_tokens"),
        ))
    return hist.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least this share of documents does not exceed, for each share asked for."""
    asked = [F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q{q:g}") for q in shares]
    return table.agg(*asked)
