"""Mixing sources to target weights by temperature, in DataFrame expressions only.

A source's share of all tokens, raised to an exponent from 0 to 1 and normalised, is its weight: 1 leaves the
corpus as it is, 0 makes all sources equal. The exponent is bisected until the mixture meets its target: the
largest one at which the weights' entropy is at least ``entropy`` (a share of that of equal weights), or else the
smallest one at which no source is repeated more than ``repeats`` times. Exponents are multiples of 2 ** -20.

Weights are realised in a budget of tokens, by default the least at which every document is used at least once.
A source's part of it is some full passes over its documents, and a part of one more. For that part the source's
documents are dealt into blocks by a hash of their id, blocks are permuted by a hash of their number, and whole
blocks are taken in this order until the next one would exceed what is left; of that one, documents are taken in
hash order while they fit. So no window spans a source: documents are summed up within blocks, blocks within runs
of blocks, runs within the source.

A document's tokens are its words (runs of characters other than ASCII white space), at least 1. A null source is
a source. Rows with equal ids and texts are separate documents that are treated alike. No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.runtime import Stash, fresh, prepare

STEPS, WAYS = 20, 32  # exponents k / 2 ** STEPS; how many parts each round of bisection cuts the range into
BLOCK_DOCS, RUN = 1024, 1024


def tokens(text: Column) -> Column:
    words = F.size(F.split(F.regexp_replace(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +", " "), " "))
    return F.greatest(F.coalesce(words, F.lit(1)), F.lit(1)).cast("long")


def exponent(sources: DataFrame, entropy: float | None, repeats: float | None) -> float:
    """sources: tokens of each. Each round evaluates all cuts of the range in one aggregate, so the driver sees one
    row a round, however many sources there are."""
    share = F.col("tokens") / F.lit(sources.agg(F.sum("tokens")).first()[0])
    lo, hi = 0, 1 << STEPS  # for entropy: true at lo; for repeats: true at hi

    def holds(ks: list[int]) -> list[bool]:
        power = [F.pow("share", F.lit(k / (1 << STEPS))) for k in ks]
        sums = [F.sum(p).alias(f"z{i}") for i, p in enumerate(power)] + [F.sum(p * F.log(p)).alias(f"e{i}") for i, p in enumerate(power)]
        most = [F.max(p / F.col("share")).alias(f"m{i}") for i, p in enumerate(power)] + [F.min(p / F.col("share")).alias(f"n{i}") for i, p in enumerate(power)]
        r = sources.select(share.alias("share")).agg(*sums, *most, F.log(F.count(F.lit(1))).alias("equal")).first()
        if entropy is not None:
            return [entropy_of(r[f"z{i}"], r[f"e{i}"]) >= entropy * r["equal"] - 1e-9 for i in range(len(ks))]
        return [r[f"m{i}"] / r[f"n{i}"] <= repeats + 1e-9 for i in range(len(ks))]

    if (entropy is not None) and holds([hi])[0]:
        return 1.0
    if (entropy is None) and holds([lo])[0]:
        return 0.0
    while hi - lo > 1:
        ks = sorted({lo + (hi - lo) * i // WAYS for i in range(1, WAYS)} - {lo, hi})
        ok = holds(ks)
        if entropy is not None:
            good = [k for k, y in zip(ks, ok, strict=True) if y]
            lo, hi = max([lo, *good]), min([hi, *(k for k, y in zip(ks, ok, strict=True) if not y)])
        else:
            hi, lo = min([hi, *(k for k, y in zip(ks, ok, strict=True) if y)]), max([lo, *(k for k, y in zip(ks, ok, strict=True) if not y)])
    return (lo if entropy is not None else hi) / (1 << STEPS)


def entropy_of(z: float, e: float) -> float:
    """Entropy of weights p / z, from the sums of p and of p log p."""
    return math.log(z) - e / z


def weights(docs: DataFrame, entropy: float | None, repeats: float | None, source: str, stash: Stash) -> DataFrame:
    """source, docs, tokens, weight. docs must have a column __tokens."""
    by = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum("__tokens").alias("tokens"))
    by = stash.keep(by, "sources")
    if not by.take(1):
        return by.withColumn("weight", F.lit(0.0))
    alpha = F.lit(exponent(by, entropy, repeats))
    p = F.pow(F.col("tokens") / F.lit(by.agg(F.sum("tokens")).first()[0]), alpha)
    return by.withColumn("weight", p / F.lit(by.agg(F.sum(p)).first()[0]))


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = 2.0, budget: int | None = None, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", stash: Stash | None = None) -> DataFrame:
    """The documents with n_tokens and copies, how often each stands in the mixture (0: not at all)."""
    spark = docs.sparkSession
    prepare(spark)
    stash = stash or Stash(spark, "mixing")
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    # the only pass over the words of the texts: what follows reads some 50 bytes a document
    counted = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(source).alias("s"), tokens(F.col(text)).alias("__tokens"), order.alias("o"))
    counted = stash.keep(counted, "counted")
    w = weights(counted, entropy, repeats, "s", stash)
    best = w.agg(F.max(F.col("tokens") / F.col("weight")).alias("b")).first()[0]
    b = float(budget) if budget is not None else best or 0.0
    part = w.select(
        F.col("source").alias("__source"), F.floor(F.lit(b) * F.col("weight") + 1e-6).cast("long").alias("quota"), "tokens",
        F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long").alias("blocks"),
    )
    part = part.select("__source", F.expr("quota div tokens").alias("full"), F.expr("quota % tokens").alias("rest"), "blocks")
    part = stash.keep(part, "quotas")
    dealt = counted.join(part, F.col("s").eqNullSafe(F.col("__source"))).select("id", "h", "s", "__tokens", "o", "full", "rest", (F.col("o") % F.col("blocks")).alias("blk"))
    dealt = stash.keep(dealt, "dealt")
    stash.drop("counted")
    turn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("block"), F.col("blk").cast("string"))), 1, 15), 16, 10).cast("long")
    blocks = dealt.groupBy("s", "blk", "rest").agg(F.sum("__tokens").alias("t")).withColumn("turn", turn).withColumn("run", (F.col("turn") / F.lit((1 << 60) // RUN)).cast("long"))
    before = Window.partitionBy("s", "run").orderBy("turn", "blk").rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.groupBy("s", "run").agg(F.sum("t").alias("rt"))
    ahead = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("s").alias("rs"), F.col("run").alias("rr"), F.coalesce(F.sum("rt").over(ahead), F.lit(0)).alias("ahead"))
    placed = blocks.join(runs, F.col("s").eqNullSafe(F.col("rs")) & (F.col("run") == F.col("rr")))
    placed = placed.select("s", "blk", (F.col("rest") - F.col("ahead") - F.coalesce(F.sum("t").over(before), F.lit(0))).alias("room"), "t")
    # of each source: blocks that fit, and the first that doesn't, cut within
    cut = placed.where("room > 0").select(F.col("s").alias("cs"), F.col("blk").alias("cb"), "room", (F.col("t") <= F.col("room")).alias("whole"))
    both = dealt.join(cut, F.col("s").eqNullSafe(F.col("cs")) & (F.col("blk") == F.col("cb")), "left")
    upto = Window.partitionBy("s", "blk").orderBy("o", "id", "h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    split = both.where("not whole").withColumn("extra", (F.sum("__tokens").over(upto) <= F.col("room")).cast("long"))
    rest = both.where("whole is null or whole").withColumn("extra", F.coalesce(F.col("whole").cast("long"), F.lit(0)))
    chosen = split.unionByName(rest).groupBy("id", "h").agg(F.max("__tokens").alias("n_tokens"), F.max(F.col("full") + F.col("extra")).alias("copies"))
    chosen = stash.keep(chosen.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "n_tokens", "copies"), "copies")
    stash.only("copies")
    docs = docs.drop("copies", "n_tokens")
    h = fresh(docs, "h")  # a column, so that a join whose result needs no text moves none
    docs = docs.withColumn(h, F.xxhash64(text))
    return docs.join(chosen, docs[key].eqNullSafe(chosen["__id"]) & (docs[h] == chosen["__h"])).drop(docs[h], chosen["__id"], chosen["__h"])


def realise(mixed: DataFrame) -> DataFrame:
    """One row for each copy in the mixture."""
    every = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return mixed.where("copies > 0").withColumn("copy", F.explode(every))
