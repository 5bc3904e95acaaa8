"""Connected components of a table of links, by alternating star contraction, all in joins and aggregates.

Each round links every node to the least node it knows of (large star: its larger neighbours, small star: its
smaller ones), which halves paths; rounds are written to the shared folder, so lineage stays short. Nothing is
gathered on the driver but one count a round. The neighbours of one node stream through one task's merge join, which
holds its least one only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.runtime import Stash


def components(links: DataFrame, stash: Stash, name: str) -> DataFrame:
    """links: columns a, b, of any comparable type. Returns node, root (the least node of the component) for every
    node that has a link. Repeated links, loops and either direction are fine; no links give no rows."""
    links = links.where("a is not null and b is not null and a <> b")
    edges = stash.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    size, k = _state(edges), 0
    while size[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        k += 1
        edges = stash.keep(small, f"{name}-{k}")
        stash.drop(f"{name}-{k - 1}")
        now = _state(edges)
        if now == size and _stars(edges):
            break
        size = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _stars(edges: DataFrame) -> bool:
    """Whether no node is both a root and below one, and each has one root."""
    return not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").take(1)
