"""The trie of all conversations' prefixes, by partition refinement.

A conversation's turns, each a digest of its role and text, stand in order; equal conversations count as one with
several copies. All of them begin in one class, the root. Active classes are split by the next turn, a stride of turns
in one job: a class's members that go on alike stay together, and a class of one is retired: what is left of its
conversation is a chain of nodes with one child each, given out as it stands. Members of the classes that are left go on
with the next stride, twice as long, so rounds follow the logarithm of the longest prefix that different
conversations share, and copies never make one. At last the totals of the chains and of the shared nodes are folded back
along each member's path, and added up by node.

A node is named by its depth and its smallest member. Texts are read once, and only digests, of 128 bits, are
shuffled. Nothing holds a group in memory: counts and sums are aggregated ahead of the shuffle, positions within a
conversation and sums along chains are taken in blocks of turns and carried over, and a node's list of ended
conversations is hashed as a stream of pieces, each a run of ids of one block of numbers.

Order of turns: null first, then by number, turns of one number by role, then by digest. Null role and text are empty.
Rows without conversation id are no turns. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.runtime import Stash, prepare

#: Turns of one conversation that are ordered or added up in one piece.
BLOCK = 4096
#: Turns by which the first round splits.
STRIDE = 4
#: Ids are strung together for numbers of one block of this size.
IDS = 1 << 14
_NOTHING = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, key: str, at: Column, order: list[Column], value: Column, out: str, down: bool = False) -> DataFrame:
    """Append the sum of ``value`` over the rows of the same key up to and with each row, in ascending (``down``:
    descending) order; ``at`` is the number that order follows first. Sums are taken in blocks of BLOCK numbers, and those of the
    blocks before are carried over, so no key's rows need be in one task."""
    df = df.withColumn("__block", F.coalesce(F.floor(at / BLOCK), F.lit(-(1 << 62)).cast("long"))).withColumn("__value", value)
    sums = df.groupBy(key, "__block").agg(F.sum("__value").alias("__sum"))
    turn = F.col("__block").desc() if down else F.col("__block")
    w = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(key, "__block", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    within = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = df.withColumn("__within", F.sum("__value").over(within)).join(before, [key, "__block"])
    return both.withColumn(out, F.col("__before") + F.col("__within")).drop("__block", "__value", "__before", "__within")


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest, words: the turns of each conversation in order."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256)), 1, 16)
    rows = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), r.alias("role"), digest.alias("digest"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return running(rows, "conv_id", F.col("turn"), order, F.lit(1), "pos").select("conv_id", "pos", "digest", "words")


def borrowed(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % every, and c's own behind its first h, where h is
    the crc32 of c's decimal modulo ``most``. conv_id, pos, digest, words; a conversation without any turn left has one row with
    null pos."""
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    first = own.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    lead = convs.join(first, "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "digest", "words")
    had = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left").select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("got"))
    rest = own.join(had, "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "digest", "words")
    bare = convs.join(had.select("conv_id", "got"), "conv_id").where((F.col("got") == 0) & (F.col("n") <= F.col("h")))
    return lead.unionByName(rest).unionByName(bare.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("words")))


def _print(pos: Column, digest: Column) -> list[Column]:
    """Two numbers of 60 bits that stand for a turn at its place; those of several turns are combined by exclusive or."""
    h = F.sha2(F.concat(pos.cast("string").cast("binary"), F.lit(":").cast("binary"), digest), 256)
    return [F.coalesce(F.conv(F.substring(h, a, 15), 16, 10).cast("long"), F.lit(0)) for a in (1, 16)]


def _ends(copies: DataFrame) -> DataFrame:
    """same, ends: the hash of the ascending ids of each group of equal conversations."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = copies.groupBy("sid", F.floor(F.col("conv_id") / IDS).alias("block")).agg(piece.alias("piece"))  # ids differ, so IDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, hashed = None, None
        for batch in batches:
            done = []
            for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != sid:
                    if hashed is not None:
                        done.append((sid, hashed.hexdigest()))
                    sid, hashed = s, hashlib.sha256(p.encode())
                else:
                    hashed.update(b"," + p.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["sid", "ends"])
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sid], pa.int64()), pa.array([hashed.hexdigest()])], names=["sid", "ends"])

    ordered = pieces.repartition("sid").sortWithinPartitions("sid", "block").select("sid", "piece")
    return ordered.mapInArrow(run, "sid long, ends string")


def nodes(rebuilt: DataFrame, stash: Stash | None = None) -> DataFrame:
    """The trie of conversations (conv_id, pos from 1 without gaps, digest, words; a row of null pos for one without
    turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    spark = rebuilt.sparkSession
    prepare(spark)
    stash = stash or Stash(spark, "trie")
    a, b = _print(F.col("pos"), F.col("digest"))
    rebuilt = stash.keep(rebuilt.withColumns({"a": a, "b": b}), "rebuilt")

    # equal conversations are one, named by the smallest
    whole = rebuilt.groupBy("conv_id").agg(F.count("pos").alias("len"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    whole = stash.keep(whole, "whole")
    groups = whole.groupBy("len", "a", "b").agg(F.min("conv_id").alias("sid"), F.count(F.lit(1)).alias("copies"))
    groups = stash.keep(groups, "groups")
    many = groups.where("copies > 1").select("len", "a", "b", "sid")
    ends = _ends(whole.join(many, ["len", "a", "b"]).select("sid", "conv_id"))
    alone = F.sha2(F.col("sid").cast("string"), 256)
    seqs = stash.keep(groups.join(ends, "sid", "left").select("sid", "len", "copies", F.coalesce("ends", alone).alias("ends")), "seqs")
    steps = stash.keep(rebuilt.where("pos is not null").join(groups.select(F.col("sid").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "sid"), "steps")
    stash.drop("rebuilt", "whole", "groups")

    # shared nodes: members (sid) of the classes of two and more, by depth
    root = seqs.agg(F.min("sid"), F.sum("copies")).first()
    if root[0] is None:
        return spark.createDataFrame([], _SCHEMA)
    active = seqs.where("len > 0").select("sid", "copies", F.lit(root[0]).alias("node"))
    paths, depth, stride = [], 0, STRIDE
    while True:
        ahead = steps.where((F.col("pos") > depth) & (F.col("pos") <= depth + stride)).join(active, "sid")
        w = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        ahead = ahead.select("sid", "copies", "node", "pos", "words", F.bit_xor("a").over(w).alias("a"), F.bit_xor("b").over(w).alias("b"))
        split = ahead.groupBy("node", "pos", "a", "b").agg(F.min("sid").alias("conv"), F.sum("copies").alias("n"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        path = stash.keep(ahead.join(split, ["node", "pos", "a", "b"]).select("sid", "copies", "pos", "words", "conv", "n"), f"path-{depth}")
        paths.append(path)
        depth, stride = depth + stride, 2 * stride
        active = path.where(F.col("pos") == depth).select("sid", "copies", F.col("conv").alias("node"))
        if not active.take(1):
            break

    # every conversation's path through shared nodes, the root first
    top = seqs.select("sid", "copies", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("words"), F.lit(root[0]).alias("conv"), F.lit(root[1]).alias("n"))
    path = reduce(DataFrame.unionByName, [top, *paths])
    reach = path.groupBy("sid").agg(F.max("pos").alias("reach"), F.max_by("conv", "pos").alias("last"))
    tail = seqs.join(reach, "sid").where(F.col("len") > F.col("reach"))
    chain = steps.select("sid", "pos", "words").join(tail, "sid").where(F.col("pos") > F.col("reach"))
    chain = running(chain, "sid", F.col("pos"), [F.col("pos").desc()], (F.col("copies") - 1) * F.col("words"), "saved", down=True)
    chain = stash.keep(chain.select("sid", "pos", "saved", "len", "copies", "reach", "last", "ends"), "chains")
    at_end = F.col("pos") == F.col("len")
    chains = chain.select(F.col("sid").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("reach") + 1, F.col("last")).otherwise(F.col("sid")).alias("parent_conv_id"), F.col("copies").alias("n_convs"),
                          F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(at_end, F.col("ends")).otherwise(F.lit(_NOTHING)).alias("ends_sha256"))

    hung = chain.where(F.col("pos") == F.col("reach") + 1).select("sid", F.col("saved").alias("hung"))
    w = Window.partitionBy("sid").orderBy("pos")
    below = Window.partitionBy("sid").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("conv") == F.col("sid"), (F.col("n") - 1) * F.col("words")).otherwise(0)
    walk = path.join(seqs.select("sid", "len", "ends"), "sid").join(hung, "sid", "left")
    walk = walk.select("sid", "copies", "pos", "conv", "len", "ends", "hung", F.lag("conv").over(w).alias("parent"), F.lead("conv").over(w).alias("next"), F.sum(own).over(below).alias("saved"))
    last = F.col("next").isNull() & F.col("hung").isNotNull()
    shared = walk.groupBy(F.col("conv").alias("conv_id"), F.col("pos").alias("depth")).agg(
        F.min("parent").alias("parent_conv_id"), F.sum("copies").alias("n_convs"), F.count_if((F.col("next") == F.col("sid")) | last).alias("n_children"),
        F.count("hung").alias("n_leaves"), F.sum(F.col("saved") + F.coalesce("hung", F.lit(0))).alias("saved_tokens"), F.coalesce(F.max(F.when(at_end, F.col("ends"))), F.lit(_NOTHING)).alias("ends_sha256"))
    shared = shared.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1)))  # a root without turns below it is a leaf
    return shared.unionByName(chains)


_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
