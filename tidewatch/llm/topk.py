"""Exact top-k inner products by a bit-sliced index.

Components are quantised to floor(scale * x). A block of rows keeps, for each attribute and each bit of its
values above the block's least, a bitmap over the rows. The scores of a block for many queries are bit-sliced as
well: each attribute slice is added as often as the query's component says, shifted bit by bit, with carry-save
adders on bitmaps (negative components add the complement). The top rows are then selected from the most
significant slice downward, with a set of sure rows and a set of tied ones, and the rows tied at the boundary are
resolved by smaller id. Each block's few rows go to one ranking a query.

Queries meet rows block by block: parts of the queries travel to every block of rows, which is the stated query set
against all rows, ``PARTS`` parts at a time, and a block's index is built once for these. Blocks and parts hold a
bounded number of rows, and equal vectors need no special case.

A vector takes part if it is not null and holds no null or non-finite component; vectors of different
lengths never meet, and the product of empty ones is 0. Vectors with a component beyond +-2**20 once scaled are in blocks of their own, as they came,
so that the others need no more slices for them; theirs are as many as the range demands. Scores are ranked exactly at any size; one that 64 bits can't
hold is null in the result. Rows with equal ids are separate rows, each a query of its own if it is one; a query row is
never its own candidate, but other rows with its id are. Null ids take no part. No queries, or no rows, give no result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.runtime import Stash, prepare

ROWS, QUERIES, PARTS, LEAST_BLOCKS = 16384, 256, 64, 8
LIMIT = float(1 << 20)
#: Bytes of scores beyond 64 bits as sort keys: products of two scaled doubles, summed, with a sign.
WIDE = 288


def quantised(vectors: DataFrame, key: str, vector: str, scale: int, queries: Column) -> DataFrame:
    """key, asked (whether it is a query), v (array<int>) or, beyond the limit, w (the components as they are), d, wide:
    the vectors that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # NaN is larger than any number
    small = F.forall(vector, lambda c: F.abs(c.cast("double") * scale) < LIMIT)
    taken = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine)
    v = F.when(small, F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale)).cast("array<int>"))
    return taken.select(F.col(key).alias("key"), F.coalesce(queries, F.lit(False)).alias("asked"), v.alias("v"), F.when(~small, x).alias("w"), F.size(vector).alias("d"), (~small).alias("wide"))


def _whole(x: float, scale: int) -> int:
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def _values(data: pa.Buffer, n: int, d: int, wide: bool, scale: int) -> np.ndarray:
    """Vectors as integers: 64 bits, or Python's own where those may not do."""
    if not wide:
        return np.frombuffer(data, np.int32).reshape(n, d).astype(np.int64)
    x = np.frombuffer(data, np.float64)
    if np.abs(x).max(initial=0) < 2.0**61 / scale:
        return np.floor(x * scale).astype(np.int64).reshape(n, d)
    out = np.empty(len(x), object)
    out[:] = [_whole(c, scale) for c in x.tolist()]
    return out.reshape(n, d)


def _packed(table: DataFrame, blocks: int) -> DataFrame:
    """Rows of blocks: d, blk, keys, rows (which row of the table each is) and values as bytes, in order of key."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("key").combine_chunks()
        v = t.column("w" if key[2].as_py() else "v").combine_chunks()
        v = np.asarray((v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten())
        held = [pa.array([x.tobytes()], pa.binary()) for x in (*(np.asarray(t.column(c)).astype(np.int64) for c in ("key", "row")), v)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.bool_()), *held], names=["d", "blk", "wide", "keys", "rows", "values"])

    dealt = table.withColumn("blk", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("d", "blk", "wide").applyInArrow(run, "d int, blk int, wide boolean, keys binary, rows binary, values binary")


class BitSliced:
    """The index of one block: rows in ascending order of key. which: names of the rows in the whole table."""

    def __init__(self, keys: np.ndarray, which: np.ndarray, x: np.ndarray):
        self.keys, self.which, self.x = keys, which, x
        self.low = int(x.min(initial=0))
        self.bits = max(1, (int(x.max(initial=0)) - self.low).bit_length())
        self.most = int(np.abs(x).max(initial=0))
        self.words = -(-len(x) // 64)
        shifted = np.zeros((self.words * 64, x.shape[1]), x.dtype)
        shifted[: len(x)] = x - self.low
        self.slices = [[self._pack((shifted[:, d] >> b) & 1) for b in range(self.bits)] for d in range(x.shape[1])]
        self.rows = self._pack(np.arange(self.words * 64) < len(x))

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits.astype(bool), bitorder="little").view("<u8")

    def scores(self, q: np.ndarray) -> list[np.ndarray]:
        """Bit slices, least first, of each row's score for each query, plus an amount per query that all rows share."""
        size, minus = np.abs(q), q < 0
        held: list[list[np.ndarray]] = [[]]

        def add(level: int, x: np.ndarray) -> None:
            while True:
                if level == len(held):
                    held.append([])
                held[level].append(x)
                if len(held[level]) < 3:
                    return
                a, b, c = held[level]
                u = a ^ b
                held[level] = [u ^ c]
                level, x = level + 1, (a & b) | (u & c)

        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        for d in range(q.shape[1]):
            flip = np.where(minus[:, d], full, np.uint64(0))[:, None]
            masks = [np.where(((size[:, d] >> j) & 1).astype(bool), full, np.uint64(0))[:, None] for j in range(int(size[:, d].max()).bit_length())]
            for b, s in enumerate(self.slices[d]):
                s = s[None, :] ^ flip
                for j, m in enumerate(masks):
                    add(b + j, s & m)
        out, k = [], 0
        while k < len(held):  # what is left of the adders: at most two a level, and a carry
            now = held[k]
            while len(now) > 1:
                a, b = now.pop(), now.pop()
                now.append(a ^ b)
                if k + 1 == len(held):
                    held.append([])
                held[k + 1].append(a & b)
            out.append(now[0] if now else np.zeros((len(q), self.words), np.uint64))
            k += 1
        return out

    def top(self, asking: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, row, score) of each query's k best rows; asking: the queries' own rows, which don't count."""
        tied = np.repeat(self.rows[None, :], len(q), 0)
        order = np.argsort(self.which)
        at = np.searchsorted(self.which, asking, sorter=order)
        for i in np.flatnonzero(at < len(order)):
            if self.which[r := order[at[i]]] == asking[i]:
                tied[i, r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        sure = np.zeros_like(tied)
        for s in reversed(self.scores(q)):
            ones = sure | (tied & s)
            more = (np.bitwise_count(ones).sum(1) > k)[:, None]
            sure = np.where(more, sure, ones)
            tied &= np.where(more, s, ~s)
        need = k - np.bitwise_count(sure).sum(1).astype(np.int64)
        qi, rows = np.nonzero(np.unpackbits(sure.view(np.uint8), axis=1, bitorder="little"))
        ti, trows = np.nonzero(np.unpackbits(tied.view(np.uint8), axis=1, bitorder="little"))
        rank = np.arange(len(ti)) - np.searchsorted(ti, ti)  # within the query, ascending rows and so keys
        ok = rank < need[ti]
        qi, rows = np.concatenate([qi, ti[ok]]), np.concatenate([rows, trows[ok]])
        x, y = self.x[rows], q[qi]
        if self.most * int(np.abs(q).max(initial=0)) * q.shape[1] < 1 << 63:
            return qi, rows, np.einsum("ij,ij->i", x, y)
        return qi, rows, (x.astype(object) * y.astype(object)).sum(1)


def _scored(scores: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Scores, null beyond 64 bits, and for those the bytes by which they are ordered."""
    if scores.dtype != object:
        return pa.array(scores, pa.int64()), pa.nulls(len(scores), pa.binary())
    fits = [-(1 << 63) <= s < 1 << 63 for s in scores]
    order = [None if f else (s + (1 << 8 * WIDE - 1)).to_bytes(WIDE, "big") for s, f in zip(scores, fits, strict=True)]
    return pa.array([s if f else None for s, f in zip(scores, fits, strict=True)], pa.int64()), pa.array(order, pa.binary())


def search(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding", stash: Stash | None = None) -> DataFrame:
    """query_id, rank (from 1), key, score (null beyond 64 bits): for each row that the condition ``queries`` picks, its
    k best others."""
    spark = vectors.sparkSession
    prepare(spark, 4096)
    stash = stash or Stash(spark, "topk")
    table = stash.keep(quantised(vectors, key, vector, scale, queries).withColumn("row", F.monotonically_increasing_id()), "rows")
    n, nq = table.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1))).first()
    blocks, parts = max(LEAST_BLOCKS, -(-n // ROWS)), max(1, -(-nq // QUERIES))
    rows = stash.keep(_packed(table, blocks), "blocks")
    asked = stash.keep(_packed(table.where("asked"), parts), "parts")
    stash.drop("rows")
    turns = -(-parts // PARTS)
    sent = asked.select("d", F.col("blk").alias("part"), F.col("wide").alias("qwide"), F.col("keys").alias("qkeys"), F.col("rows").alias("qrows"), F.col("values").alias("qvalues"))
    met = rows.select(F.col("d").alias("rd"), F.col("blk").alias("to"), F.col("wide").alias("towide"))  # a row a block
    sent = sent.join(met, F.col("d") == F.col("rd")).withColumn("at", F.col("part") % turns)
    held = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    names, types = ["query_id", "asking", "key", "score", "beyond"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(group: tuple[pa.Scalar, ...], block: pa.Table, queries: pa.Table) -> pa.Table:
        d, wide, out = group[0].as_py(), group[2].as_py(), []
        if block.num_rows and queries.num_rows:
            keys, which, x = (block.column(c)[0].as_buffer() for c in ("keys", "rows", "values"))
            keys, which = np.frombuffer(keys, np.int64), np.frombuffer(which, np.int64)
            index = BitSliced(keys, which, _values(x, len(keys), d, wide, scale))
            for qwide, qkeys, qrows, q in zip(*(queries.column(c) for c in ("qwide", "qkeys", "qrows", "qvalues")), strict=True):
                qkeys, qrows = (np.frombuffer(b.as_buffer(), np.int64) for b in (qkeys, qrows))
                i, r, s = index.top(qrows, _values(q.as_buffer(), len(qkeys), d, qwide.as_py(), scale), k)
                out.append(pa.table([pa.array(qkeys[i]), pa.array(qrows[i]), pa.array(keys[r]), *_scored(s)], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in types], names=names)

    found = held.groupBy("d", "blk", "wide", "turn").cogroup(sent.groupBy("rd", "to", "towide", "at")).applyInArrow(run, "query_id long, asking long, key long, score long, beyond binary")
    # beyond 64 bits, above or below the scores that are not: the first byte tells the sign
    side = F.when(F.col("beyond").isNull(), 0).when(F.substring("beyond", 1, 1) >= F.lit(bytes([128])), 1).otherwise(-1)
    w = Window.partitionBy("query_id", "asking").orderBy(side.desc(), F.desc("beyond"), F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("key").alias(key), "score")
