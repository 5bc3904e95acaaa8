"""State that waits over a stream: entries that pair with exits, and rings of the last events.

Both run as stateful processors on a state store with timers (RocksDB's, ``configure``). Over a table the same rows come
from range scans, without state.

Pairs. A thread's entry waits for its exit. Another entry takes its place, and an exit that finds none waiting says
nothing, so what pairs is an entry and the thread's very next row, if that is an exit within the time-out. Entries that
nothing pairs with come out with no exit: when another takes their place, or when the watermark has passed their time-out.
A thread's rows may come in any order within a micro-batch, and in order from one to the next; rows behind the watermark
are too late.

Rings. The last ``n`` rows by (ts_unix_nano, seq), in shards: each keeps its own last n, so the last n of all are among
them, and one key's state is bounded whatever the stream. They are read from the checkpoint, while the stream runs or after.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.operators import scan
from tidewatch.operators.native import ORDER

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAIR = "tid string, ts_unix_nano long, seq long, entry string, exit string, exit_ts_unix_nano long"
_WAITING = "ts_unix_nano long, seq long, entry string"


def configure(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def pairs(calls: DataFrame, timeout_ns: int, parts: int | None = None) -> DataFrame:
    """calls: tid, kind (enter or exit), ts_unix_nano, seq, value. PAIR of each entry: entry is its value, exit that of
    the exit, null (and no time) if none came. Over a table; every entry that is left at the end counts as unpaired."""
    row = F.struct("kind", *ORDER, "value")
    seen = scan.last_states(calls.select("tid", "kind", *ORDER, "value"), ["tid"], ORDER, row, "before", parts).where("before.v.kind = 'enter'")
    good = (F.col("kind") == "exit") & (F.col("ts_unix_nano") - F.col("before.v.ts_unix_nano") <= timeout_ns)
    met = seen.select("tid", "before.v.ts_unix_nano", "before.v.seq", F.col("before.v.value").alias("entry"), F.when(good, F.col("value")).alias("exit"), F.when(good, F.col("ts_unix_nano")).alias("exit_ts_unix_nano"))
    last = calls.groupBy("tid").agg(F.max_by(row, F.struct(*ORDER)).alias("r")).where("r.kind = 'enter'")
    return met.unionByName(last.select("tid", "r.ts_unix_nano", "r.seq", F.col("r.value").alias("entry"), F.lit(None).cast("string").alias("exit"), F.lit(None).cast("long").alias("exit_ts_unix_nano")))


class _Pairing(StatefulProcessor):
    def __init__(self, timeout_ns: int):
        self.timeout = timeout_ns

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", _WAITING)

    def _due(self, ts: int) -> int:
        return -(-(ts + self.timeout) // 1_000_000)  # ms, not before the time-out

    def _out(self, tid: object, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            frame = pd.DataFrame([(tid, *r) for r in rows], columns=[c.split()[0] for c in PAIR.split(", ")])
            frame["exit_ts_unix_nano"] = frame["exit_ts_unix_nano"].astype("Int64")
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.waiting.get()) if self.waiting.exists() else None
        first, out = held, []
        frame = pd.concat(list(rows)).sort_values(list(ORDER), kind="stable")
        for kind, ts, seq, value in zip(frame["kind"], frame["ts_unix_nano"], frame["seq"], frame["value"], strict=True):
            if held is not None:
                good = kind == "exit" and ts - held[0] <= self.timeout
                out.append((*held, value if good else None, int(ts) if good else None))
            held = (int(ts), int(seq), value) if kind == "enter" else None
        if held != first:
            if first is not None:
                self.handle.deleteTimer(self._due(first[0]))
            if held is None:
                self.waiting.clear()
            else:
                self.waiting.update(held)
                self.handle.registerTimer(self._due(held[0]))
        yield from self._out(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            held = tuple(self.waiting.get())
            if self._due(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
                self.waiting.clear()
                yield from self._out(key[0], [(*held, None, None)])

    def close(self) -> None:
        pass


def stream_pairs(calls: DataFrame, timeout_ns: int, late: str = "0 seconds") -> DataFrame:
    """The same over a stream, in append mode; ``late`` is how far behind the last event rows may come."""
    timed = calls.select("tid", "kind", *ORDER, "value", F.timestamp_micros(F.expr("ts_unix_nano div 1000")).alias("at")).withWatermark("at", late)
    return timed.groupBy("tid").transformWithStateInPandas(_Pairing(timeout_ns), PAIR, "append", "eventTime")


class _Ring(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "ts_unix_nano long, seq long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        new = 0
        for frame in rows:
            new += len(frame)
            held += list(zip(frame["ts_unix_nano"].tolist(), frame["seq"].tolist(), frame["value"].tolist(), strict=True))
            held = sorted(held, key=lambda r: r[:2])[-self.n :]
        self.ring.put(held)
        yield pd.DataFrame({"shard": [key[0]], "rows": [new], "held": [len(held)]})

    def close(self) -> None:
        pass


def stream_ring(events: DataFrame, n: int, flagged: bool = False, shards: int = 8, value: Column | None = None) -> DataFrame:
    """Keep the last n events (``flagged``: of those with anomaly) of a stream; each micro-batch says what came and how
    many are held, by shard. Write it in update mode with a checkpoint."""
    kept = events.where(F.coalesce("anomaly", F.lit(False))) if flagged else events
    text = F.to_json(F.struct(*events.columns)) if value is None else value
    rows = kept.select(F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int").alias("shard"), *ORDER, text.alias("value"))
    return rows.groupBy("shard").transformWithStateInPandas(_Ring(n), "shard int, rows long, held long", "update", "none")


def ring(spark: SparkSession, checkpoint: str, n: int) -> DataFrame:
    """ts_unix_nano, seq, value: the last n rows that the stream with this checkpoint holds."""
    held = spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint)
    return held.select("list_element.*").orderBy(*[F.desc(c) for c in ORDER]).limit(n)
