"""State that waits over a stream: the stream's rows are the table's."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.native import ORDER
from tidewatch.streaming import pending

CALLS = "tid string, kind string, ts_unix_nano long, seq long, value string"
S = 10**9


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield pending.configure(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def calls(n=400, seed=3):
    r, ts, out = random.Random(seed), 10 * S, []
    for i in range(n):
        ts += r.randrange(0, 2 * S)
        out.append((r.choice(["t1", "t2", "t3", "hot", "hot", "hot"]), r.choice(["enter", "exit"]), ts, i, f"v{i}"))
    return out


def brute(rows, timeout):
    out, waiting = [], {}
    for tid, kind, ts, seq, value in sorted(rows, key=lambda r: r[2:4]):
        if (held := waiting.pop(tid, None)) is not None:
            good = kind == "exit" and ts - held[0] <= timeout
            out.append((tid, *held, value if good else None, ts if good else None))
        if kind == "enter":
            waiting[tid] = (ts, seq, value)
    return sorted(out + [(t, *h, None, None) for t, h in waiting.items()], key=str)


@pytest.mark.parametrize("parts", [1, 6, 80])
@pytest.mark.parametrize("timeout", [0, S, 3 * S])
def test_pairs_of_a_table(spark, parts, timeout):
    got = pending.pairs(spark.createDataFrame(calls(), CALLS), timeout, parts).collect()
    assert sorted(map(tuple, got), key=str) == brute(calls(), timeout)


def test_pairs_of_a_stream(rocks, tmp_path):
    """Micro-batches in order, rows within them in any; entries without exit come when the watermark passes their time-out,
    while other threads go on."""
    rows, timeout, src = calls(), 3 * S, str(tmp_path / "in")
    r, end = random.Random(1), max(x[2] for x in calls())
    for k in range(5):
        part = rows[k * 80 : (k + 1) * 80]
        r.shuffle(part)
        q = None
        rocks.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(src)
        q = _run(rocks, src, tmp_path, timeout)
    for k in range(2):  # time goes on
        rocks.createDataFrame([("later", "exit", end + (k + 1) * 60 * S, 10**6 + k, "x")], CALLS).coalesce(1).write.mode("append").parquet(src)
        q = _run(rocks, src, tmp_path, timeout)
    assert q.exception() is None
    got = rocks.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, timeout)


def _run(spark, src, tmp_path, timeout):
    calls = spark.readStream.schema(CALLS).parquet(src)
    q = pending.stream_pairs(calls, timeout, "5 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    return q


@pytest.mark.parametrize("flagged", [False, True])
def test_rings(rocks, tmp_path, flagged):
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    events = rocks.range(600).select(F.col("id").alias("seq"), ((F.col("id") * 7919) % 600 * 1000).alias("ts_unix_nano"), F.col("id").cast("string").alias("event_id"), (F.col("id") % 5 == 0).alias("anomaly"))
    for k in range(3):
        events.where((F.col("seq") >= k * 200) & (F.col("seq") < (k + 1) * 200)).repartition(2).write.mode("append").parquet(src)
        stream = pending.stream_ring(rocks.readStream.schema(events.schema).parquet(src), 30, flagged, shards=3)
        q = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        sofar = events.where(F.col("seq") < (k + 1) * 200)
        want = sofar.where("anomaly") if flagged else sofar
        want = [r["seq"] for r in want.orderBy(*[F.desc(c) for c in ORDER]).limit(30).collect()]
        assert [r["seq"] for r in pending.ring(rocks, check, 30).collect()] == want
