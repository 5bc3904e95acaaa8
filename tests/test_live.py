"""Models in and out of running streams, metrics while they run, and many patterns at once."""

import fnmatch
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import patterns, rules
from tidewatch.operators import analytics
from tidewatch.sources import logs
from tidewatch.streaming import keyed, live, pending

EVENTS = "event_group string, event_id string, ts_unix_nano long, seq long, a double, b double"
NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield pending.configure(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def events(n=300):
    r = random.Random(2)
    return [(r.choice(["g", "h"]), f"e{i}", i * 10**9, i, r.random(), r.random() if i % 50 else 9.0) for i in range(n)]


def _stream(spark, tmp_path, name, rows, src, start=None):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)
    s = live.scores(spark.readStream.schema(EVENTS).parquet(src), "zscore", NAMES, window=64, warmup=8, start=start)
    q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start(str(tmp_path / f"out-{name}"))
    q.awaitTermination()
    return {(r["event_id"], r["raw"], r["percentile"]) for r in spark.read.parquet(str(tmp_path / f"out-{name}")).collect()}


def test_stop_export_import_and_go_on(rocks, tmp_path):
    rows = events()
    want = {(r["event_id"], r["raw"], r["percentile"]) for r in keyed.score(rocks.createDataFrame(rows, EVENTS), "zscore", NAMES, window=64, warmup=8).collect()}
    first = _stream(rocks, tmp_path, "one", rows[:90], str(tmp_path / "in1"))
    first = _stream(rocks, tmp_path, "one", rows[90:160], str(tmp_path / "in1"))  # a second batch of the same stream
    held = live.models(rocks, str(tmp_path / "check-one"))
    held.write.parquet(str(tmp_path / "models"))
    held = rocks.read.parquet(str(tmp_path / "models"))
    assert {r["event_group"]: r["events"] for r in held.collect()} == {g: sum(x[0] == g for x in rows[:160]) for g in "gh"}
    rest = _stream(rocks, tmp_path, "two", rows[160:], str(tmp_path / "in2"), held)
    assert first | rest == want and not first & rest
    # a table goes on from the stream's models, and a stream from a table's
    table = {(r["event_id"], r["raw"], r["percentile"]) for r in keyed.resume(rocks.createDataFrame(rows[160:], EVENTS), held, NAMES).collect()}
    assert first | table == want
    trained = keyed.train(rocks.createDataFrame(rows[:160], EVENTS), "zscore", NAMES, window=64, warmup=8)
    trained.write.parquet(str(tmp_path / "trained"))
    assert first | _stream(rocks, tmp_path, "three", rows[160:], str(tmp_path / "in3"), rocks.read.parquet(str(tmp_path / "trained"))) == want


def test_counters_of_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "metrics.txt")
    df = spark.range(300).select(
        F.element_at(F.array(F.lit("file"), F.lit('net"\\x')), (F.col("id") % 2 + 1).cast("int")).alias("event_group"), (F.col("id") % 7 == 0).alias("anomaly"), F.when(F.col("id") % 11 == 0, "scoring error: x").otherwise("fine").alias("reason"), (F.col("id") * 10**9).alias("ts_unix_nano"))
    counters = live.Counters(("file", 'net"\\x'), path=out)
    spark.streams.addListener(counters)
    try:
        for k in range(3):
            df.where((F.col("ts_unix_nano") >= k * 100 * 10**9) & (F.col("ts_unix_nano") < (k + 1) * 100 * 10**9)).coalesce(1).write.mode("append").parquet(src)
            q = counters.observe(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            q.awaitTermination()
        until = time.time() + 20
        while counters.totals.get(("events", ""), 0) < 300 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    for r in analytics.counters(df).collect():
        g = r["event_group"]
        assert (counters.totals["events", g], counters.totals["anomalies", g], counters.totals["errors", g], counters.last[g]) == (r["events"], r["anomalies"], r["errors"], r["last"])
    m = logs.metrics(spark.read.text(out)).collect()
    assert {(r["name"], r["labels"]): r["value"] for r in m}["tidewatch_events_total", ""] == 300
    said = {r["g"]: r["value"] for r in spark.createDataFrame(m).where("name = 'tidewatch_anomalies_total' and labels <> ''").select(logs.label(F.col("labels"), "group").alias("g"), "value").collect()}
    assert said == {g: counters.totals["anomalies", g] for g in counters.groups}
    assert open(out).read().count("# HELP") == open(out).read().count("# TYPE") == 4


def test_exposition(spark):
    m = spark.createDataFrame([("b_total", 2.0, 'x"y'), ("a", 1.5, "p\\q\nr"), ("a", 1.0, "m")], "name string, value double, mode string").withColumn("labels", logs.labelled(mode=F.col("mode")))
    lines = [r[0] for r in logs.exposition(m, {"a": ("gauge", "Of\nwhat")}).collect()]
    assert lines == ["# HELP a Of\\nwhat", "# TYPE a gauge", 'a{mode="m"} 1', 'a{mode="p\\\\q\\nr"} 1.5', "# TYPE b_total untyped", 'b_total{mode="x\\"y"} 2']
    back = logs.metrics(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r[0] for r in back.select(logs.label(F.col("labels"), "mode")).collect()} == {'x"y', "m", "p\\q\nr"}
    assert logs.chosen(back, "a", "mode").first()[0] == "m" and logs.chosen(back, "none", "mode").first()[0] is None and logs.metric_sum(back, "a").first()[0] == 2.5


def test_patterns(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("ab/*?") for _ in range(r.randrange(0, 6)))
    pats = list(dict.fromkeys([word() for _ in range(300)] + ["/a[ab]*", "[!a]*b", "*", "", "/a/b", "/a*", "/a?"]))
    paths = list({"".join(r.choice("ab/*") for _ in range(r.randrange(0, 7))) for _ in range(200)} | {"/a/b", "", "/a\nb"})
    df = spark.createDataFrame([(p,) for p in paths] + [(None,), (paths[0],)], "path string")
    ok = lambda p, w: p == w or fnmatch.fnmatchcase(p, w)
    got = {(x["path"], x["pattern"]) for x in patterns.fits(df, patterns.table(spark, pats), "path").collect()}
    assert got == {(p, w) for p in paths for w in pats if ok(p, w)}
    firsts = patterns.first(df, patterns.table(spark, pats), "path").collect()
    assert len(firsts) == len(paths) + 2 and all(x["pattern"] == (next((w for w in pats if ok(x["path"], w)), None) if x["path"] is not None else None) for x in firsts)
    assert patterns.fits(df, patterns.table(spark, []), "path").collect() == []
    values = ("/a", "b", "ab/", "/a", "")
    held = df.select("path", patterns.starts(F.col("path"), values[:-1]).alias("s"), patterns.starts(F.col("path"), values).alias("any"), patterns.starts(F.col("path"), ()).alias("none")).collect()
    assert all(x["s"] == (x["path"].startswith(values[:-1]) if x["path"] is not None else None) and x["any"] is (True if x["path"] is not None else None) and x["none"] is False for x in held)


def test_many_prefixes_in_a_rule(spark):
    dirs = tuple(f"/d{i}/" for i in range(10_000))
    e = spark.createDataFrame([("a", {"fd_path": "/d777/x"}), ("b", {"fd_path": "/e1/"}), ("c", {})], "event_id string, attributes map<string,string>")
    held = lambda t: "".join(sorted(r[0] for r in e.where(rules.compile_(rules.parse(t, {"dirs": dirs}), e.columns)).collect()))
    assert held("attributes.fd_path startswithin (dirs)") == "a" and held("not attributes.fd_path startswithin (dirs)") == "bc"
