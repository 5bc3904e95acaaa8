"""Framed logs as a data source: ranges, resynchronising, damage, commit and abort, retention, streams."""

import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import evt1, logs


@pytest.fixture(scope="module")
def known(spark):
    evt1.register(spark)
    return spark


def records(n, seed=1, long=False):
    r = random.Random(seed)
    hard = ["EVT1", "EVT1\u0001\u0000", "EVT1    ", 'EVT1" ,\n', "x" * 40, "ünï"]
    return [json.dumps({"event_id": str(i), "comm": "".join(r.choice(hard) for _ in range(r.randrange(4))), "pad": "p" * (r.randrange(3000) if long else 0)}, ensure_ascii=False) for i in range(n)]


def framed(texts):
    return b"".join(logs.frame(t.encode()) for t in texts)


def read(spark, path, **o):
    return [r["value"] for r in spark.read.format("evt1").options(**o).load(str(path)).orderBy("file", "offset").collect()]


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 10**9])
def test_ranges_have_every_record_once(tmp_path, split):
    """Whatever the cuts: in the middle of headers, or of payloads that hold the magic."""
    texts = records(60)
    (tmp_path / "a.evt1").write_bytes(framed(texts))
    size = os.path.getsize(tmp_path / "a.evt1")
    got = [p.decode() for part in evt1.cut([(str(tmp_path / "a.evt1"), 0, size)], split, False, False) for f, a, b in part.pieces for _, p in evt1.records(f, a, b, False, part.exact)]
    assert got == texts


def test_damage_is_found_wherever_the_cuts_are(tmp_path):
    texts = records(20, 2)
    first, rest = framed(texts[:10]), framed(texts[10:])
    path = str(tmp_path / "a.evt1")
    for junk in (b"EVT2", b"\0" * 9, b"{}"):
        with open(path, "wb") as f:
            f.write(first + junk + rest)
        for split in (5, 100, 10**9):
            with pytest.raises(ValueError, match="no record at byte"):
                [x for part in evt1.cut([(path, 0, os.path.getsize(path))], split, False, False) for p in part.pieces for x in evt1.records(*p, False, False)]
        assert len(list(evt1.records(path, 0, None, True, False))) == 10
    for cut in (1, 5, 11):
        with open(path, "wb") as f:
            f.write((first + rest)[:-cut])
        assert len(list(evt1.records(path, 0, None, False, False))) == 19


def test_long_records_and_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(evt1, "BLOCK", 64)
    texts = records(40, 3, long=True) + ["z" * (17 << 20)] + records(3, 4)
    path = str(tmp_path / "a.evt1")
    with open(path, "wb") as f:
        f.write(framed(texts))
    size = os.path.getsize(path)
    monkeypatch.setattr(evt1, "BLOCK", 1 << 16)
    got = [p.decode() for part in evt1.cut([(path, 0, size)], 1 << 21, False, False) for f, a, b in part.pieces for _, p in evt1.records(f, a, b, False, part.exact)]
    assert got == texts


def test_read_through_spark(known, tmp_path):
    a, b = records(300, 5), records(30, 6)
    (tmp_path / "a.evt1").write_bytes(framed(a))
    (tmp_path / "b.evt1.gz").write_bytes(gzip.compress(framed(b)))
    (tmp_path / "_hidden").write_bytes(b"junk")
    assert read(known, tmp_path, splitBytes=900) == a + b
    assert read(known, f"{tmp_path}/a*") == a and read(known, f"file://{tmp_path}/b.evt1.gz") == b
    assert known.read.format("evt1").option("splitBytes", 900).load(str(tmp_path)).rdd.getNumPartitions() > 5
    assert [json.loads(r["value"])["event_id"] for r in evt1.tail(known, str(tmp_path / "a.evt1"), 3).collect()] == ["299", "298", "297"]
    e = logs.envelopes(known.read.format("evt1").load(str(tmp_path / "a.evt1")))
    assert e.count() == 300 and e.where("comm like '%EVT1%'").count() == sum("EVT1" in json.loads(t)["comm"] for t in a)


def test_round_trip_of_many_files(known, tmp_path):
    df = known.range(5000).select(F.col("id").cast("string").alias("event_id"), F.repeat(F.lit("EVT1"), 3).alias("comm"))
    out = str(tmp_path / "out")
    evt1.payloads(df.repartition(8)).write.format("evt1").option("maxBytes", 200).mode("append").save(out)
    files = [f for f in os.listdir(out)]
    assert len(files) >= 1000 and all(f.endswith(".evt1") for f in files) and all(os.path.getsize(f"{out}/{f}") <= 200 for f in files)
    back = logs.envelopes(known.read.format("evt1").load(out))
    assert back.count() == 5000 and back.select("event_id").distinct().count() == 5000
    assert known.read.format("evt1").load(out).rdd.getNumPartitions() < 50  # small files are read together
    evt1.payloads(df.limit(10)).write.format("evt1").option("compress", "true").mode("append").save(out)
    assert logs.envelopes(known.read.format("evt1").load(out)).count() == 5010
    evt1.payloads(df.limit(7).coalesce(1)).write.format("evt1").mode("overwrite").save(out)
    assert logs.envelopes(known.read.format("evt1").load(out)).count() == 7 and len(os.listdir(out)) == 1


def test_retention(known, tmp_path):
    out = str(tmp_path / "out")
    for i in range(4):
        evt1.payloads(known.range(3).select(F.lit(f"{i}").alias("event_id")).coalesce(1)).write.format("evt1").option("maxFiles", 2).mode("append").save(out)
    assert {json.loads(v)["event_id"] for v in read(known, out)} == {"2", "3"} and len(os.listdir(out)) == 2


def test_a_failed_task_leaves_nothing(known, tmp_path):
    out = str(tmp_path / "out")
    evt1.payloads(known.range(5).select(F.lit("kept").alias("event_id"))).write.format("evt1").mode("append").save(out)
    bad = known.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("string").alias("value"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("evt1").mode("append").save(out)
    assert all(json.loads(v)["event_id"] == "kept" for v in read(known, out)) and not [f for f in os.listdir(out) if f.startswith("_")]


def test_stream_follows_growing_files(known, tmp_path):
    """Whole records only, each once, also of a record that is half written when a batch is planned."""
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    texts = records(50, 7)
    whole = framed(texts)
    ends = [len(framed(texts[:k])) for k in (0, 20, 33, 50)]
    for k, upto in enumerate((ends[1] + 5, ends[2] + 11, ends[3])):
        (src / "a.evt1").write_bytes(whole[:upto])
        if k == 1:
            (src / "b.evt1").write_bytes(framed(["{\"event_id\": \"b\"}"]))
        q = known.readStream.format("evt1").option("splitBytes", 300).load(str(src)).select("value").writeStream.format("evt1").option("checkpointLocation", check).option("maxBytes", 2000).trigger(availableNow=True).start(out)
        q.awaitTermination()
        got = [json.loads(v)["event_id"] for v in read(known, out)]
        assert sorted(got) == sorted([str(i) for i in range((20, 33, 50)[k])] + (["b"] if k else []))


def test_end_of_the_last_whole_record(tmp_path, monkeypatch):
    monkeypatch.setattr(evt1, "BLOCK", 100)
    texts = records(30, 8, long=True)
    whole, path = framed(texts), str(tmp_path / "a.evt1")
    ends = {len(framed(texts[:k])) for k in range(31)}
    for upto in range(0, len(whole), 611):
        with open(path, "wb") as f:
            f.write(whole[:upto])
        want = max(e for e in ends if e <= upto)
        assert evt1.complete(path, upto, 0) == want
        assert evt1.complete(path, upto, max(e for e in ends if e <= want // 2)) == want
