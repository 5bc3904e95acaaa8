import gzip
import json

import pytest

from tidewatch.sources import logs

EVENTS = [{"event_id": str(i), "syscall_name": "read", "syscall_nr": i, "ts_unix_nano": i * 10**6, "comm": "cat", "attributes": {"fd_path": f"/f{i}"}} for i in range(5)]


def framed(extra=b""):
    return b"".join(logs.frame(json.dumps(e).encode()) for e in EVENTS) + extra


def test_frames():
    assert len(list(logs.frames(framed()))) == 5
    assert len(list(logs.frames(gzip.compress(framed())))) == 5
    assert len(list(logs.frames(framed(b"EVT1\x00")))) == 5
    assert len(list(logs.frames(framed()[:-3]))) == 4
    with pytest.raises(ValueError):
        list(logs.frames(framed(b"EVT2aaaaaaaa")))
    assert len(list(logs.frames(framed(b"EVT2aaaaaaaa"), permissive=True))) == 5
    assert logs.sniff(framed()[:16]) == "evt1" and logs.sniff(gzip.compress(framed())) == "evt1" and logs.sniff(b'{"a"') == "jsonl"


def test_scan_and_sink(spark, tmp_path):
    (tmp_path / "a.evt1").write_bytes(framed())
    (tmp_path / "b.evt1").write_bytes(gzip.compress(framed()))
    e = logs.envelopes(logs.evt1(spark, f"{tmp_path}/*.evt1"))
    assert e.count() == 10
    one = e.where("file like '%a.evt1'")
    assert [r["event_id"] for r in logs.bounded(one, start_ms=1, end_ms=3, skip=1, most=1).collect()] == ["2"]
    logs.write_evt1(one.drop("file", "seq"), str(tmp_path / "out"), max_bytes=300).collect()
    back = logs.envelopes(logs.evt1(spark, f"{tmp_path}/out/*.evt1"))
    assert {r["event_id"] for r in back.collect()} == {str(i) for i in range(5)}


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"_meta": true}\n\nnot json\n{"event_id": "1", "event_name": "open", "pod_name": "p", "syscall_nr": -4}\n')
    r = logs.envelopes(logs.jsonl(spark, str(tmp_path / "x.jsonl"))).collect()
    assert len(r) == 1 and r[0]["syscall_name"] == "open" and r[0]["pod"] == "p" and r[0]["syscall_nr"] == 0 and r[0]["attributes"] == {}


def test_small_scans(spark):
    rows = spark.createDataFrame([("a", 0, 1, 0), ("a", 1, 0, 1), ("", 1, 1, 2), ("b", 1, 0, 3)], "event_id string, sus int, evil int, line int")
    assert {r["event_id"]: r["positive"] for r in logs.labels(rows).collect()} == {"a": False, "b": False}
    assert {r["event_id"]: r["positive"] for r in logs.labels(rows, True).collect()} == {"a": True, "b": True}
    m = logs.metrics(spark.createDataFrame([("# c",), ('m{a="1"} 2',), ('m{a="2"} 3',), ("bad line",)], "value string"))
    assert logs.metric_sum(m, "m").first()[0] == 5 and logs.metric_sum(m, "none").first()[0] is None
    d = spark.createDataFrame([(["open", "0x10", "cat", "5"],)], "d array<string>")
    got = d.select(*[c.alias(k) for k, c in logs.legacy(d["d"]).items()]).first()
    assert got["syscall_nr"] == 16 and got["pid"] == 5 and got["uid"] is None
    s = spark.createDataFrame([("x", None, "1.5"), ("bad", "2", "3"), (None, None, None), (None, "2", "3"), ("0.5", "2", None)], "score string, score_scaled string, score_raw string")
    assert sorted(r["value"] for r in logs.scored(s).collect()) == [0.5, 2.0]


def test_first_recordings(spark):
    e = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("c", 3), ("a", 4)], "recording_name string, seq long")
    assert sorted(r["seq"] for r in logs.first_recordings(e, 2).collect()) == [0, 1, 2]
