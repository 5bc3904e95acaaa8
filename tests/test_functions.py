import base64

from pyspark.sql import functions as F

from tidewatch.functions import converter, features
from tidewatch.operators import analytics, native

SCHEMA = "event_id string, hostname string, syscall_name string, syscall_nr long, pid string, tid string, uid string, arg0 string, arg1 string, ts_unix_nano long, attributes map<string,string>"


def one(spark, **changes):
    row = {"event_id": "e", "hostname": "", "syscall_name": "openat", "syscall_nr": 2, "pid": "1", "tid": "1", "uid": "0", "arg0": "0", "arg1": "0", "ts_unix_nano": 1_700_000_000_000_000_000, "attributes": {}} | changes
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    return features.extract(df, features.names()).first()


def test_golden_features(spark):
    r = one(spark, attributes={"fd_path": "/etc/passwd", "fd_sock_family": "AF_INET", "fd_sock_remote_port": "443", "return_value": "-13"})
    assert abs(r["path_depth_norm"] - 2 / 20) < 1e-12 and abs(r["net_socket_family_norm"] - 2 / 10) < 1e-12 and abs(r["net_dport_norm"] - 443 / 65535) < 1e-12
    assert abs(r["week_of_month_norm"] - 1 / 3) < 1e-12
    assert r["return_success"] == 0.0 and r["file_sensitive_path"] == 1.0 and r["file_tmp_path"] == 0.0
    assert all(0 <= r[n] <= 1 for n in features.names() if not n.startswith("day_cycle"))


def test_junk_is_zero(spark):
    r = one(spark, pid="junk", arg0=None, attributes={"return_value": "x"})
    assert r["pid_norm"] == 0 and r["arg0_norm"] == 0 and r["return_success"] == 1.0 and r["path_hash"] == 0


def test_flags(spark):
    import os
    import socket

    o = lambda *n: sum({getattr(os, x) for x in n})
    want = [
        (257, o("O_WRONLY", "O_TRUNC", "O_CREAT"), "O_WRONLY|O_CREAT|O_TRUNC"), (2, 0, "O_RDONLY"), (437, o("O_RDWR", "O_EXCL", "O_CLOEXEC"), "O_RDWR|O_CLOEXEC|O_EXCL"), (257, 3, "0"), (257, o("O_NONBLOCK"), "O_RDONLY"),
        (2, o("O_DSYNC"), "O_RDONLY|O_SYNC|O_DSYNC"), (2, 3 + o("O_APPEND", "O_DIRECTORY", "O_NOFOLLOW"), "O_APPEND|O_DIRECTORY|O_NOFOLLOW"),
        (41, socket.SOCK_STREAM | socket.SOCK_CLOEXEC | socket.SOCK_NONBLOCK, "SOCK_STREAM|SOCK_CLOEXEC|SOCK_NONBLOCK"), (41, 4, "SOCK_RDM"), (41, 6, "SOCK_DCCP"), (41, 10, "SOCK_PACKET"), (41, 7 | socket.SOCK_NONBLOCK, "7|SOCK_NONBLOCK"), (0, 1, None),
    ]
    df = spark.createDataFrame([(nr, str(v), t) for nr, v, t in want] + [(2, "x", None), (None, "1", None), (2, None, None)], "nr int, v string, want string")
    features.register_sql(spark)
    for r in df.select("*", features.decode_flags(F.col("nr"), F.col("v")).alias("got"), F.expr("flags_text(nr, try_cast(v as bigint))").alias("sql")).collect():
        assert r["got"] == r["want"] == r["sql"], r


def test_the_sets_of_features_can_be_made(spark):
    events = spark.createDataFrame([ROW], ROW_SCHEMA) if "ROW_SCHEMA" in globals() else None
    for algorithm in ("freq1d", "copulatree", "knn", "loda_ema", "sequence_mlp", "sequence_transformer"):
        wanted = features.features_for(algorithm)
        assert set(wanted) <= set(features.names())
        if events is not None:
            features.extract(events, list(wanted))


def test_converter(spark):
    text = base64.b64encode(b"/etc/hosts").decode()
    df = spark.createDataFrame([(text, "36(<f>/p/q)", "7(anything)", {"fd": "36(<f>/p/q)", "tuple": ""}, "5(<4t>10.0.0.1:80->10.0.0.2:443)", "[::1]:22")], "b string, fd string, n string, p map<string,string>, s string, h string")
    r = df.select(converter.maybe_base64(F.col("b")), converter.strip_fd(F.col("fd")), converter.strip_number(F.col("n")), converter.fd_path(F.col("p")), converter.socket_tuple(F.col("s")), converter.host_port(F.col("h")), converter.strip_fd(F.col("n"))).first()
    assert r[0] == "/etc/hosts" and r[1] == "36" and r[2] == "7" and r[3] == "/p/q" and r[6] == "7(anything)"
    assert r[4]["fd_sock_remote_port"] == "443" and r[4]["fd_resource_kind"] == "tcp" and r[5]["host"] == "::1" and r[5]["port"] == "22"


def test_merge_and_labels(spark):
    df = spark.createDataFrame([({"a": "", "b": "1"}, {"a": "2", "b": "3"}, True, [2.0, 1.0], 1_500_000_000)], "x map<string,string>, y map<string,string>, e boolean, t array<double>, ts long")
    r = df.select(converter.merge_first([F.col("x"), F.col("y")]), converter.malicious(F.col("e"), F.col("t"), F.col("ts"))).first()
    assert dict(r[0]) == {"a": "2", "b": "1"} and r[1] is True


def test_stream_performance(spark):
    rows = [("r1", False, True, 1), ("r1", False, True, 2), ("r1", False, False, 3), ("r2", False, True, 4), ("r2", True, False, 5), ("r2", True, True, 7), ("r2", False, True, 8), ("r2", None, True, 9)]
    df = spark.createDataFrame([(a, b, c, t * 10**9, t) for a, b, c, t in rows], "recording string, expected boolean, predicted boolean, ts_unix_nano long, seq long")
    r = analytics.stream_performance(df).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 4, 1, 1) and r["detected"] == 1 and r["mean_delay_s"] == 2.0
    assert r["false_alarm_runs"] == 2  # r1's run and the exploit phase's; the normal run that the exploit cuts off is not counted


def test_aggregations(spark):
    row = spark.range(1).select(*[native.aggregate([F.lit(1.0), F.lit(4.0), F.lit(2.0)], h, 2).alias(h) for h in ("sum", "mean", "topk_mean")]).first()
    assert row["sum"] == 7 and abs(row["mean"] - 7 / 3) < 1e-12 and row["topk_mean"] == 3
