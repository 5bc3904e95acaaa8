import pytest
from pyspark.sql import functions as F

from tidewatch.functions import converter, features, rules
from tidewatch.operators import analytics, native
from tidewatch.sources import logs
from tidewatch.sources.env import env


def test_tokens():
    assert rules.tokens("comm = it's") == ["comm", "=", "it's"] and rules.tokens('comm = a"b') == ["comm", "=", 'a"b']
    assert rules.tokens("comm in (a'b, c)") == ["comm", "in", "(", "a'b", ",", "c", ")"] and rules.tokens("x='a b'") == ["x", "=", "'a b'"]
    assert rules.parse("comm = 'a b'").values == ("a b",) and rules.parse("comm = it's").values == ("it's",)


def test_numbers_and_flags(spark):
    df = spark.createDataFrame([("a", "other", 42, "f", "g"), ("b", "connect", 7, "f", "g"), ("c", None, 1, "f", "g")], "event_id string, syscall_name string, syscall_nr long, flags string, arg_flags string")
    r = rules.load({"groups": {"net": {"syscalls": ["connect"]}}, "rules": [{"name": "n", "group": "net"}]})
    assert {x["event_id"] for x in rules.classify(df, r).collect()} == {"a", "b"}
    assert {x["event_id"] for x in rules.classify(df, r, {}).collect()} == {"b"}
    own = lambda d: d.where(rules.compile_(rules.parse("arg_flags = g"), d.columns)).count()
    assert own(df) == 3 and own(df.drop("arg_flags")) == 0
    assert rules.call_numbers("#define __NR_read 0\nopen 2\n# x\n") == {"read": 0, "open": 2}
    with pytest.raises(ValueError):
        rules.prefilter(df, [{"pid": "1"}] * 25)
    with pytest.raises(ValueError):
        rules.prefilter(df, [{"path": "x"}])
    assert rules.prefilter(df, []).count() == 3


RULES = "groups: {{g: {{syscalls: [{0}]}}}}\nrules: [{{name: r, group: g}}]"


def test_rules_are_read_again(spark, tmp_path):
    import time

    path = tmp_path / "rules.yaml"
    path.write_text(RULES.format("read"))
    f = rules.RuleFile(spark, str(path))
    first = f.current()
    assert first.groups["g"].syscalls == ("read",) and f.current() is first
    path.write_text("rules: [{name: r}]")
    assert f.current() is first and f.error
    time.sleep(0.05)
    path.write_text(RULES.format("open, close"))
    assert f.current().groups["g"].syscalls == ("open", "close") and f.error is None


def test_rules_change_within_a_stream(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text(RULES.format("read"))
    spark.createDataFrame([("a", "read", 0), ("b", "open", 2)], "event_id string, syscall_name string, syscall_nr long").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("event_id string, syscall_name string, syscall_nr long").parquet(str(tmp_path / "in"))
    got = []
    q = rules.classify_stream(src, rules.RuleFile(spark, str(tmp_path / "rules.yaml")), lambda df, _: got.extend(r["event_id"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got == ["a"]


def test_conversion(spark):
    rows = [
        ("1", "OpenAt", {"dirfd": "-100(AT_FDCWD)", "flags": "1", "fd": "3(<f>/etc/passwd)", "res": "3"}, "<", 5, "cat"),
        ("2", "connect", {"fd": "4(<4t>10.0.0.1:55->10.0.0.2:80)", "addrlen": "16"}, ">", 20_000_000_000, "curl"),
        ("3", "mmap", {"arg1": "8(PROT_READ)"}, "<", 7, None),
        ("4", None, {}, None, 8, None),
    ]
    df = spark.createDataFrame(rows, "event_id string, name string, params map<string,string>, direction string, ts_unix_nano long, process string")
    df = df.withColumns({"pid": F.lit(1), "tid": F.lit(None).cast("int"), "uid": F.lit(0), "exploit": F.lit(True), "exploit_times": F.array(F.lit(10.0))})
    df = df.withColumn("containers", F.array(F.struct(F.lit("10.0.0.1").alias("ip"), F.lit(" Victim").alias("role")), F.struct(F.lit("[10.0.0.2]").alias("ip"), F.lit("attacker").alias("role"))))
    got = {r["event_id"]: r for r in converter.convert(df, "h", {"openat": 257}).collect()}
    a, b, c, d = (got[k] for k in "1234")
    assert (a["syscall_name"], a["syscall_nr"], a["arg0"], a["arg1"], a["malicious"], a["tid"]) == ("openat", 257, "-100", "1", False, "0")
    assert a["attributes"] == {"return_value": "3", "flags": "1", "fd_path": "/etc/passwd", "fd_resource_kind": "file"}
    assert (b["malicious"], b["local_role"], b["remote_role"], b["arg1"]) == (True, "victim", "attacker", "16") and b["attributes"]["fd_sock_remote_port"] == "80" and "return_value" not in b["attributes"]
    assert c["attributes"]["flags"] == "8(PROT_READ)" and c["arg1"] == "8" and (d["syscall_name"], d["syscall_nr"], d["arg0"]) == ("", 0, "")


def test_csv(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"f{i}.csv").write_text("eventName,pid,arg1,sin_port,sockaddr,evil\n" + "".join(f"connect,{i}{k},x,{k or ''},s,{k}\n" for k in range(3)))
    rows = logs.labelled_csv(spark, str(tmp_path))
    assert sorted((r["source_file"][-6:], r["source_row"], r["pid"]) for r in rows.collect()) == sorted((f"f{i}.csv", k, f"{i}{k}") for i in range(2) for k in range(3))
    e = {r["event_id"]: r for r in logs.csv_events(logs.network_rows(rows).where("source_file like '%f1.csv'"), "source_row", 100, "p").collect()}
    assert e["p-0"]["arg1"] == "s" and e["p-0"]["attributes"] == {} and e["p-2"]["arg1"] == "x" and e["p-2"]["attributes"] == {"fd_sock_remote_port": "2"} and e["p-2"]["ts_unix_nano"] == 2_000_100 and e["p-2"]["evil"] == 2


@pytest.mark.parametrize("total, share, warm", [(0, 0.1, 0.1), (10, 1.5, 0.1), (10, 0.1, 1.0), (1000, 0.9, 0.0), (10**7, 0.0, 0.0), (100, 0.5, 0.6), (100, 0.6, 0.5)])
def test_samples_that_cannot_be(spark, sf, total, share, warm):
    with pytest.raises(ValueError):
        analytics.select_rows(env(spark, sf), "malicious", ["event_id"], total, share, warm)


def test_quantiles_and_ranks(spark):
    values = [float(x * x % 97) for x in range(500)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, v double")
    s = sorted(v for v in values if v is not None)
    got = analytics.quantiles(df, "v", [0.0, 0.3, 0.999, 1.0])
    want = [s[int(q * 499)] + (s[min(int(q * 499) + 1, 499)] - s[int(q * 499)]) * (q * 499 % 1) for q in (0.0, 0.3, 0.999, 1.0)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))
    assert {r["percent"]: r["value"] for r in analytics.nearest_rank(df, "v", [0, 50, 100]).collect()} == {0: s[0], 50: s[249], 100: s[499]}
    none = df.limit(0)
    assert analytics.quantiles(none, "v", [0.5]) == [] and analytics.nearest_rank(none, "v", [50]).count() == 0 and analytics.downsample(none, 5).count() == 0 and analytics.changes(none, "v").first()[0] == 0
    assert sorted(r["seq"] for r in analytics.downsample(df.where("seq % 2 = 0"), 10).collect()) == [*range(0, 501, 52), 500]


def test_errors_are_no_anomalies(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.99, None), ("a", 2, 2, 0.99, "scoring error: x")], "group_key string, ts_unix_nano long, seq long, scaled double, error string")
    got = {r["seq"]: r for r in native.decide(df, 0.9).collect()}
    assert got[1]["anomaly"] and got[1]["reason"] == "score 0.990 >= 0.900" and not got[2]["anomaly"] and got[2]["score"] == 0 and got[2]["reason"] == "scoring error: x"


def test_sql_functions(spark):
    features.register_sql(spark)
    assert spark.sql("select hash01('') as a, hash01('x') as b").first()["a"] == 0.0
