"""Ordered groups over many ranges: the same rows as plain loops, however many ranges there are."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import native, scan

SCHEMA = "k string, ts_unix_nano long, seq long, x double, path_hash double, file_tmp_path double, raw double, state string, __mine string"


def rows(n=600, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x = None if r.random() < 0.05 else r.random() * (1e6 if r.random() < 0.02 else 1)
        out.append((r.choice(["a", "a", "a", "b", None]), r.randrange(200) * 10**9, i, x, r.randrange(30) / 30, r.choice([0.0, 1.0, None]), r.choice([None, 0.0, 0.5, 1.0, r.random() * 9]), r.choice(["u", "v", None]), "kept"))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def groups(seed=1):
    by = {}
    for r in sorted(rows(seed=seed), key=lambda r: r[1:3]):
        by.setdefault(r[0], []).append(r)
    return by


PARTS = [1, 2, 7, 150]


@pytest.mark.parametrize("parts", PARTS)
def test_zscore(df, parts):
    want = {}
    for rs in groups().values():
        for i, r in enumerate(rs):
            past = [q[3] for q in rs[:i] if q[3] is not None]
            z = 0.0
            if i >= 10 and r[3] is not None and past:
                m = math.fsum(past) / len(past)
                var = math.fsum((v - m) ** 2 for v in past) / (len(past) - 1) if len(past) > 1 else 0.0
                z = abs(r[3] - m) / math.sqrt(max(var, 1e-6))
            want[r[2]] = z
    got = native.zscore(df, ["x"], ["k"], min_count=10, parts=parts)
    assert got.columns == [*df.columns, "raw"] or set(got.columns) == {*df.columns}
    for r in got.collect():
        assert abs(r["raw"] - want[r["seq"]]) <= 1e-9 * max(1, want[r["seq"]]) and r["__mine"] == "kept"


@pytest.mark.parametrize("parts", PARTS)
def test_surprisal(df, parts):
    one = {r["seq"]: r["raw"] for r in native.surprisal(df, ["path_hash", "x", "file_tmp_path"], ["k"], bins=64, parts=1).collect()}
    got = {r["seq"]: r["raw"] for r in native.surprisal(df, ["path_hash", "x", "file_tmp_path"], ["k"], bins=64, parts=parts).collect()}
    assert got == one
    want = {}
    for rs in groups().values():
        for i, r in enumerate(rs):
            past = [round(q[4] * 30) for q in rs[:i]]
            size = max(2.0, len(set(past)) + 1.0)
            want[r[2]] = max(0.0, -math.log((past.count(round(r[4] * 30)) + 1) / (len(past) + size)) - math.log(size))
    for r in native.surprisal(df, ["path_hash"], ["k"], parts=parts).collect():
        assert abs(r["raw"] - want[r["seq"]]) < 1e-9


@pytest.mark.parametrize("window, parts", [(1, 3), (2, 1), (5, 7), (64, 150), (100, 2), (4096, 7)])
def test_percentile(df, window, parts):
    want = {}
    for rs in groups().values():
        xs = [math.log1p(max(r[6] or 0.0, 0.0)) for r in rs]
        for i, r in enumerate(rs):
            last = xs[max(0, i - window) : i]
            want[r[2]] = sum(v <= xs[i] for v in last) / len(last) if last and len(last) >= min(3, window) else 0.0
    for r in native.percentile(df, ["k"], "raw", window, min(3, window), parts).collect():
        assert abs(r["percentile"] - want[r["seq"]]) < 1e-12


@pytest.mark.parametrize("parts", PARTS)
def test_numbers_runs_and_sums(df, parts):
    numbers, runs, sums = {}, {}, {}
    for rs in groups().values():
        run = total = 0
        for i, r in enumerate(rs):
            run += i == 0 or r[7] is None or rs[i - 1][7] is None or rs[i - 1][7] != r[7]
            total += r[4]
            numbers[r[2]], runs[r[2]], sums[r[2]] = i + 1, run, total
    assert {r["seq"]: r["row"] for r in scan.numbered(df, ["k"], native.ORDER, "row", parts).collect()} == numbers
    assert {r["seq"]: r["run"] for r in native.runs(df, ["k"], F.col("state"), parts).collect()} == runs
    assert all(abs(r["s"] - sums[r["seq"]]) < 1e-9 for r in scan.summed(df, ["k"], native.ORDER, F.col("path_hash"), "s", parts).collect())
    decided = native.decide(df.withColumns({"group_key": F.coalesce("k", F.lit("none")), "scaled": F.col("path_hash")}), 0.5, "scaled", 25, parts=parts)
    assert {r["seq"] for r in decided.where("suppressed").collect()} == {s for s, n in numbers.items() if n <= 25}


def test_no_window_spans_a_group(df):
    """Every window but those over one row a range is dealt by the range, too."""
    for out in (native.zscore(df, ["x"], ["k"], parts=9), native.surprisal(df, ["path_hash", "x"], ["k"], parts=9), native.percentile(df, ["k"], parts=9), native.runs(df, ["k"], F.col("state"), 9)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        found = re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]\n", plan)
        assert found
        for by, order in found:
            assert "__part" in by or "__block" in by or order.startswith("__part"), (by, order)


def test_empty_and_bounds(spark, df):
    none = df.limit(0)
    assert native.zscore(none, ["x"], ["k"]).collect() == [] and native.surprisal(none, ["x"], ["k"]).collect() == [] and native.percentile(none, ["k"]).collect() == []
    values = [(float(v),) for v in range(-5, 700)] + [(None,)]
    for n in (0, 1, 5, 127, 128, 600):
        bounds = [float(i) for i in range(n)]
        got = spark.createDataFrame(values, "v double").select("v", scan.bisect(F.col("v"), bounds).alias("b")).collect()
        assert all(r["b"] == (0 if r["v"] is None else sum(b <= r["v"] for b in bounds)) for r in got)
    assert len(scan.bounds(df, "seq", 8)) in (6, 7) and scan.bounds(df, "seq", 1) == [] and len(scan.bounds(df, "seq", rows=10)) > 40


def _runs_by_hand(rows):
    """False-alarm runs by the rules as they are told, row by row."""
    by, total = {}, 0
    for r in sorted(rows, key=lambda r: r[3:5]):
        if r[1] is not None:
            by.setdefault(r[0], []).append((r[1], bool(r[2])))
    for rs in by.values():
        exploit, run = False, None
        for expected, predicted in rs:
            began = expected and not exploit
            exploit |= expected
            if predicted and not expected:
                run = run or ("normal", "exploit")[exploit]
                continue
            if run and not (began and run == "normal"):
                total += 1
            run = None
        total += bool(run)
    return total


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_false_alarm_runs(spark, parts):
    from tidewatch.operators import analytics

    r = random.Random(6)
    rows = [(f"r{r.randrange(4)}", r.choice([False, False, False, True, None]), r.random() < 0.5, i // 2 * 10**9, i) for i in range(500)]
    df = spark.createDataFrame(rows, "recording string, expected boolean, predicted boolean, ts_unix_nano long, seq long")
    assert analytics.stream_performance(df, parts).first()["false_alarm_runs"] == _runs_by_hand(rows)
    late = [(rec, bool(e) and i > 300, p, t, i) for rec, e, p, t, i in rows]
    got = analytics.stream_performance(spark.createDataFrame(late, df.schema), parts).first()
    assert got["false_alarm_runs"] == _runs_by_hand(late) and got["tp"] + got["fp"] + got["fn"] + got["tn"] == 500


def test_a_task_has_no_more_ranges_as_rows_grow(spark):
    """More ranges than shuffle partitions: as many tasks, so that a task's rows are those of a range or so, with the same ranks."""
    rows = [("g", i, i, ((i * 7919) % 101) / 10) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, ts_unix_nano long, seq long, raw double")
    few, many = (native.percentile(df, ["k"], window=16, warmup=4, parts=n) for n in (2, 20))
    assert scan.numbered(df, ["k"], native.ORDER, parts=20).rdd.getNumPartitions() >= 20
    assert sorted(few.collect()) == sorted(many.collect())


def test_a_report_runs_what_gives_the_scores_once(spark):
    from tidewatch.operators import analytics

    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            ran.add(len(pdf))
            yield pdf

    scores = spark.range(1000).selectExpr("id / 1000.0D as scaled").mapInPandas(seen, "scaled double")
    got = analytics.diagnostic_report(scores).first()
    assert got["n"] == 1000 and abs(got["tail_gap"] - 0.48951) < 1e-6 and ran.value == 1000
