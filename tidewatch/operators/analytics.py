"""Evaluation, comparison, duplicates, distributions, capacity and search over scored events."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import patterns as indexed
from tidewatch.functions.features import hash01_raw
from tidewatch.operators import scan
from tidewatch.operators.native import ORDER


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def confusion(labels: DataFrame, flagged: DataFrame) -> DataFrame:
    """labels: event_id, positive. flagged: event_id. One row of counts and rates over all labelled events."""
    hit = labels.join(flagged.select("event_id").distinct().withColumn("f", F.lit(True)), "event_id", "left")
    f, p = F.coalesce("f", F.lit(False)), F.col("positive")
    n = hit.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in (("tp", f & p), ("fp", f & ~p), ("fn", ~f & p), ("tn", ~f & ~p))])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = n.withColumn("precision", _share(tp, tp + fp)).withColumn("recall", _share(tp, tp + fn)).withColumn("accuracy", _share(tp + tn, tp + fp + fn + tn)).withColumn("flagged_rate", _share(tp + fp, tp + fp + fn + tn))
    return n.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def stream_performance(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df: recording, expected, predicted, ts_unix_nano, seq. One row of metrics over a recorded stream.

    Rows without a label don't count. From its first malicious row on, a recording is in its exploit phase. Runs of
    false alarms are closed by any other row, and at the end of the recording; but a run of the normal phase that
    the exploit cuts off is not counted. So runs are the false alarms with another row behind them, less one if the row
    before the first malicious row is one, and one more if the last row is: all aggregates, once each row
    knows the one before it, which goes by ranges of time (``scan``), not by whole recordings."""
    df = df.where("expected is not null").withColumn("fa", F.col("predicted") & ~F.col("expected"))
    df = scan.last_states(df, ["recording"], ORDER, F.col("fa"), "before", parts)
    was, now, at = F.coalesce(F.col("before.v"), F.lit(False)), F.coalesce("fa", F.lit(False)), F.struct(*ORDER)
    by = df.groupBy("recording").agg(
        F.max("expected").alias("exploit"), F.min(F.when(F.col("expected"), F.col("ts_unix_nano"))).alias("began"),
        F.min(F.when(F.col("expected") & F.col("predicted"), F.col("ts_unix_nano"))).alias("caught"),
        F.max(F.col("fa")).alias("false_alarm"), F.count_if(was & ~now).alias("ended"), F.min_by(was, F.when(F.col("expected"), at)).alias("cut_off"), F.max_by(now, at).alias("at_end"),
        *[F.sum(c.cast("long")).alias(k) for k, c in (("tp", F.col("predicted") & F.col("expected")), ("fp", F.col("fa")), ("fn", ~F.col("predicted") & F.col("expected")), ("tn", ~F.col("predicted") & ~F.col("expected")))],
    )
    by = by.withColumn("fp_runs", F.col("ended") - F.coalesce("cut_off", F.lit(False)).cast("long") + F.col("at_end").cast("long"))
    n = by.agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.sum(F.col("exploit").cast("long")).alias("exploits"),
        F.sum(F.col("caught").isNotNull().cast("long")).alias("detected"), F.sum(F.col("false_alarm").cast("long")).alias("recordings_with_false_alarm"),
        F.sum("fp_runs").alias("false_alarm_runs"), F.avg((F.col("caught") - F.col("began")) / 1e9).alias("mean_delay_s"),
    )
    return n.withColumn("detection_rate", _share(F.col("detected"), F.col("exploits")))


def exact_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    n = df.groupBy(*columns).count()
    return n.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"), F.count(F.lit(1)).alias("distinct_rows"))


def near_duplicates(df: DataFrame, columns: list[str], dropped: int) -> DataFrame:
    """How many rows have another that differs in at most ``dropped`` columns but not in none: rows go out under each
    reduced form, and forms that several full rows share mark theirs."""
    one = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("times")).withColumn("full", F.md5(F.to_json(F.struct(*columns))))
    forms = [F.md5(F.concat_ws("\x1f", F.lit(i), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns if c not in gone])) for i, gone in enumerate(combinations(columns, dropped))]
    rows = one.select("full", "times", F.explode(F.array(*forms)).alias("form"))
    shared = rows.groupBy("form").agg(F.min("full").alias("a"), F.max("full").alias("b")).where("a <> b").select("form")
    return rows.join(shared, "form", "left_semi").select("full", "times").distinct().agg(F.coalesce(F.sum("times"), F.lit(0)).alias("rows"))


#: Ranges that a column is cut into where ranks are needed.
RANGES = 128


def _bounds(df: DataFrame, column: str) -> tuple[list, int]:
    """Bounds of ranges that hold about as many rows each (a value that fills several is one of its own), and how many
    values aren't null; in one pass."""
    at = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    got = df.agg(F.percentile_approx(column, at, F.lit(10_000)), F.count(column)).first()
    return sorted(set(got[0] or [])), got[1]


def _range(bounds: list, column: str) -> Column:
    """The number of the range a value is in."""
    return scan.bisect(F.col(column), bounds)


def cumulated(df: DataFrame, column: str, bounds: list | None = None) -> DataFrame:
    """value, c, upto: each different value that isn't null, how often it comes, and how many are not larger. Counts are
    summed up within ranges of values, and across ranges over one row a range."""
    by = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    by = by.withColumn("range__", _range(_bounds(df, column)[0] if bounds is None else bounds, "value"))
    before = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by.groupBy("range__").agg(F.sum("c").alias("s")).select(F.col("range__").alias("r"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("range__").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    out = by.join(F.broadcast(ahead), F.col("range__") == F.col("r"))  # RANGES rows
    return out.select("value", "c", (F.col("ahead") + F.sum("c").over(within)).alias("upto"))


def _at(df: DataFrame, column: str, places: list[int], bounds: list) -> dict[int, float]:
    """The sorted column's values at these places. Rows are counted by range of values, which tells in which ranges the
    places are; only the values of these ranges are sorted."""
    if not places:
        return {}
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), _range(bounds, column).alias("range__"))
    counts = sorted((r["range__"], r["n"]) for r in rows.groupBy("range__").agg(F.count(F.lit(1)).alias("n")).collect())  # RANGES rows
    local, ahead, left = [], 0, sorted(set(places))
    for r, n in counts:
        local += [(r, p - ahead, p) for p in left if ahead <= p < ahead + n]
        ahead += n
    by = rows.where(F.col("range__").isin(sorted({r for r, _, _ in local}))).groupBy("range__", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("range__").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    here = F.array(*[F.when((F.col("range__") == r) & (F.lit(k) < F.col("upto")) & (F.lit(k) >= F.col("upto") - F.col("c")), F.lit(p)) for r, k, p in local])
    found = by.withColumn("upto", upto).withColumn("places", F.array_compact(here)).where(F.size("places") > 0)
    return {p: r["value"] for r in found.select("places", "value").collect() for p in r["places"]}


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact ones, interpolated between neighbours; none of an empty column."""
    bounds, n = _bounds(df, column)
    if not n:
        return []
    spots = [(int(s * (n - 1)), s * (n - 1) - int(s * (n - 1))) for s in shares]
    got = _at(df, column, [p for i, _ in spots for p in (i, min(i + 1, n - 1))], bounds)
    return [float(got[i] + (got[min(i + 1, n - 1)] - got[i]) * f) for i, f in spots]


def nearest_rank(df: DataFrame, column: str, percents: list[float]) -> DataFrame:
    """percent, value: the sorted value at index floor(p / 100 * (n - 1))."""
    bounds, n = _bounds(df, column)
    spots = [(float(p), int(p / 100.0 * (n - 1))) for p in percents] if n else []
    got = _at(df, column, [i for _, i in spots], bounds)
    kind = df.schema[column].dataType.simpleString()
    return df.sparkSession.createDataFrame([(p, got[i]) for p, i in spots], f"percent double, value {kind}")


def summary(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    q = quantiles(df, column, shares) or [None] * len(shares)
    s = df.agg(F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean", "std")], *[F.round(F.lit(v).cast("double"), 6).alias(f"q{i}") for i, v in enumerate(q)])


def diagnostic_report(scores: DataFrame, column: str = "scaled", facts: dict[str, float] | None = None) -> DataFrame:
    """One row: n, std, tail_gap (99th less 50th percentile), issues and positives (arrays of text), verdict. facts: of
    the model, as ``keyed.diagnose`` gives them: accepted_rate, signal_corr, nonzero_ratio, projection_variance."""
    scores = scores.select(column).persist()  # read four times; whatever gives the scores runs once
    q, facts = quantiles(scores, column, [0.5, 0.99]) or [None, None], facts or {}
    gap = F.lit(q[1] - q[0] if q[0] is not None else None).cast("double")
    checks = [(F.col("std") < 0.03, "scores spread little", "scores spread"), (gap < 0.08, "the upper tail is weak", "there is an upper tail")]
    for name, bad, no, yes in (
        ("accepted_rate", lambda v: v < 0.05 or v > 0.98, "the memory takes nearly all or nothing", "the memory is selective"), ("signal_corr", lambda v: abs(v) < 0.2, "the memory's distance says little of the score", "the memory's distance carries the score"),
        ("nonzero_ratio", lambda v: v < 0.001, "histograms are nearly empty", "histograms are filled"), ("projection_variance", lambda v: v < 1e-4, "projections have collapsed", "projections vary"),
    ):
        if name in facts:
            checks.append((F.lit(bad(facts[name])), no, yes))
    held = [F.coalesce(c, F.lit(False)) for c, _, _ in checks]
    pick = lambda cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    s = scores.agg(F.count(column).alias("n"), F.stddev_pop(column).alias("std")).select("n", "std", gap.alias("tail_gap"), *[h.alias(f"h{i}") for i, h in enumerate(held)])
    s = s.withColumn("issues", pick([F.when(F.col(f"h{i}"), no) for i, (_, no, _) in enumerate(checks)])).withColumn("positives", pick([F.when(~F.col(f"h{i}"), yes) for i, (_, _, yes) in enumerate(checks)]))
    verdict = F.when((F.size("issues") >= 3) & (F.size("positives") <= 2), "weak").when(F.size("positives") >= 3, "meaningful").otherwise("mixed")
    return s.select("n", F.round("std", 6).alias("std"), F.round("tail_gap", 6).alias("tail_gap"), "issues", "positives", verdict.alias("verdict"))


def changes(df: DataFrame, column: str, seq: str = "seq") -> DataFrame:
    """One row: in how many places of the order of seq the column is another than just before, the first row included.
    Rows are dealt by ranges of seq; the first and last row of each range meet those of its neighbours."""
    d = df.select(F.col(seq).alias("seq"), F.col(column).alias("v"))
    d = d.withColumn("range__", _range(_bounds(d, "seq")[0], "seq"))
    w = Window.partitionBy("range__").orderBy("seq")
    inner = d.withColumn("new", (F.row_number().over(w) > 1) & ~F.lag("v").over(w).eqNullSafe(F.col("v")))
    by = inner.groupBy("range__").agg(F.sum(F.col("new").cast("long")).alias("n"), F.min_by(F.struct("v"), "seq").alias("head"), F.max_by(F.struct("v"), "seq").alias("last"))
    across = Window.orderBy("range__")  # a row a range
    by = by.withColumn("edge", (F.row_number().over(across) == 1) | ~F.lag("last").over(across).eqNullSafe(F.col("head")))
    return by.agg(F.coalesce(F.sum(F.col("n") + F.col("edge").cast("long")), F.lit(0)).alias("changes"))


def or_flag(events: DataFrame, ids: DataFrame, flag: str = "anomaly") -> DataFrame:
    """The events, flagged if they are already or their id is among ``ids`` (event_id)."""
    named = ids.select(F.col("event_id").alias("flagged_id")).distinct()
    out = events.join(named, F.col("event_id") == F.col("flagged_id"), "left")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.col("flagged_id").isNotNull()).drop("flagged_id")


def matched_patterns(events: DataFrame, patterns: list[str], path: str = "fd_path") -> DataFrame:
    """pattern, paths: those of the patterns that some path equals or matches, and how many different ones do."""
    table = indexed.table(events.sparkSession, patterns)
    return indexed.fits(events, table, path).groupBy("pattern").agg(F.count(F.lit(1)).alias("paths"))


def unmatched_patterns(events: DataFrame, patterns: list[str], path: str = "fd_path") -> DataFrame:
    """pattern: those that no path equals or matches."""
    table = indexed.table(events.sparkSession, patterns)
    return table.join(indexed.fits(events, table, path), "pattern", "left_anti").select("pattern")


def index_of(events: DataFrame, event_id: str) -> DataFrame:
    """seq of the first event with this id; null if there is none."""
    return events.where(F.col("event_id") == event_id).agg(F.min("seq").alias("seq"))


def in_time(events: DataFrame, path: str = "fd_path") -> DataFrame:
    """By time, then path; missing paths first."""
    return events.orderBy("ts_unix_nano", F.coalesce(path, F.lit("")), "seq")


def select_rows(rows: DataFrame, positive: str, key: list[str], total: int, positive_share: float, warmup_share: float, seed: str = "s") -> DataFrame:
    """A sample without replacement of ``total`` rows with so many positives, with ``position``: first a warm-up without
    positives, then the rest shuffled. Order and choice come from a hash of seed and key. What can't be done raises."""
    if total <= 0:
        raise ValueError("the total must be above 0")
    if not 0 <= positive_share <= 1:
        raise ValueError("the share of positives is from 0 to 1")
    if not 0 <= warmup_share < 1:
        raise ValueError("the share of the warm-up is from 0 to below 1")
    want = round(total * positive_share)
    others, warm = total - want, int(total * warmup_share)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(positive).cast("long")), F.lit(0)).alias("p")).first()
    if want > n["p"]:
        raise ValueError(f"{want} positives are asked for, there are {n['p']}")
    if others > n["n"] - n["p"]:
        raise ValueError(f"{others} negatives are asked for, there are {n['n'] - n['p']}")
    if warm > others:
        raise ValueError(f"the warm-up takes {warm} negatives of {others}")
    if want > total - warm:
        raise ValueError(f"{want} positives don't fit behind the warm-up")
    order = F.md5(F.concat_ws(":", F.lit(seed), *key))
    ranked = rows.withColumn("order__", order)
    # of each class only the least hashes are ranked, so that the windows hold the sample and no more
    few = [ranked.where(F.col(positive) == is_).orderBy("order__", *key).limit(k) for is_, k in ((True, want), (False, others))]
    w = Window.orderBy("order__", *key)
    negative = few[1].withColumn("nth__", F.row_number().over(w))
    tail = negative.where(F.col("nth__") > warm).drop("nth__").unionByName(few[0]).withColumn("order__", F.md5(F.concat_ws(":", F.lit(seed), F.lit("tail"), *key)))
    return negative.where(F.col("nth__") <= warm).withColumn("position", F.col("nth__") - 1).drop("nth__", "order__").unionByName(tail.withColumn("position", F.row_number().over(w) + warm - 1).drop("order__"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Null for fewer than two rows, or where either is constant."""
    r = df.agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return r.select("n", F.when((F.col("n") >= 2) & (F.col("sa") > 0) & (F.col("sb") > 0), F.col("r")).alias("r"))


def threshold_rates(df: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    return df.agg(*[F.avg((F.col(score) >= t).cast("double")).alias(f"rate_{i}") for i, t in enumerate(thresholds)])


def top_counts(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return df.groupBy(column).count().orderBy(F.desc("count"), column).limit(k)


def compare_replays(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: event_id, score. Agreement of two runs over the events in both."""
    both = a.select("event_id", F.col("score").alias("x")).join(b.select("event_id", F.col("score").alias("y")), "event_id")
    d = F.abs(F.col("x") - F.col("y"))
    return both.agg(F.count(F.lit(1)).alias("matched"), F.avg(d).alias("mae"), F.max(d).alias("max_diff"), F.corr("x", "y").alias("r"), (F.min("x") == F.max("x")).alias("one_x"), (F.min("y") == F.max("y")).alias("one_y"))


def capacity(df: DataFrame) -> Column:
    """Status of a node by cpu and memory percent, queue fill, drops and load per cpu."""
    hot = lambda cpu, mem, queue: (F.col("cpu") >= cpu) | (F.col("mem") >= mem) | (F.col("queue") >= queue)
    return F.when(hot(90, 92, 0.9) | (F.col("drops") > 0), "Saturated").when(hot(75, 82, 0.6) | (F.col("load_per_cpu") >= 0.9), "Near Limit").otherwise("OK")


def score_map(df: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return df.select("event_id", hash01_raw(empty(F.col("fd_path"))).alias("x"), hash01_raw(empty(F.col("comm"))).alias("y"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def path_summary(df: DataFrame) -> DataFrame:
    return df.where("fd_path is not null").groupBy("fd_path").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.avg("score").alias("mean"), F.sum(F.col("anomaly").cast("long")).alias("flagged"),
        F.array_join(F.array_sort(F.collect_set("syscall_name")), ",").alias("syscalls"), F.array_join(F.array_sort(F.collect_set("comm")), ",").alias("comms"),
    )


_ALIASES = {"comm": "comm", "path": "fd_path", "fd_path": "fd_path", "event": "syscall_name", "event_name": "syscall_name", "syscall": "syscall_name", "syscall_name": "syscall_name", "host": "hostname", "hostname": "hostname", "type": "event_group", "event_group": "event_group"}


def search(df: DataFrame, query: str, scan: int = 50_000, cap: int = 100_000) -> DataFrame:
    """The last ``scan`` events that match all terms: ``field=value`` looks in one field, a bare term in all of them;
    unknown fields match everything. The limit comes before the search."""
    last = df.orderBy(F.desc("seq")).limit(min(scan, cap))
    hay = F.lower(F.concat_ws(" ", "comm", "fd_path", "syscall_name", "hostname", "event_group"))
    for term in query.lower().split():
        name, eq, value = term.partition("=")
        if eq and name in _ALIASES:
            last = last.where(F.coalesce(F.lower(_ALIASES[name]).contains(value), F.lit(False)))
        elif not eq:
            last = last.where(hay.contains(term))
    return last


def tail(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def time_range(df: DataFrame, start_ms: int | None, end_ms: int | None) -> DataFrame:
    ms = F.expr("ts_unix_nano div 1000000")
    return df.where((ms >= start_ms if start_ms is not None else F.lit(True)) & (ms <= end_ms if end_ms is not None else F.lit(True)))


def glob_regex(pattern: str) -> str:
    """Of a shell pattern in which a star crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and close > 0:
            body = pattern[i + 1 : close]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = close
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.sub(r"([^\w])", r"\\\1", c)))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def first_pattern(path: Column, patterns: list[str]) -> Column:
    """The first pattern that the path equals or matches; null if none."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when((path == p) | path.rlike(glob_regex(p)), F.lit(p)).otherwise(out)
    return out


def activity(df: DataFrame, benign: list[str], sensitive: list[str]) -> DataFrame:
    """Events on expected paths, by whether they were flagged."""
    d = df.where("fd_path is not null").select("anomaly", first_pattern(F.col("fd_path"), benign).isNotNull().alias("b"), first_pattern(F.col("fd_path"), sensitive).isNotNull().alias("s"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a = F.col("anomaly")
    return d.agg(n(F.col("b") & a).alias("benign_flagged"), n(F.col("b") & ~a).alias("benign_quiet"), n(F.col("s") & a).alias("sensitive_flagged"), n(F.col("s") & ~a).alias("sensitive_quiet"))


def downsample(df: DataFrame, most: int, seq: str = "seq") -> DataFrame:
    """Every so manyth row in the order of seq, and the last; 0 or less keeps all. Ranks come from counts by range of seq
    (``cumulated``), so no task sees all rows. Rows of one seq have one rank."""
    if most <= 0:
        return df
    bounds, n = _bounds(df, seq)
    step = max(1, -(-n // most))
    ranks = cumulated(df, seq, bounds).select(F.col("value").alias("seq__"), (F.col("upto") - F.col("c")).alias("rank__"), (F.col("upto") == n).alias("last__"))
    kept = ranks.where((F.col("rank__") % step == 0) | F.col("last__")).select("seq__")
    return df.join(kept, F.col(seq) == F.col("seq__")).drop("seq__")


def stratified(df: DataFrame, label: str, sizes: dict[str, int], seed: str, key: str = "event_id") -> DataFrame:
    """So many rows of each class, without replacement, by a hash of seed and key. Each class is a limit of its own, so a
    task keeps no more of its rows than are asked for, and no task ranks a class."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    parts = [df.where(F.col(label).cast("string") == name).orderBy(order, key).limit(n) for name, n in sizes.items()]
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)


def nearest_to(df: DataFrame, score: str, shares: list[float], k: int) -> DataFrame:
    """For each quantile, the k events whose score is nearest; an event that an earlier quantile has is not picked again.
    Only the first k * (quantiles) of each are ranked, as earlier ones can take no more than that."""
    at = quantiles(df, score, shares)  # one number a share
    out = None
    for i, v in enumerate(at):
        near = df.select("event_id", "seq", F.abs(F.col(score) - F.lit(v)).alias("gap")).orderBy("gap", "seq").limit(k * (i + 1))
        if out is not None:
            near = near.join(out.select("event_id"), "event_id", "left_anti")
        rank = F.row_number().over(Window.orderBy("gap", "seq"))
        got = near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.lit(i).alias("target"), "rank", "event_id", F.round("gap", 6).alias("gap"))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else df.selectExpr("0 as target", "0 as rank", "event_id", "0D as gap").limit(0)


def poll_rates(polls: DataFrame) -> DataFrame:
    """polls: poll_s, events, drops. Rates between polls; counters that went back count as reset."""
    w = Window.orderBy("poll_s")
    d = lambda c: F.col(c) - F.lag(c).over(w)
    rate = F.when((d("events") >= 0) & (d("poll_s") > 0), d("events") / d("poll_s"))
    return polls.select("poll_s", rate.alias("eps"), F.greatest(d("drops"), F.lit(0)).alias("new_drops"))


def _matched(df: DataFrame, wanted: list[str], key: str, token: str) -> tuple[DataFrame, DataFrame]:
    """(rows, states): the rows with a wanted token, and per key where each step was taken, at__0 and so on: the first
    row with the step's token behind the step before, null from the first step on that is never taken."""
    rows = df.where(F.col(token).isin(wanted)).select(F.col(key), F.col(token).alias("token__"), F.struct(*ORDER).alias("at__"))
    states = rows.groupBy(key).agg(F.min(F.when(F.col("token__") == wanted[0], F.col("at__"))).alias("at__0"))
    for i, t in enumerate(wanted[1:], 1):
        known = states.where(F.col(f"at__{i - 1}").isNotNull()).select(F.col(key).alias("key__"), F.col(f"at__{i - 1}").alias("before__"))
        ahead = rows.where(F.col("token__") == t).join(known, F.col(key).eqNullSafe(F.col("key__")) & (F.col("at__") > F.col("before__")))
        step = ahead.groupBy("key__").agg(F.min("at__").alias(f"at__{i}"))
        states = states.join(step, F.col(key).eqNullSafe(F.col("key__")), "left").drop("key__")
    return rows, states


def subsequence(df: DataFrame, wanted: list[str], key: str, token: str, most: int = 0) -> DataFrame:
    """Per key with a wanted token, how many of the tokens come in this order, matched greedily; where all do, further
    rows with the last token count too, up to ``most`` rows in all.

    A step is one aggregate: the least place of its token behind the step before. So a key's rows are
    never gathered or sorted, and one with very many is reduced ahead of the shuffle."""
    if not wanted:
        return df.select(F.col(key), F.lit(0).alias("matched")).limit(0)
    rows, states = _matched(df, wanted, key, token)
    n = reduce(lambda a, b: a + b, [F.col(f"at__{i}").isNotNull().cast("int") for i in range(len(wanted))])
    if most <= len(wanted):
        return states.select(key, n.alias("matched"))
    done = states.select(F.col(key).alias("key__"), F.col(f"at__{len(wanted) - 1}").alias("end__")).where(F.col("end__").isNotNull())
    more = rows.where(F.col("token__") == wanted[-1]).join(done, F.col(key).eqNullSafe(F.col("key__")) & (F.col("at__") > F.col("end__"))).groupBy("key__").agg(F.count(F.lit(1)).alias("more__"))
    both = states.join(more, F.col(key).eqNullSafe(F.col("key__")), "left")
    return both.select(key, (n + F.least(F.coalesce("more__", F.lit(0)), F.lit(most - len(wanted)))).cast("int").alias("matched"))


def subsequence_rows(df: DataFrame, wanted: list[str], key: str, token: str, most: int = 0) -> DataFrame:
    """The rows that ``subsequence`` counts, with step (from 0). Rows are told apart by key and order."""
    rows, states = _matched(df, wanted, key, token)
    steps = F.array_compact(F.array(*[F.when(F.col(f"at__{i}").isNotNull(), F.struct(F.lit(i).alias("step"), F.col(f"at__{i}").alias("at"))) for i in range(len(wanted))]))
    taken = states.select(F.col(key).alias("key__"), F.explode(steps).alias("s")).select("key__", "s.step", "s.at.*")
    if most > len(wanted):
        done = states.select(F.col(key).alias("key__"), F.col(f"at__{len(wanted) - 1}").alias("end__")).where(F.col("end__").isNotNull())
        more = rows.where(F.col("token__") == wanted[-1]).join(done, F.col(key).eqNullSafe(F.col("key__")) & (F.col("at__") > F.col("end__")))
        rank = F.row_number().over(Window.partitionBy("key__").orderBy("at__"))  # the limit on it is applied ahead of the shuffle
        more = more.withColumn("r", rank).where(F.col("r") <= most - len(wanted)).select("key__", (F.col("r") + len(wanted) - 1).alias("step"), "at__.*")
        taken = taken.unionByName(more)
    taken = taken.select("key__", "step", *[F.col(c).alias(f"{c}__") for c in ORDER])
    same = [F.col(c) == F.col(f"{c}__") for c in ORDER]
    return df.join(taken, reduce(lambda a, b: a & b, same, F.col(key).eqNullSafe(F.col("key__")))).drop("key__", *[f"{c}__" for c in ORDER])


def within(df: DataFrame, after_ns: int, within_ns: int) -> DataFrame:
    """Events from a moment on and so many nanoseconds long, both ends included."""
    return df.where(F.col("ts_unix_nano").between(after_ns, after_ns + within_ns))


def recent(df: DataFrame, now_ns: int | None = None, seconds: float = 30.0, by: str = "syscall_name", scores: tuple[str, ...] = ("score", "score_raw")) -> DataFrame:
    """Per call, events later than so many seconds ago (without ``now_ns``: before the last event): n, anomalies if they are
    flagged, and mean and largest of each score. What has no score counts, but not among the scores."""
    ago = int(seconds * 1e9)
    if now_ns is None:
        since = df.agg((F.max("ts_unix_nano") - ago).alias("since__"))  # one row
        df = df.join(F.broadcast(since), F.col("ts_unix_nano") > F.col("since__")).drop("since__")
    else:
        df = df.where(F.col("ts_unix_nano") > now_ns - ago)
    n = [F.count(F.lit(1)).alias("n")] + ([F.count_if(F.coalesce("anomaly", F.lit(False))).alias("anomalies")] if "anomaly" in df.columns else [])
    there = [c for c in scores if c in df.columns]
    return df.groupBy(by).agg(*n, *[f(c).alias(f"{k}_{c}") for c in there for k, f in (("mean", F.avg), ("most", F.max))])


def since_last(polls: DataFrame, recent: str = "recent") -> DataFrame:
    """polls: source, poll_s, total, recent. New events since the poll before: the difference of totals; where there is
    no poll before, or the total went back, the recent count stands in."""
    before = F.lag("total").over(Window.partitionBy("source").orderBy("poll_s"))
    return polls.select("source", "poll_s", F.when(before.isNull() | (F.col("total") < before), F.col(recent)).otherwise(F.col("total") - before).alias("new"))


def last_polls(polls: DataFrame, n: int = 20) -> DataFrame:
    return polls.orderBy(F.desc("poll_s")).limit(n)


def counters(events: DataFrame) -> DataFrame:
    """Events, anomalies, errors and the last time by group; over a stream as well as a table."""
    return events.groupBy("event_group").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("anomaly").cast("long")).alias("anomalies"), F.sum(F.coalesce(F.col("reason").contains("error"), F.lit(False)).cast("long")).alias("errors"), F.max("ts_unix_nano").alias("last"))


def principal_components(vectors: DataFrame, column: str, k: int = 2) -> DataFrame:
    """Append pc, the first k principal components of array vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.where(F.col(column).isNotNull()).withColumn("__v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(v).transform(v).withColumn("pc", vector_to_array("__p")).drop("__v", "__p")
