"""Detectors and sequence operators that are windows over earlier rows of a key, in the order (ts_unix_nano, seq).

Every score is prequential: it sees only rows strictly before its own. Running states go through ``scan``: a group's rows
are cut into ranges of time, each range starts from the exact combination of the states before it, and no window spans a
whole group. ``parts`` is the number of ranges; without it, it follows the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import scan
from tidewatch.operators.scan import PART

ORDER = ("ts_unix_nano", "seq")
HASH_BINS = 10_000


def top_mean(values: list[Column], k: int) -> Column:
    """Mean of the k largest."""
    k = min(k, len(values))
    best = F.slice(F.sort_array(F.array(*values), asc=False), 1, k)
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / k


def aggregate(values: list[Column], how: str, k: int = 8, temperature: float = 0.25) -> Column:
    if how == "sum":
        return reduce(lambda a, b: a + b, values)
    if how == "mean":
        return reduce(lambda a, b: a + b, values) / len(values)
    if how == "topk_mean":
        return top_mean(values, k)
    if how != "soft_topk_mean":
        raise ValueError(f"unknown aggregation {how!r}")
    best = F.slice(F.sort_array(F.array(*values), asc=False), 1, min(k, len(values)))
    weight = lambda x: F.exp((x - F.element_at(best, 1)) / temperature)
    total = F.aggregate(best, F.lit(0.0), lambda a, x: a + weight(x))
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + weight(x) * x) / total


def zscore(df: DataFrame, features: list[str], key: list[str], min_count: int = 20, std_floor: float = 1e-3, topk: int = 8, parts: int | None = None) -> DataFrame:
    """Append raw: the mean of the largest distances from the running mean in running standard deviations. A range's state
    is each feature's count, mean and sum of squared distances from it; states are combined pairwise exactly, those of
    earlier ranges around the first range's mean, so that no digits are lost."""
    columns, (df, many) = df.columns, scan.cut_into(df, ORDER[0], parts)
    own = df.groupBy(*key, PART).agg(F.count(F.lit(1)).alias("n"), *[a.alias(f"{x}_{i}") for i, f in enumerate(features) for x, a in (("n", F.count(f)), ("m", F.avg(f)), ("s", F.var_pop(f) * F.count(f)))])
    k, w = range(len(features)), scan.before(key)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({f"c_{i}": F.first(f"m_{i}", ignorenulls=True).over(sofar) for i in k}).withColumns({f"d_{i}": F.col(f"m_{i}") - F.col(f"c_{i}") for i in k})
    total = own.select(*key, PART, F.sum("n").over(w).alias("__n"), *[a.alias(f"{x}_{i}") for i in k for x, a in (
        ("__n", F.sum(f"n_{i}").over(w)), ("c", F.col(f"c_{i}")), ("d", F.sum(F.col(f"n_{i}") * F.col(f"d_{i}")).over(w)), ("s", F.sum(F.col(f"s_{i}") + F.col(f"n_{i}") * F.col(f"d_{i}") * F.col(f"d_{i}")).over(w)))])
    off = lambda i: F.col(f"d_{i}") / F.nullif(F.col(f"__n_{i}"), F.lit(0))
    states = total.select(*key, PART, "__n", *[a.alias(f"{x}_{i}") for i in k for x, a in (("__n", F.col(f"__n_{i}")), ("__m", F.col(f"c_{i}") + off(i)), ("__s", F.greatest(F.lit(0.0), F.col(f"s_{i}") - off(i) * F.col(f"d_{i}"))))])
    rows, local = scan.dealt(scan.carried(df, states), [*key, PART], many), scan.within(key, ORDER)
    upto = local.rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c: F.first(c).over(local.rowsBetween(Window.unboundedPreceding, 0))
    zs = []
    for i, f in enumerate(features):
        n0, m0, s0 = (F.coalesce(first(f"__{x}_{i}"), F.lit(0.0)) for x in "nms")
        n1, m1 = F.count(f).over(upto), F.coalesce(F.avg(f).over(upto), F.lit(0.0))
        s1 = F.coalesce(F.var_pop(f).over(upto), F.lit(0.0)) * n1
        n = n0 + n1
        mean = F.when(n > 0, m0 + (m1 - m0) * n1 / n)
        var = F.when(n > 1, (s0 + s1 + (m1 - m0) * (m1 - m0) * n0 * n1 / n) / (n - 1))
        zs.append(F.abs(F.col(f) - mean) / F.sqrt(F.greatest(F.coalesce(var, F.lit(0.0)), F.lit(std_floor**2))))
    n = F.coalesce(first("__n"), F.lit(0)) + F.count(F.lit(1)).over(upto) - 1  # but for the carried row
    return scan.bare(rows.withColumn("raw", F.when(n < min_count, F.lit(0.0)).otherwise(top_mean([F.coalesce(z, F.lit(0.0)) for z in zs], topk))), columns, "raw")


def kind_of(feature: str) -> str:
    if feature.endswith("_hash"):
        return "hash"
    return "binary" if feature in ("return_success", "file_sensitive_path", "file_tmp_path") or feature.startswith("group_syscall_") else "numeric"


def bin_of(feature: str, bins: int) -> Column:
    c, kind = F.col(feature), kind_of(feature)
    if kind == "hash":
        return F.least(F.greatest(F.floor(c * HASH_BINS + 1e-6), F.lit(0)), F.lit(HASH_BINS - 1)).cast("long")
    if kind == "binary":
        return (c >= 0.5).cast("long")
    return F.when(c <= 0, F.lit(0)).when(c >= 1, F.lit(bins - 1)).otherwise(F.floor(c * bins)).cast("long")


def surprisal(df: DataFrame, features: list[str], key: list[str], bins: int = 65536, alpha: float = 1.0, how: str = "mean", topk: int = 8, temperature: float = 0.25, parts: int | None = None) -> DataFrame:
    """Append raw: how much rarer than even each feature's value has been before, in nats, over features, without decay.
    A range's state is how often each value has come before it, a row for each value that the range has, and how many
    rows and different values have."""
    k, columns = range(len(features)), df.columns
    df, many = scan.cut_into(df, ORDER[0], parts)
    df = df.withColumns({f"__b_{i}": bin_of(f, bins) for i, f in enumerate(features)})
    each = df.select(*key, PART, F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"__b_{i}").alias("b")) for i in k])).alias("x")).select(*key, PART, "x.f", "x.b")
    own = each.groupBy(*key, PART, "f", "b").agg(F.count(F.lit(1)).alias("c"))
    seen = own.select(*key, PART, "f", "b", F.coalesce(F.sum("c").over(scan.before([*key, "f", "b"])), F.lit(0)).alias("c"))
    values = seen.select(*key, PART, *[F.when(F.col("f") == i, F.col("b")).alias(f"__b_{i}") for i in k], F.col("f").alias("__f"), F.col("c").alias("__c"))
    new = seen.groupBy(*key, PART).agg(*[F.count_if((F.col("f") == i) & (F.col("c") == 0)).alias(f"k_{i}") for i in k])
    rows = df.groupBy(*key, PART).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(PART, "__p")
    w = scan.before(key)
    same = [new[c].eqNullSafe(rows[c]) for c in key] + [new[PART] == rows["__p"]]
    totals = new.join(rows, reduce(lambda a, b: a & b, same)).select(*[new[c] for c in key], PART, "n", *[f"k_{i}" for i in k])
    totals = totals.select(*key, PART, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__n"), *[F.coalesce(F.sum(f"k_{i}").over(w), F.lit(0)).alias(f"__k_{i}") for i in k])
    both = scan.dealt(scan.carried(df, values.unionByName(totals, allowMissingColumns=True)), [*key, PART], many)
    # of carried rows, those of a value have its feature's number, the one of the range none
    row, upto = (F.col(scan.CARRY) == 0).cast("long"), scan.within(key, ORDER).rowsBetween(Window.unboundedPreceding, -1)
    for i in k:
        held = F.when(F.col("__f") == i, F.col("__c")).when(F.col("__f").isNull() & (F.col(scan.CARRY) == 0), 1).otherwise(0)
        both = both.withColumn(f"__c_{i}", F.coalesce(F.sum(held).over(scan.within(key, ORDER, f"__b_{i}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total, out = F.sum(row + F.coalesce("__n", F.lit(0))).over(upto), []
    for i, f in enumerate(features):
        if kind_of(f) == "numeric":
            size = F.lit(float(bins))
        else:
            news = F.when(F.col(scan.CARRY) == 1, F.coalesce(f"__k_{i}", F.lit(0))).otherwise((F.col(f"__c_{i}") == 0).cast("long"))
            size = F.greatest(F.lit(2.0), F.coalesce(F.sum(news).over(upto), F.lit(0)) + 1.0)
        out.append(F.greatest(F.lit(0.0), -F.log((F.col(f"__c_{i}") + alpha) / (total + alpha * size)) - F.log(size)))
    return scan.bare(both.withColumn("raw", aggregate(out, how, topk, temperature)), columns, "raw")


def scaled(raw: Column, how: str) -> Column:
    if how == "identity" or how == "raw_as_scaled":
        return raw
    if how == "exp1m":
        return 1 - F.exp(-raw)
    if how == "ratio":
        return raw / (1 + raw)
    raise ValueError(f"unknown scaling {how!r}")


def percentile(df: DataFrame, key: list[str], raw: str = "raw", window: int = 2048, warmup: int = 128, parts: int | None = None) -> DataFrame:
    """Append percentile: the share of the last ``window`` raw scores that are not above this one, on a log scale;
    0 while there are fewer than ``warmup``.

    The rank within a sliding window, without holding windows: rows are numbered, and cut into blocks of ``window``. A
    window is what of the own block is before, and what of the block before is not earlier than the row's place in its
    own. Both are counted by halving blocks again and again: at each step a row of a right half counts the rows of the left
    half that are not above it, all rows of a half at once by one running sum in the order of scores. So there
    is a sort for each doubling of the window, and no task holds more than two blocks of a group."""
    columns, (df, many) = df.columns, scan.numbered_in(df, key, ORDER, "__row", parts)
    x = F.log1p(F.greatest(F.col(raw), F.lit(0.0)))
    at = (F.col("__row") - 1).cast("long")
    df = df.withColumns({"__x": x, "__block": F.floor(at / window), "__at": (at % window).cast("int"), "__own": F.lit(1)})
    both = df.unionByName(df.select(*key, "__x", (F.col("__block") + 1).alias("__block"), "__at", F.lit(0).alias("__own")), allowMissingColumns=True)
    # twice the rows, and a sort's worth of them for each step at once: a task gets a quarter of a range
    both = both.repartition(4 * many, *key, "__block") if many > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else both.repartition(*key, "__block")
    own = F.col("__own") == 1
    for step in range((window - 1).bit_length()):
        w = Window.partitionBy(*key, "__block", F.shiftright("__at", step + 1)).orderBy("__x")
        right = F.shiftright("__at", step).bitwiseAND(1) == 1
        # earlier rows of the own block count, those of the block before no more
        got = F.sum(F.when(right, 0).when(own, 1).otherwise(-1)).over(w)
        both = both.withColumn("__sum", F.when(right, got).otherwise(0) if not step else F.col("__sum") + F.when(right, got).otherwise(0))
    last = F.sum(F.when(own, 0).otherwise(1)).over(Window.partitionBy(*key, "__block").orderBy("__x"))
    total = last + (F.col("__sum") if window > 1 else 0)
    n = F.least(F.col("__row") - 1, F.lit(window))
    both = both.withColumn("percentile", F.when(n < warmup, F.lit(0.0)).otherwise(total / F.nullif(n, F.lit(0))))
    return both.where(own).select(*[c for c in columns if c != "percentile"], "percentile")


def group_key(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("__default__"))


def decide(df: DataFrame, threshold: float, mode: str = "scaled", warmup: int = 0, key: str = "group_key", parts: int | None = None, row: str | None = None) -> DataFrame:
    """Append suppressed, primary, anomaly, score and reason. The first ``warmup`` rows of a key are suppressed; ``row`` is the
    column with a row's number within its key, if there is one already (it goes), as counting reads the rows twice more. A row with an ``error`` is no anomaly and scores 0, and its reason is the error."""
    if mode not in ("raw", "scaled", "percentile"):
        raise ValueError(f"unknown score mode {mode!r}")
    failed = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    if row:
        df = df.withColumnRenamed(row, "suppressed")
    elif warmup:
        df = scan.numbered(df, [key], ORDER, "suppressed", parts)
    df = df.withColumn("suppressed", F.col("suppressed") <= warmup if warmup or row else F.lit(False))
    df = df.withColumn("primary", F.when(F.col("suppressed") | failed, F.lit(0.0)).otherwise(F.col(mode)))
    df = df.withColumn("anomaly", ~F.col("suppressed") & ~failed & (F.col("primary") >= threshold))
    response = F.when(F.col("suppressed") | failed, F.lit(0.0)).otherwise(F.col("primary") if mode == "percentile" else F.col("scaled"))
    df = df.withColumn("score", F.least(response, F.lit(1.0)))
    said = F.when(F.col("anomaly"), F.format_string("score %.3f >= %.3f", "primary", F.lit(float(threshold))))
    return df.withColumn("reason", F.coalesce(F.col("error"), said) if "error" in df.columns else said)


def calibrated(df: DataFrame, warmup: int, window: int, least: int, key: list[str]) -> DataFrame:
    """Percentiles over rows that aren't suppressed: those never enter the window, and score 0."""
    df = scan.numbered(df, key, ORDER, "suppressed")
    df = df.withColumn("suppressed", F.col("suppressed") <= warmup)
    live = percentile(df.where(~F.col("suppressed")), key, "raw", window, least)
    return live.unionByName(df.where("suppressed").withColumn("percentile", F.lit(0.0)))


def fuse(raws: list[str], scaleds: list[str], how: str = "mean") -> tuple[Column, Column]:
    """(raw, scaled): means, or for ``linear`` a sigmoid over equally weighted scores."""
    mean = lambda cs: reduce(lambda a, b: a + b, [F.col(c) for c in cs]) / len(cs)
    if how == "mean":
        return mean(raws), mean(scaleds)
    if how == "linear":
        return mean(raws), 1 / (1 + F.exp(-mean(scaleds)))
    raise ValueError(f"unknown fusion {how!r}")


def rolling_ngram(df: DataFrame, n: int, vector: str, key: list[str], short: bool = False) -> DataFrame:
    """Append ngram: the last n vectors of the key, this row's included, end to end; null until there are n, or if
    ``short``, as many as there are by then."""
    w = Window.partitionBy(*key).orderBy(*ORDER).rowsBetween(1 - n, 0)
    got = F.collect_list(vector).over(w)
    return df.withColumn("__n", got).withColumn("ngram", F.when(F.lit(short) | (F.size("__n") == n), F.flatten("__n"))).drop("__n")


def context(df: DataFrame, n: int, token: str, key: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """Append ready, context (the n - 1 tokens before this one), target_id and num_classes (how many tokens there are up
    to this one's first row). Ids count tokens in the order of their first row over the whole table; they are ranked
    over one row a token."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - n, -1)
    df = df.withColumn("context", F.collect_list(token).over(w)).withColumn("ready", F.size("context") == n - 1)
    first = df.groupBy(token).agg(F.min(F.struct(*order)).alias("__first"))
    ids = first.select(F.col(token).alias("__t"), (F.row_number().over(Window.orderBy("__first")) - 1).alias("target_id"), "__first")  # a row a token
    ids = ids.withColumn("num_classes", F.col("target_id") + 1)
    return df.join(ids, df[token].eqNullSafe(ids["__t"])).drop("__t", "__first")


def fixed_chunks(df: DataFrame, size: int, thresholds: list[float], seq: str = "seq", score: str = "score") -> DataFrame:
    """Rates at or above each threshold, in chunks of so many rows by sequence number."""
    rates = [F.avg((F.col(score) >= t).cast("double")).alias(f"rate_{i}") for i, t in enumerate(thresholds)]
    return df.groupBy(F.expr(f"{seq} div {size}").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), *rates)


def runs(df: DataFrame, key: list[str], state: Column, parts: int | None = None) -> DataFrame:
    """Gaps and islands: append run, the number of the run of equal states within the key. Runs go on over ranges."""
    df = scan.last_states(df, key, ORDER, state, "before", parts)
    return scan.summed(df, key, ORDER, F.coalesce((F.col("before.v") != state).cast("int"), F.lit(1)), "run", parts).drop("before")


def as_of(df: DataFrame, key: list[str], value: Column, reset: Column) -> Column:
    """The latest value of the key so far, forgotten at each reset row: opened paths by file number, peers by socket."""
    w = Window.partitionBy(*key).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(value.isNotNull() | reset, F.struct(F.when(~reset, value).alias("v"))), ignorenulls=True).over(w)
    return mark["v"]


