"""The queries over the event tables, each beside the SQL that says the same for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import features, rules
from tidewatch.operators import analytics, native
from tidewatch.sources.env import DUCK_SQL, env

RULES = """
lists:
  file_calls: [read, openat, unlink]
  quiet_dirs: [/proc, /var/log]
macros:
  quiet: "attributes.fd_path startswithin (quiet_dirs)"
  has_path: "not (syscall_name in (read) and attributes.fd_path = \\"\\")"
groups:
  file: {syscalls: file_calls, features: {sensitive_paths: [/etc, /root, /usr/bin], tmp_paths: [/tmp]}}
  process: {syscalls: [execve]}
  network: {syscalls: [connect]}
rules:
  - {name: files, group: file, condition: "syscall_name in (file_calls) and not quiet and has_path"}
  - {name: shells, group: process, condition: "comm in (bash, python)"}
  - {name: net, group: network, condition: ""}
"""
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
WITH_ENV = f"with env as ({DUCK_SQL})"
H = "case when coalesce({0}, '') = '' then 0.0 else (cast('0x' || substr(md5({0}), 1, 8) as bigint) % 10000) / 10000.0 end"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql if sql.lstrip().startswith("with") or " env" not in sql else f"{WITH_ENV} {sql}"
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six places, as results are compared by value."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# rules

_CLASSIFIED = """, hit as (select *, case
   when syscall_name in ('read', 'openat', 'unlink') and not coalesce(starts_with(fd_path, '/proc') or starts_with(fd_path, '/var/log'), false) and not (syscall_name = 'read' and coalesce(fd_path = '', false)) then 'files'
   when syscall_name = 'execve' and comm in ('bash', 'python') then 'shells' when syscall_name = 'connect' then 'net' end as rule from env)"""


@query("rules_classify", WITH_ENV + _CLASSIFIED + " select event_id, rule, case rule when 'files' then 'file' when 'shells' then 'process' else 'network' end as rule_group from hit where rule is not null")
def rules_classify(spark, d):
    return rules.classify(env(spark, d), rules.load(RULES)).select("event_id", "rule", "rule_group")


def _condition(name: str, text: str, sql: str) -> None:
    @query(name, f"select event_id from env where {sql}")
    def run(spark, d):
        e = env(spark, d)
        return e.where(rules.compile_(rules.parse(text, {"dirs": ("/etc", "/root")}), e.columns)).select("event_id")


_condition("rule_equals", "comm = bash and uid = 3", "comm = 'bash' and uid = '3'")
_condition("rule_in", "pid in (1, 2, 3, x) or comm in (curl)", "cast(pid as bigint) in (1, 2, 3) or comm = 'curl'")
_condition("rule_startswith", "attributes.fd_path startswith /etc", "coalesce(starts_with(fd_path, '/etc'), false)")
_condition("rule_startswithin", "not attributes.fd_path startswithin (dirs)", "not coalesce(starts_with(fd_path, '/etc') or starts_with(fd_path, '/root'), false)")
_condition("rule_contains", "hostname contains -2 and not attributes.fd_path contains f1", "contains(hostname, '-2') and not coalesce(contains(fd_path, 'f1'), false)")
_condition("rule_boolean", "(comm = bash or comm = cat) and not (return_value = -13 or syscall_nr = 0)", "comm in ('bash', 'cat') and not (cast(return_value as bigint) = -13 or syscall_nr = 0)")
_condition("rule_empty_path", 'attributes.fd_path = ""', "coalesce(fd_path = '', false)")
_condition("rule_missing_field", "not namespace = x", "true")


@query("rules_group_map", "select syscall_name, case when syscall_name in ('read', 'openat', 'unlink') then 'file' when syscall_name = 'execve' then 'process' else 'network' end as rule_group, count(*) as n from env group by all")
def rules_group_map(spark, d):
    m = rules.group_of_syscall(rules.load(RULES))
    look = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return env(spark, d).groupBy("syscall_name", F.try_element_at(look, F.col("syscall_name")).alias("rule_group")).agg(F.count(F.lit(1)).alias("n"))


# features

_DAY = "((ts_unix_nano % 86400000000000) / 86400000000000.0)"
_NUM = "coalesce(try_cast({0} as bigint), 0)"
_PART = "list_filter(string_split(coalesce(fd_path, ''), '/'), lambda p: p <> '')"
_FEATURES = {
    "pid_norm": f"least(greatest({_NUM.format('pid')}, 0) / 4194304.0, 1.0)", "tid_norm": f"least(greatest({_NUM.format('tid')}, 0) / 4194304.0, 1.0)", "uid_norm": f"least(greatest({_NUM.format('uid')}, 0) / 4294967295.0, 1.0)",
    "arg0_norm": f"least(ln(1 + abs({_NUM.format('arg0')})) / 20.0, 1.0)", "arg1_norm": f"least(ln(1 + abs({_NUM.format('arg1')})) / 20.0, 1.0)",
    "path_depth_norm": f"least(len({_PART}) / 20.0, 1.0)", "return_success": f"case when {_NUM.format('return_value')} >= 0 then 1.0 else 0.0 end",
    "return_errno_norm": f"least(ln(1 + abs({_NUM.format('return_value')})) / 12.0, 1.0)",
    "hostname_hash": H.format("hostname"), "pid_hash": H.format("pid"), "path_hash": H.format("fd_path"), "path_prefix_hash": H.format(f"{_PART}[1]"),
    "syscall_nr_norm": "least(syscall_nr / 500.0, 1.0)", "day_fraction_norm": _DAY, "day_cycle_sin": f"sin({_DAY} * 2 * pi())", "day_cycle_cos": f"cos({_DAY} * 2 * pi())",
    "week_of_month_norm": "(least(4, (day(make_timestamp(ts_unix_nano // 1000)) - 1) // 7 + 1) - 1) / 3.0",
    "file_sensitive_path": "case when " + " or ".join(f"starts_with(coalesce(fd_path, ''), '{p}')" for p in features.SENSITIVE) + " then 1.0 else 0.0 end",
    "file_tmp_path": "case when " + " or ".join(f"starts_with(coalesce(fd_path, ''), '{p}')" for p in features.TEMPORARY) + " then 1.0 else 0.0 end",
    "file_flags_hash": "0.0", "net_socket_family_norm": "case when fd_sock_family is null then 0.0 else 0.2 end", "net_dport_norm": f"least({_NUM.format('fd_sock_remote_port')} / 65535.0, 1.0)",
    "net_socket_type_hash": H.format("'0'"), "net_daddr_hash": H.format("fd_sock_remote_addr"), "net_af_hash": H.format("fd_sock_family"),
}


def _feature_query(name: str, wanted: tuple[str, ...]) -> None:
    @query(name, "select event_id, " + ", ".join(f"round(cast({_FEATURES[f]} as double), 6) as {f}" for f in wanted) + " from env")
    def run(spark, d):
        return r6(features.extract(env(spark, d), list(wanted)).select("event_id", *wanted))


_feature_query("features_tabular", features.SETS["tabular"])
_feature_query("features_frequency", features.SETS["frequency"])
_feature_query("features_network", (*features.SETS["network"], "net_af_hash", "net_socket_type_hash"))
_feature_query("features_file", ("file_sensitive_path", "file_tmp_path", "file_flags_hash", "path_depth_norm", "day_fraction_norm"))

# native detectors, scaling, decisions

_Z = """, f as (select event_id, seq, ts_unix_nano, event_group, {a} as a, {b} as b from env),
z as (select *, count(*) over w as n, abs(a - avg(a) over w) / sqrt(greatest(coalesce(var_samp(a) over w, 0), 1e-6)) as za,
             abs(b - avg(b) over w) / sqrt(greatest(coalesce(var_samp(b) over w, 0), 1e-6)) as zb
      from f window w as (partition by event_group order by ts_unix_nano, seq rows between unbounded preceding and 1 preceding)),
r as (select *, case when n < 20 then 0.0 else (coalesce(za, 0) + coalesce(zb, 0)) / 2 end as raw from z)""".format(a=_FEATURES["arg1_norm"], b=_FEATURES["return_errno_norm"])


def _zscored(spark, d):
    e = features.extract(env(spark, d), ["arg1_norm", "return_errno_norm"])
    return native.zscore(e, ["arg1_norm", "return_errno_norm"], ["event_group"])


@query("zscore", WITH_ENV + _Z + " select event_id, round(raw, 6) as raw from r")
def zscore(spark, d):
    return r6(_zscored(spark, d).select("event_id", "raw"))


_SURPRISAL = """, f as (select event_id, seq, ts_unix_nano, event_group, cast(floor({h} * 10000 + 1e-6) as bigint) as ka, case when {x} <= 0 then 0 when {x} >= 1 then 65535 else cast(floor({x} * 65536) as bigint) end as kb from env),
c as (select *, count(*) over w as t, count(*) over wa as ca, count(*) over wb as cb from f
      window w as (partition by event_group order by ts_unix_nano, seq rows between unbounded preceding and 1 preceding),
             wa as (partition by event_group, ka order by ts_unix_nano, seq rows between unbounded preceding and 1 preceding),
             wb as (partition by event_group, kb order by ts_unix_nano, seq rows between unbounded preceding and 1 preceding)),
s as (select *, greatest(2.0, coalesce(sum(case when ca = 0 then 1 else 0 end) over (partition by event_group order by ts_unix_nano, seq rows between unbounded preceding and 1 preceding), 0) + 1.0) as na from c)
select event_id, round((greatest(0, -ln((ca + 1) / (t + na)) - ln(na)) + greatest(0, -ln((cb + 1) / (t + 65536.0)) - ln(65536.0))) / 2, 6) as raw from s""".format(h=_FEATURES["path_hash"], x=_FEATURES["arg1_norm"])


@query("surprisal", WITH_ENV + _SURPRISAL)
def surprisal(spark, d):
    e = features.extract(env(spark, d), ["path_hash", "arg1_norm"])
    return r6(native.surprisal(e, ["path_hash", "arg1_norm"], ["event_group"]).select("event_id", "raw"))


@query("score_percentile", WITH_ENV + _Z + """, l as (select event_id, ln(1 + greatest(raw, 0)) as x, list(ln(1 + greatest(raw, 0))) over (partition by event_group order by ts_unix_nano, seq rows between 256 preceding and 1 preceding) as last from r)
select event_id, round(case when coalesce(len(last), 0) < 32 then 0.0 else len(list_filter(last, lambda v: v <= x)) / len(last) end, 6) as percentile from l""")  # fmt: skip
def score_percentile(spark, d):
    return r6(native.percentile(_zscored(spark, d), ["event_group"], window=256, warmup=32).select("event_id", "percentile"))


_DECIDED = _Z + """, s as (select *, 1 - exp(-raw) as scaled, row_number() over (partition by event_group order by ts_unix_nano, seq) <= 100 as suppressed from r),
p as (select *, case when suppressed then 0.0 else scaled end as primary_ from s)"""


def _decided(spark, d):
    df = _zscored(spark, d).withColumn("scaled", native.scaled(F.col("raw"), "exp1m")).withColumn("group_key", native.group_key(F.col("event_group")))
    return native.decide(df, 0.9, "scaled", 100)


@query("decision", WITH_ENV + _DECIDED + " select event_id, suppressed, round(primary_, 6) as primary, not suppressed and primary_ >= 0.9 as anomaly, round(least(primary_, 1.0), 6) as score from p")
def decision(spark, d):
    return r6(_decided(spark, d).select("event_id", "suppressed", "primary", "anomaly", "score"))


@query("anomalies_by_group", WITH_ENV + _DECIDED + " select event_group, count(*) as n, count(*) filter (where not suppressed and primary_ >= 0.9) as anomalies, round(avg(least(primary_, 1.0)), 6) as mean_score from p group by 1")
def anomalies_by_group(spark, d):
    return r6(_decided(spark, d).groupBy("event_group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anomaly").cast("long")).alias("anomalies"), F.avg("score").alias("mean_score")))


@query("fusion", WITH_ENV + _Z + " select event_id, round((raw + raw * 0.5) / 2, 6) as mean_raw, round(((1 - exp(-raw)) + raw / (1 + raw)) / 2, 6) as mean_scaled, round(1 / (1 + exp(-((1 - exp(-raw)) + raw / (1 + raw)) / 2)), 6) as linear_scaled from r")
def fusion(spark, d):
    df = _zscored(spark, d).withColumn("raw2", F.col("raw") * 0.5).withColumn("s1", native.scaled(F.col("raw"), "exp1m")).withColumn("s2", native.scaled(F.col("raw"), "ratio"))
    raw, mean = native.fuse(["raw", "raw2"], ["s1", "s2"])
    _, linear = native.fuse(["raw", "raw2"], ["s1", "s2"], "linear")
    return r6(df.select("event_id", raw.alias("mean_raw"), mean.alias("mean_scaled"), linear.alias("linear_scaled")))


def q_flagship(spark, d):
    """Rules, features, detector, decision: the anomalies of each group."""
    kept = rules.classify(env(spark, d), rules.load(RULES))
    names = ["arg1_norm", "return_errno_norm", "path_depth_norm"]
    df = native.zscore(features.extract(kept, names), names, ["rule_group"])
    df = df.withColumn("scaled", native.scaled(F.col("raw"), "exp1m")).withColumn("group_key", native.group_key(F.col("rule_group")))
    return native.decide(df, 0.9, "scaled", 100).select("event_id", "rule", "group_key", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"), "suppressed", "anomaly")


_FLAG = _CLASSIFIED + """, f as (select event_id, seq, ts_unix_nano, rule, case rule when 'files' then 'file' when 'shells' then 'process' else 'network' end as g, {a} as a, {b} as b, {c} as c from hit where rule is not null),
z as (select *, count(*) over w as n, row_number() over (partition by g order by ts_unix_nano, seq) <= 100 as suppressed, abs(a - avg(a) over w) / sqrt(greatest(coalesce(var_samp(a) over w, 0), 1e-6)) as za,
      abs(b - avg(b) over w) / sqrt(greatest(coalesce(var_samp(b) over w, 0), 1e-6)) as zb, abs(c - avg(c) over w) / sqrt(greatest(coalesce(var_samp(c) over w, 0), 1e-6)) as zc
      from f window w as (partition by g order by ts_unix_nano, seq rows between unbounded preceding and 1 preceding)),
r as (select *, case when n < 20 then 0.0 else (coalesce(za, 0) + coalesce(zb, 0) + coalesce(zc, 0)) / 3 end as raw from z),
s as (select *, case when suppressed then 0.0 else 1 - exp(-raw) end as p from r)
select event_id, rule, g as group_key, round(raw, 6) as raw, round(least(p, 1.0), 6) as score, suppressed, not suppressed and p >= 0.9 as anomaly from s""".format(a=_FEATURES["arg1_norm"], b=_FEATURES["return_errno_norm"], c=_FEATURES["path_depth_norm"])
query("flagship", WITH_ENV + _FLAG)(q_flagship)

# sequences

@query("ngram", WITH_ENV + """, g as (select event_id, list(syscall_name) over (partition by tid order by ts_unix_nano, seq rows between 3 preceding and current row) as l from env)
select event_id, array_to_string(l, ',') as gram, len(l) = 4 as ready from g""")
def ngram(spark, d):
    df = native.rolling_ngram(env(spark, d).withColumn("v", F.array("syscall_name")), 4, "v", ["tid"], short=True)
    return df.select("event_id", F.array_join("ngram", ",").alias("gram"), (F.size("ngram") == 4).alias("ready"))


@query("sequence_context", """with c as (select *, list(role) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding) as ctx from conversations),
ids as (select role, row_number() over (order by min((conv_id, turn))) - 1 as target_id from conversations group by 1)
select conv_id, turn, coalesce(array_to_string(ctx, ','), '') as context, coalesce(len(ctx), 0) = 3 as ready, target_id from c join ids using (role)""")
def sequence_context(spark, d):
    df = native.context(table(spark, d, "conversations").select("conv_id", "turn", "role"), 4, "role", ["conv_id"], ("conv_id", "turn"))
    return df.select("conv_id", "turn", F.array_join("context", ",").alias("context"), "ready", F.col("target_id").cast("long"))


@query("fixed_chunks", WITH_ENV + _DECIDED + " select seq // 1000 as chunk, count(*) as n, round(avg(case when primary_ >= 0.5 then 1.0 else 0 end), 6) as rate_0, round(avg(case when primary_ >= 0.9 then 1.0 else 0 end), 6) as rate_1 from p group by 1")
def fixed_chunks(spark, d):
    return r6(native.fixed_chunks(_decided(spark, d), 1000, [0.5, 0.9]))


@query("runs", "with e as (select *, lag(event_group) over (partition by tid order by ts_unix_nano, seq) as before from env_) select tid, count(*) filter (where before is distinct from event_group or before is null) as runs from e group by 1".replace("with e", WITH_ENV + ", env_ as (select * from env), e"))
def runs(spark, d):
    df = native.runs(env(spark, d), ["tid"], F.col("event_group"))
    return df.groupBy("tid").agg(F.max("run").cast("long").alias("runs"))


@query("as_of_path", "select event_id, last_value(case when syscall_name in ('openat', 'unlink') then {'v': case when syscall_name = 'openat' then fd_path end} end ignore nulls) over (partition by pid order by ts_unix_nano, seq rows between unbounded preceding and current row).v as open_path from env".replace("select event_id, last_value", WITH_ENV + ", w as (select event_id, last_value").replace(".v as open_path from env", " as s from env) select event_id, s.v as open_path from w"))
def as_of_path(spark, d):
    value = F.when(F.col("syscall_name") == "openat", F.col("fd_path"))
    return env(spark, d).select("event_id", native.as_of(None, ["pid"], value, F.col("syscall_name") == "unlink").alias("open_path"))


@query("enter_exit", "select event_id, lead(event_id) over (partition by tid order by ts_unix_nano, seq) as exit_id from env")
def enter_exit(spark, d):
    from pyspark.sql import Window

    return env(spark, d).select("event_id", F.lead("event_id").over(Window.partitionBy("tid").orderBy(*native.ORDER)).alias("exit_id"))


@query("subsequence", WITH_ENV + """, t as (select pid, list(syscall_name order by ts_unix_nano, seq) as s from env where syscall_name in ('execve', 'openat', 'connect', 'unlink') group by 1)
select pid, cast(list_reduce(list_prepend(0, list_transform(s, lambda x: list_position(['execve', 'openat', 'connect', 'unlink'], x))), lambda i, x: case when x = i + 1 then x else i end) as integer) as matched from t""")
def subsequence(spark, d):
    return analytics.subsequence(env(spark, d), ["execve", "openat", "connect", "unlink"], "pid", "syscall_name")


@query("subsequence_repeats", WITH_ENV + """, t as (select pid, syscall_name as c, (ts_unix_nano, seq) as o from env where syscall_name in ('openat', 'connect')),
a as (select pid, min(o) filter (where c = 'openat') as a from t group by 1), b as (select pid, min(o) as b from t join a using (pid) where c = 'connect' and o > a group by 1),
m as (select pid, count(*) as n from t join b using (pid) where c = 'connect' and o > b group by 1)
select pid, cast((a is not null)::int + (b is not null)::int + least(coalesce(n, 0), 3) as integer) as matched from a left join b using (pid) left join m using (pid)""")
def subsequence_repeats(spark, d):
    return analytics.subsequence(env(spark, d), ["openat", "connect"], "pid", "syscall_name", most=5)


@query("subsequence_rows", WITH_ENV + """, t as (select pid, event_id, syscall_name as c, (ts_unix_nano, seq) as o from env where syscall_name in ('openat', 'connect')),
a as (select pid, min(o) filter (where c = 'openat') as a from t group by 1), b as (select pid, min(o) as b from t join a using (pid) where c = 'connect' and o > a group by 1),
m as (select event_id, row_number() over (partition by pid order by o) as r from t join b using (pid) where c = 'connect' and o > b)
select event_id, 0 as step from t join a using (pid) where o = a union all select event_id, 1 from t join b using (pid) where o = b union all select event_id, cast(r + 1 as integer) from m where r <= 3""")
def subsequence_rows(spark, d):
    return analytics.subsequence_rows(env(spark, d), ["openat", "connect"], "pid", "syscall_name", most=5).select("event_id", F.col("step").cast("int"))


@query("events_within", "select event_id from env where ts_unix_nano between 1704844800000000000 and 1704844800000000000 + 86400000000000")
def events_within(spark, d):
    return analytics.within(env(spark, d), 1704844800000000000, 86400000000000).select("event_id")


# analytics

@query("confusion", """with l as (select doc_id, quality = 0 as positive from labels), f as (select doc_id from documents where n_chars < 500),
n as (select count(*) filter (where f.doc_id is not null and positive) as tp, count(*) filter (where f.doc_id is not null and not positive) as fp, count(*) filter (where f.doc_id is null and positive) as fn, count(*) filter (where f.doc_id is null and not positive) as tn from l left join f using (doc_id)),
p as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall from n)
select tp, fp, fn, tn, round(precision, 6) as precision, round(recall, 6) as recall, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round((tp + fp) / (tp + fp + fn + tn), 6) as flagged_rate,
       round(case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end, 6) as f1 from p""")
def confusion(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), (F.col("quality") == 0).alias("positive"))
    return r6(analytics.confusion(labels, table(spark, d, "documents").where("n_chars < 500").select(F.col("doc_id").alias("event_id"))))


@query("stream_performance", WITH_ENV + """, e as (select recording_name as rec, malicious as y, value > 120 as p, ts_unix_nano, seq, max(malicious) over (partition by recording_name order by ts_unix_nano, seq) as ph from env),
f as (select *, p and not y as fa, lead(p and not y) over w as nfa, lead(ph) over w as nph from e window w as (partition by rec order by ts_unix_nano, seq)),
b as (select rec, max(y) as ex, min(case when y then ts_unix_nano end) as began, min(case when y and p then ts_unix_nano end) as caught, max(fa) as anyfa,
      count(*) filter (where fa and (not coalesce(nfa, false) or coalesce(nph <> ph, false)) and not (not ph and coalesce(nph <> ph, false))) as runs,
      count(*) filter (where p and y) as tp, count(*) filter (where fa) as fp, count(*) filter (where not p and y) as fn, count(*) filter (where not p and not y) as tn from f group by 1)
select cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(tn) as bigint) as tn, count(*) filter (where ex) as exploits, count(caught) as detected, count(*) filter (where anyfa) as recordings_with_false_alarm,
       cast(sum(runs) as bigint) as false_alarm_runs, round(avg((caught - began) / 1e9), 6) as mean_delay_s, round(count(caught) / count(*) filter (where ex), 6) as detection_rate from b""")
def stream_performance(spark, d):
    e = env(spark, d).select(F.col("recording_name").alias("recording"), F.col("malicious").alias("expected"), (F.col("value") > 120).alias("predicted"), "ts_unix_nano", "seq")
    return r6(analytics.stream_performance(e))


_DUP = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query("exact_duplicates", "select cast(sum(c - 1) as bigint) as duplicates, count(*) as distinct_rows from (select count(*) as c from orders group by o_orderstatus, o_orderpriority, o_custkey)")
def exact_duplicates(spark, d):
    return analytics.exact_duplicates(table(spark, d, "orders"), _DUP)


def _near(k: int, sql: str) -> None:
    @query(f"near_duplicates_{k}", sql)
    def run(spark, d):
        e = table(spark, d, "events").select("event_type", F.floor("value").alias("v"), F.col("user_id"))
        return analytics.near_duplicates(e, ["event_type", "v", "user_id"], k)


_E3 = "with e as (select event_type as a, floor(value) as b, user_id as c from events), o as (select distinct * from e) select count(*) as rows from e where exists (select 1 from o where (o.a, o.b, o.c) <> (e.a, e.b, e.c) and ({}))"
_near(1, _E3.format("(o.a = e.a and o.b = e.b) or (o.a = e.a and o.c = e.c) or (o.b = e.b and o.c = e.c)"))
_near(2, "with e as (select event_type as a, floor(value) as b, user_id as c from events), o as (select distinct * from e), m as (select a, null::double as b, null::bigint as c from o group by a having count(*) > 1), n as (select b from o group by b having count(*) > 1), q as (select c from o group by c having count(*) > 1) select count(*) as rows from e where a in (select a from m) or b in (select b from n) or c in (select c from q)")


@query("near_duplicates_3", """with e as (select event_type as a, floor(value / 7) as b, user_id as c, comm as d from (select *, case when user_id % 3 = 0 then 'x' || event_id else 'y' || (event_id // 40) end as comm from events)),
o as (select distinct * from e), a1 as (select a from o group by a having count(*) > 1), b1 as (select b from o group by b having count(*) > 1), c1 as (select c from o group by c having count(*) > 1), d1 as (select d from o group by d having count(*) > 1)
select count(*) as rows from e where a in (from a1) or b in (from b1) or c in (from c1) or d in (from d1)""")
def near_duplicates_3(spark, d):
    comm = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("x"), "event_id")).otherwise(F.concat(F.lit("y"), F.expr("event_id div 40").cast("string")))
    e = table(spark, d, "events").select("event_type", F.floor(F.col("value") / 7).alias("v"), "user_id", comm.alias("comm"))
    return analytics.near_duplicates(e, ["event_type", "v", "user_id", "comm"], 3)


@query("nearest_rank", "with s as (select l_extendedprice as value, row_number() over (order by l_extendedprice) - 1 as i, count(*) over () as n from lineitem), p as (select unnest([1.0, 50.0, 90.0, 99.5]) as percent) select cast(percent as double) as percent, value from p join s on i = cast(floor(percent / 100 * (n - 1)) as bigint)")
def nearest_rank(spark, d):
    return analytics.nearest_rank(table(spark, d, "lineitem"), "l_extendedprice", [1.0, 50.0, 90.0, 99.5])


@query("distribution", "select count(o_totalprice) as n, round(min(o_totalprice), 6) as least, round(max(o_totalprice), 6) as most, round(avg(o_totalprice), 6) as mean, round(stddev_pop(o_totalprice), 6) as std, round(quantile_cont(o_totalprice, 0.01), 6) as q0, round(quantile_cont(o_totalprice, 0.5), 6) as q1, round(quantile_cont(o_totalprice, 0.99), 6) as q2 from orders")
def distribution(spark, d):
    return analytics.summary(table(spark, d, "orders"), "o_totalprice", [0.01, 0.5, 0.99])


@query("correlation", "select count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def correlation(spark, d):
    return r6(analytics.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("threshold_rates", "select round(avg(case when l_discount >= 0.02 then 1.0 else 0 end), 6) as rate_0, round(avg(case when l_discount >= 0.05 then 1.0 else 0 end), 6) as rate_1, round(avg(case when l_discount >= 0.08 then 1.0 else 0 end), 6) as rate_2 from lineitem")
def threshold_rates(spark, d):
    return r6(analytics.threshold_rates(table(spark, d, "lineitem"), "l_discount", [0.02, 0.05, 0.08]))


@query("top_counts", "select comm, count(*) as count from env group by 1 order by 2 desc, 1 limit 20")
def top_counts(spark, d):
    return analytics.top_counts(env(spark, d), "comm")


@query("compare_replays", "with a as (select event_id, value as x from events), b as (select event_id, round(value, 1) as y from events) select count(*) as matched, round(avg(abs(x - y)), 6) as mae, round(max(abs(x - y)), 6) as max_diff, round(corr(x, y), 6) as r, min(x) = max(x) as one_x, min(y) = max(y) as one_y from a join b using (event_id)")
def compare_replays(spark, d):
    e = table(spark, d, "events")
    return r6(analytics.compare_replays(e.select("event_id", F.col("value").alias("score")), e.select("event_id", F.round("value", 1).alias("score"))))


@query("capacity", "with c as (select event_id, value / 2 as cpu, value / 3 as mem, user_id / 150.0 as queue, event_id % 50 // 49 as drops, value / 200 as load_per_cpu from events) select event_id, case when cpu >= 90 or mem >= 92 or queue >= 0.9 or drops > 0 then 'Saturated' when cpu >= 75 or mem >= 82 or queue >= 0.6 or load_per_cpu >= 0.9 then 'Near Limit' else 'OK' end as status from c")
def capacity(spark, d):
    c = table(spark, d, "events").select("event_id", (F.col("value") / 2).alias("cpu"), (F.col("value") / 3).alias("mem"), (F.col("user_id") / 150.0).alias("queue"), F.expr("event_id % 50 div 49").alias("drops"), (F.col("value") / 200).alias("load_per_cpu"))
    return c.select("event_id", analytics.capacity(c).alias("status"))


_RAWH = "(cast('0x' || substr(md5(coalesce({0}, '')), 1, 8) as bigint) % 10000) / 10000.0"


@query("score_map", f"select event_id, round({_RAWH.format('fd_path')}, 6) as x, round({_RAWH.format('comm')}, 6) as y, round(least(greatest(value / 100, 0), 1), 6) as score from env")
def score_map(spark, d):
    return r6(analytics.score_map(env(spark, d).withColumn("score", F.col("value") / 100)))


@query("path_summary", WITH_ENV + _DECIDED.replace("select event_id, seq, ts_unix_nano, event_group,", "select event_id, seq, ts_unix_nano, event_group, fd_path, syscall_name, comm,") + " select fd_path, count(*) as n, round(min(least(primary_, 1)), 6) as least, round(max(least(primary_, 1)), 6) as most, round(avg(least(primary_, 1)), 6) as mean, count(*) filter (where not suppressed and primary_ >= 0.9) as flagged, array_to_string(list_sort(list(distinct syscall_name)), ',') as syscalls, array_to_string(list_sort(list(distinct comm)), ',') as comms from p where fd_path is not null group by 1")
def path_summary(spark, d):
    return r6(analytics.path_summary(_decided(spark, d)))


@query("activity", WITH_ENV + _DECIDED.replace("select event_id, seq, ts_unix_nano, event_group,", "select event_id, seq, ts_unix_nano, event_group, fd_path,") + " select count(*) filter (where b and a) as benign_flagged, count(*) filter (where b and not a) as benign_quiet, count(*) filter (where s and a) as sensitive_flagged, count(*) filter (where s and not a) as sensitive_quiet from (select not suppressed and primary_ >= 0.9 as a, fd_path like '/tmp/%' or fd_path = '/proc/f2' as b, fd_path like '/etc/f_' or fd_path like '/root/%' as s from p where fd_path is not null)")
def activity(spark, d):
    return analytics.activity(_decided(spark, d), ["/tmp/*", "/proc/f2"], ["/etc/f?", "/root/*"])


@query("log_search", "select event_id from (select * from env order by seq desc limit 50000) where contains(lower(comm), 'bash') and contains(lower(fd_path), '/etc') and contains(lower(concat_ws(' ', comm, fd_path, syscall_name, hostname, event_group)), 'node-1')")
def log_search(spark, d):
    return analytics.search(env(spark, d), "comm=bash path=/etc node-1 other=x").select("event_id")


@query("log_tail", "select event_id, comm from (select * from env order by seq desc limit 100)")
def log_tail(spark, d):
    return analytics.tail(env(spark, d), 100).select("event_id", "comm")


@query("time_range", "select event_id from env where ts_unix_nano // 1000000 between 1704500000000 and 1705000000000")
def time_range(spark, d):
    return analytics.time_range(env(spark, d), 1704500000000, 1705000000000).select("event_id")


@query("glob_match", "select event_id, case when fd_path = '/etc/f1' then '/etc/f1' when fd_path like '/etc/%' then '/etc/*' when regexp_full_match(fd_path, '/[tp].*/f[0-4]') then '/[tp]*/f[0-4]' end as pattern from env")
def glob_match(spark, d):
    return env(spark, d).select("event_id", analytics.first_pattern(F.col("fd_path"), ["/etc/f1", "/etc/*", "/[tp]*/f[0-4]"]).alias("pattern"))


@query("downsample", "select event_id from (select event_id, row_number() over (order by event_id) - 1 as i, count(*) over () as n from events) where i % greatest(1, cast(ceil(n / 300) as bigint)) = 0 or i = n - 1")
def downsample(spark, d):
    return analytics.downsample(table(spark, d, "events").withColumn("seq", F.col("event_id")), 300).select("event_id")


@query("stratified_sample", "select event_id from (select event_id, malicious, row_number() over (partition by malicious order by md5('s:' || event_id), event_id) as r from env) where r <= case when malicious then 20 else 200 end")
def stratified_sample(spark, d):
    return analytics.stratified(env(spark, d), "malicious", {"true": 20, "false": 200}, "s").select("event_id")


@query("top_scores", WITH_ENV + _DECIDED + " select event_id, round(primary_, 6) as primary from p order by primary_ desc, seq limit 20")
def top_scores(spark, d):
    return r6(_decided(spark, d).orderBy(F.desc("primary"), "seq").limit(20).select("event_id", "primary"))


@query("nearest_to_quantiles", """with t as (select quantile_cont(value, 0.1) as a, quantile_cont(value, 0.5) as b, quantile_cont(value, 0.995) as c from events),
x as (select event_id, abs(value - a) as gap from events, t order by gap, event_id limit 8), y as (select event_id, abs(value - b) as gap from events, t where event_id not in (select event_id from x) order by gap, event_id limit 8),
z as (select event_id, abs(value - c) as gap from events, t where event_id not in (select event_id from x union all select event_id from y) order by gap, event_id limit 8),
u as (select 0 as target, * from x union all select 1, * from y union all select 2, * from z)
select target, row_number() over (partition by target order by gap, event_id) as rank, event_id, round(gap, 6) as gap from u""")
def nearest_to_quantiles(spark, d):
    return analytics.nearest_to(table(spark, d, "events").withColumn("seq", F.col("event_id")), "value", [0.1, 0.5, 0.995], 8)


@query("poll_rates", "with p as (select event_id // 100 as poll_s, count(*) as events, count(*) filter (where value > 150) as drops from events group by 1), l as (select *, events - lag(events) over w as de, poll_s - lag(poll_s) over w as dt, drops - lag(drops) over w as dd from p window w as (order by poll_s)) select poll_s, round(case when de >= 0 and dt > 0 then de / dt end, 6) as eps, greatest(dd, 0) as new_drops from l")
def poll_rates(spark, d):
    polls = table(spark, d, "events").groupBy(F.expr("event_id div 100").alias("poll_s")).agg(F.count(F.lit(1)).alias("events"), F.sum((F.col("value") > 150).cast("long")).alias("drops"))
    return r6(analytics.poll_rates(polls))


@query("recent_window", "select syscall_name, count(*) as n, count(*) filter (where malicious) as anomalies, round(avg(value), 6) as mean_value, round(max(value), 6) as most_value from env where ts_unix_nano > (select max(ts_unix_nano) from env) - 86400000000000 group by 1")
def recent_window(spark, d):
    e = env(spark, d).withColumn("anomaly", F.col("malicious"))
    return r6(analytics.recent(e, seconds=86400, scores=("value",)))


@query("labels_join", "select l.doc_id, l.toxic, d.source is not null as known from labels l left join (select * from documents where n_chars > 100) d using (doc_id)")
def labels_join(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").where("n_chars > 100").select("doc_id", "source"), "doc_id", "left").select("doc_id", "toxic", F.col("source").isNotNull().alias("known"))


@query("unmatched_patterns", "select p as pattern from (select unnest(['/etc/*', '/nowhere/*', '/tmp/f1', '/var/log/x*']) as p) where not exists (select 1 from env where fd_path = p or (p like '%*' and starts_with(fd_path, replace(p, '*', ''))))".replace("select p as", WITH_ENV + " select p as"))
def unmatched_patterns(spark, d):
    return analytics.unmatched_patterns(env(spark, d), ["/etc/*", "/nowhere/*", "/tmp/f1", "/var/log/x*"])


@query("many_patterns", WITH_ENV + """, p as (select unnest(range(5000)) as n), w as (select n * 2 as place, '/etc/f' || n || '*' as pattern, '/etc/f' || n as start, true as open from p union all select n * 2 + 1, '/tmp/f' || n, '/tmp/f' || n, false from p)
select event_id, arg_min(pattern, place) as pattern from env left join w on case when open then starts_with(fd_path, start) else fd_path = start end group by event_id""")
def many_patterns(spark, d):
    from tidewatch.functions import patterns

    wanted = [p for n in range(5000) for p in (f"/etc/f{n}*", f"/tmp/f{n}")]
    return patterns.first(env(spark, d), patterns.table(spark, wanted), "fd_path").select("event_id", "pattern")


@query("many_prefixes", WITH_ENV + """, w as (select '/etc/f' || n as start from (select unnest(range(0, 10000, 7)) as n) union all select '/tmp/f' || n from (select unnest(range(1, 10000, 11)) as n))
select event_id from env where exists (select 1 from w where starts_with(fd_path, start))""")
def many_prefixes(spark, d):
    dirs = (*[f"/etc/f{n}" for n in range(0, 10000, 7)], *[f"/tmp/f{n}" for n in range(1, 10000, 11)])
    e = env(spark, d)
    return e.where(rules.compile_(rules.parse("attributes.fd_path startswithin (dirs)", {"dirs": dirs}), e.columns)).select("event_id")


@query("enter_exit_pairs", WITH_ENV + """, c as (select tid, event_id, case when syscall_name in ('read', 'openat', 'execve') then 'enter' else 'exit' end as kind, ts_unix_nano as ts, seq from env),
l as (select *, lag({'kind': kind, 'id': event_id, 'ts': ts, 'seq': seq}) over w as b, lead(seq) over w as n from c window w as (partition by tid order by ts, seq)), m as (select tid, b, kind = 'exit' and ts - b.ts <= 90000000000000 as good, event_id from l where b.kind = 'enter')
select tid, b.id as entry, case when good then event_id end as exit from m union all select tid, event_id, null from l where n is null and kind = 'enter'""")
def enter_exit_pairs(spark, d):
    from tidewatch.streaming import pending

    kind = F.when(F.col("syscall_name").isin("read", "openat", "execve"), "enter").otherwise("exit")
    calls = env(spark, d).select("tid", kind.alias("kind"), "ts_unix_nano", "seq", F.col("event_id").alias("value"))
    return pending.pairs(calls, 90000000000000).select("tid", "entry", "exit")


@query("framed_round_trip", "select event_id, syscall_name, syscall_nr, ts_unix_nano, comm, coalesce(fd_path, '') as fd_path from env")
def framed_round_trip(spark, d):
    """The events written as framed logs by the committing sink, read again in ranges and parsed."""
    from tidewatch.session import scratch
    from tidewatch.sources import evt1, logs

    evt1.register(spark)
    e, path = env(spark, d), scratch(spark, "framed")
    columns = ["event_id", "hostname", "syscall_name", "event_group", "comm", "pid", "tid", "uid", "arg0", "arg1", "syscall_nr", "ts_unix_nano", "attributes"]
    evt1.payloads(e.select(columns)).write.format("evt1").option("maxBytes", 4 << 20).mode("append").save(path)
    back = logs.envelopes(spark.read.format("evt1").option("splitBytes", 1 << 20).load(path))
    return back.select("event_id", "syscall_name", F.col("syscall_nr").cast("int").alias("syscall_nr"), "ts_unix_nano", "comm", F.coalesce(F.try_element_at("attributes", F.lit("fd_path")), F.lit("")).alias("fd_path"))


@query("url_terms", "select page_id from pages where contains(lower(url), 'a') and contains(lower(url), '1')")
def url_terms(spark, d):
    u = F.lower("url")
    return table(spark, d, "pages").where(u.contains("a") & u.contains("1")).select("page_id")


# models with state. SQL says those whose score is a window over earlier rows; tests hold the formulas of the others
# against plain loops

_NAMES = ["arg1_norm", "path_hash", "return_errno_norm", "syscall_nr_norm"]


def _model_query(name: str, algorithm: str, sql: str | None = None, **params) -> None:
    @query(name, sql)
    def run(spark, d):
        from tidewatch.streaming import keyed

        return r6(keyed.score(features.extract(env(spark, d), _NAMES), algorithm, _NAMES, window=256, warmup=32, **params).drop("error"))


_ONE = "f as (select event_id, seq, ts_unix_nano, event_group, {}, malicious from env)".format(", ".join(f"cast({_FEATURES[n]} as double) as {n}" for n in _NAMES))
_PRIOR = "partition by event_group order by ts_unix_nano, seq rows between unbounded preceding and 1 preceding"
_ZS = ", ".join(f"coalesce(abs({n} - avg({n}) over w) / sqrt(greatest(coalesce(var_samp({n}) over w, 0), 1e-6)), 0)" for n in _NAMES)
_MODEL_Z = f", {_ONE}, r as (select *, case when count(*) over w < 20 then 0.0 else list_avg([{_ZS}]) end as raw from f window w as ({_PRIOR}))"
_RANKED = """, l as (select *, ln(1 + greatest(raw, 0)) as x, list(ln(1 + greatest(raw, 0))) over (partition by event_group order by ts_unix_nano, seq rows between 256 preceding and 1 preceding) as last from r),
p as (select *, case when coalesce(len(last), 0) < {} then 0.0 else len(list_filter(last, lambda v: round(v, 12) <= round(x, 12))) / len(last) end as percentile from l)"""
_KEYS = {"arg1_norm": "b", "path_hash": "h", "return_errno_norm": "b", "syscall_nr_norm": "b"}
_BIN = {"b": "case when {0} <= 0 then 0 when {0} >= 1 then 65535 else cast(floor({0} * 65536) as bigint) end", "h": "cast(floor({0} * 10000 + 1e-6) as bigint)"}
_MODEL_F = (
    f", {_ONE}, k as (select *, " + ", ".join(f"{_BIN[t].format(n)} as k{i}" for i, (n, t) in enumerate(_KEYS.items())) + " from f), c as (select *, count(*) over w as t, "
    + ", ".join(f"count(*) over w{i} as c{i}" for i in range(4)) + f" from k window w as ({_PRIOR}), " + ", ".join(f"w{i} as (partition by event_group, k{i} order by ts_unix_nano, seq rows between unbounded preceding and 1 preceding)" for i in range(4))
    + f"), s as (select *, greatest(2.0, coalesce(sum(case when c1 = 0 then 1 else 0 end) over ({_PRIOR}), 0) + 1.0) as n1, 65536.0 as n0, 65536.0 as n2, 65536.0 as n3 from c), r as (select *, ("
    + " + ".join(f"greatest(0, -ln((c{i} + 1) / (t + n{i})) - ln(n{i}))" for i in range(4)) + ") / 4 as raw from s)"
)
_SCORED = " select event_group, event_id, seq, round(raw, 6) as raw, round(1 - exp(-raw), 6) as scaled, round(percentile, 6) as percentile from p"
_KNN = f""", {_ONE}, m as (select *, list([{', '.join(_NAMES)}]) over (partition by event_group order by ts_unix_nano, seq rows between 1024 preceding and 1 preceding) as seen from f),
r as (select * exclude (seen), coalesce(list_avg(list_sort(list_transform(seen, lambda v: list_distance(v, [{', '.join(_NAMES)}])))[1:5]), 0.0) as raw from m)"""

_model_query("model_zscore", "zscore", WITH_ENV + _MODEL_Z + _RANKED.format(32) + _SCORED)
_model_query("model_freq1d", "freq1d", WITH_ENV + _MODEL_F + _RANKED.format(32) + _SCORED)
# weights by age: counts stand in units that shrink with the decay, until these are below 1e-6 at each 13809th row
_UNIT = "pow(0.999, (i - 1) - (i - 1) % 13809)"
_DECAYED = _MODEL_F.replace(" from f), c as (select *,", ", row_number() over (partition by event_group order by ts_unix_nano, seq) as i from f), c as (select *,")
_DECAYED = _DECAYED.replace("count(*) over w as t", f"coalesce(sum(pow(0.999, -i)) over w, 0) * {_UNIT} as t")
for _i in range(4):
    _DECAYED = _DECAYED.replace(f"count(*) over w{_i} as c{_i}", f"coalesce(sum(pow(0.999, -i)) over w{_i}, 0) * {_UNIT} as c{_i}")
_model_query("model_freq1d_decay", "freq1d", WITH_ENV + _DECAYED + _RANKED.format(32) + _SCORED, decay=0.999)
_model_query("model_copulatree", "copulatree")
_model_query("model_latentcluster", "latentcluster")
_model_query("model_knn", "knn", WITH_ENV + _KNN + _RANKED.format(32) + _SCORED)
_model_query("model_halfspacetrees", "halfspacetrees")
_model_query("model_kitnet", "kitnet", grace_map=200, grace_train=500)
_model_query("model_memstream", "memstream")
_model_query("model_loda_ema", "loda_ema")


@query("model_sequence_mlp")
def model_sequence_mlp(spark, d):
    from tidewatch.streaming import keyed

    return r6(keyed.sequence_scores(env(spark, d), "syscall_name", "event_group", 4))


@query("pipeline_single_model", WITH_ENV + _MODEL_F + _RANKED.format(128) + """, g as (select *, row_number() over (partition by event_group order by ts_unix_nano, seq) <= 200 as suppressed from p)
select event_id, event_group as group_key, round(case when suppressed then 0.0 else least(percentile, 1.0) end, 6) as score, not suppressed and percentile >= 0.98 as anomaly from g""")
def pipeline_single_model(spark, d):
    from tidewatch.plans import pipelines

    c = pipelines.Config(algorithm="freq1d", features=tuple(_NAMES), score_mode="percentile", threshold=0.98, warmup=200, percentile_window=256)
    return pipelines.build(env(spark, d), c).select("event_id", "group_key", F.round("score", 6).alias("score"), "anomaly")


@query("pipeline_fusion")
def pipeline_fusion(spark, d):
    from tidewatch.plans import pipelines

    return pipelines.build(env(spark, d), pipelines.Config(pipeline="las_gas_fusion", features=tuple(_NAMES), score_mode="scaled", warmup=200, ngram=4)).select("event_id", F.round("score", 6).alias("score"), "anomaly")


@query("attribution")
def attribution(spark, d):
    from tidewatch.streaming import keyed

    return r6(keyed.explain(features.extract(env(spark, d), _NAMES), "loda_ema", _NAMES, top=10))


_CELLS = ", ".join(f"count(*) filter (where scaled {o} t and {'' if y else 'not '}malicious) as {k}" for k, o, y in (("tp", ">=", 1), ("fp", ">=", 0), ("fn", "<", 1), ("tn", "<", 0)))


@query("eval_matrix", f"{WITH_ENV} {_MODEL_Z}, y as (select r2.* from (select 1) cross join (select 'zscore' as algorithm, 1 - exp(-raw) as scaled, malicious from r) r2), {_MODEL_F.replace(f', {_ONE}, k as', 'k as').replace(', r as (', ', rf as (').replace('from k window', 'from k window')}, z as (select * from y union all select 'freq1d', 1 - exp(-raw), malicious from rf) select algorithm, cast(t as double) as threshold, {_CELLS} from z, (select unnest([0.5, 0.9, 0.98]) as t) group by all")
def eval_matrix(spark, d):
    from tidewatch.plans import pipelines

    e = env(spark, d)
    return pipelines.eval_matrix(e, e.select("event_id", F.col("malicious").alias("positive")), ["zscore", "freq1d"], [0.5, 0.9, 0.98], _NAMES).drop("error", "seconds")


@query("eval_matrix_all")
def eval_matrix_all(spark, d):
    """Every algorithm, with one that can't run."""
    from tidewatch.operators.models import MODELS
    from tidewatch.plans import pipelines

    e = env(spark, d)
    return pipelines.eval_matrix(e, e.select("event_id", F.col("malicious").alias("positive")), [*sorted(MODELS), "unknown"], [0.5, 0.9, 0.98], _NAMES).drop("seconds")


@query("checkpoint_resume", WITH_ENV + _MODEL_Z + _RANKED.format(128).replace("between 256", "between 2048") + _SCORED + " where seq > (select max(seq) // 2 from env)")
def checkpoint_resume(spark, d):
    """Learn the first half, then score the second from the checkpoint: as if there were no break."""
    from tidewatch.streaming import keyed

    e = features.extract(env(spark, d), _NAMES)
    half = e.agg(F.expr("max(seq) div 2")).first()[0] or 0
    return r6(keyed.resume(e.where(F.col("seq") > half), keyed.train(e.where(F.col("seq") <= half), "zscore", _NAMES), _NAMES).drop("error"))


@query("word_vectors")
def word_vectors(spark, d):
    """The vectors that the sequence model reads, as they are when each token comes."""
    from tidewatch.streaming import keyed

    return keyed.token_vectors(env(spark, d), "syscall_name", "event_group").select("event_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("attribution_sanity")
def attribution_sanity(spark, d):
    from tidewatch.streaming import keyed

    return r6(keyed.sanity(features.extract(env(spark, d), _NAMES), "loda_ema", _NAMES, top=5))


@query("top_features")
def top_features(spark, d):
    from tidewatch.streaming import keyed

    return r6(keyed.top_features(keyed.explain(features.extract(env(spark, d), _NAMES), "loda_ema", _NAMES, top=10), 2))


# joins and selections of the logs

@query("prefilter", "select event_id from env where (syscall_nr = 257 and comm = 'bash') or (uid = '3' and starts_with(coalesce(fd_path, '-'), '/etc')) or pid = '7'")
def prefilter(spark, d):
    return rules.prefilter(env(spark, d), [{"syscall_nr": 257, "comm": "bash"}, {"uid": "3", "path_prefix": "/etc"}, {"pid": "7"}]).select("event_id")


@query("rules_by_number", "select event_id from env where syscall_nr in (0, 257, 87)")
def rules_by_number(spark, d):
    """Calls are known by number where they have no name."""
    r = rules.load({"groups": {"file": {"syscalls": ["read", "openat", "unlink"]}}, "rules": [{"name": "files", "group": "file"}]})
    return rules.classify(env(spark, d).withColumn("syscall_name", F.lit("")), r).select("event_id")


@query("inferred_groups", "select syscall_name, case when syscall_name in ('read', 'openat', 'unlink') then 'file' when syscall_name = 'connect' then 'network' else '' end as inferred, count(*) as n from env group by all")
def inferred_groups(spark, d):
    r = rules.load({"groups": {"file": {"syscalls": ["read", "openat", "unlink"]}}, "rules": [{"name": "files", "group": "file"}]})
    return env(spark, d).groupBy("syscall_name", rules.inferred_group(F.col("syscall_name"), r).alias("inferred")).agg(F.count(F.lit(1)).alias("n"))


@query("numbered_calls", "select event_id, case syscall_name when 'read' then 0 when 'execve' then 59 else -1 end as syscall_nr from env")
def numbered_calls(spark, d):
    return rules.numbered(env(spark, d), rules.call_numbers("#define __NR_read 0\n#define __NR_execve 59\n"), -1).select("event_id", "syscall_nr")


@query("or_flag", "select event_id, value > 150 or cast(event_id as bigint) in (select doc_id from labels where toxic = 1) as anomaly from env")
def or_flag(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("event_id"))
    return analytics.or_flag(env(spark, d).withColumn("anomaly", F.col("value") > 150), ids).select("event_id", "anomaly")


@query("matched_patterns", "with p as (select distinct fd_path from env where fd_path is not null) select '/etc/*' as pattern, count(*) as paths from p where starts_with(fd_path, '/etc/') union all select '/tmp/f?', count(*) from p where regexp_full_match(fd_path, '/tmp/f.')".replace("with p", WITH_ENV + ", p"))
def matched_patterns(spark, d):
    return analytics.matched_patterns(env(spark, d), ["/etc/*", "/tmp/f?", "/nowhere/*"])


@query("index_of", "select min(seq) as seq from env where event_id = '17'")
def index_of(spark, d):
    return analytics.index_of(env(spark, d), "17")


@query("network_rows", "select event_id from env where syscall_name = 'connect'")
def network_rows(spark, d):
    from tidewatch.sources import logs

    return logs.network_rows(env(spark, d), "syscall_name").select("event_id")


@query("csv_events", """select 'syn-' || seq as event_id, syscall_name, 1000000000 + seq * 1000000 as ts_unix_nano, syscall_nr, comm, pid, coalesce(fd_sock_remote_port, '') as port, coalesce(fd_path, '') as path,
    case when fd_sock_remote_port is null and comm = 'bash' then '1.2.3.4' else arg1 end as arg1, case when malicious then 1 else 0 end as evil from env""")
def csv_events(spark, d):
    from tidewatch.sources import logs

    rows = env(spark, d).select("seq", F.col("syscall_name").alias("eventName"), "syscall_nr", F.concat(F.lit(" "), "comm").alias("comm"), "pid", "tid", "uid", "arg0", "arg1", F.col("fd_path").alias("path"), F.col("fd_sock_remote_port").alias("sin_port"), F.col("malicious").cast("int").alias("evil"), F.when(F.col("comm") == "bash", "1.2.3.4").alias("sockaddr"))
    e = logs.csv_events(rows, "seq", 1_000_000_000, "syn")
    of = lambda k: F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit(""))
    return e.select("event_id", "syscall_name", "ts_unix_nano", "syscall_nr", "comm", "pid", of("fd_sock_remote_port").alias("port"), of("fd_path").alias("path"), "arg1", "evil")


@query("select_rows", WITH_ENV + """, r as (select event_id, malicious, row_number() over (partition by malicious order by md5('s:' || event_id), event_id) as i from env),
k as (select event_id, malicious, not malicious and i <= 100 as warm from r where i <= case when malicious then 20 else 180 end)
select event_id, malicious, case when warm then row_number() over (partition by warm order by md5('s:' || event_id), event_id) - 1 else 99 + row_number() over (partition by warm order by md5('s:tail:' || event_id), event_id) end as position from k""")
def select_rows(spark, d):
    return analytics.select_rows(env(spark, d), "malicious", ["event_id"], 200, 0.1, 0.5).select("event_id", "malicious", "position")


@query("score_records", WITH_ENV + _DECIDED.replace("event_group, {a}", "event_group, {a}") + """ select p.event_id, p.event_group, round(raw, 6) as score_raw, round(p.scaled, 6) as score_scaled, round(primary_, 6) as score_primary, 'scaled' as score_mode, suppressed as suppress_primary,
    cast(0.9 as double) as threshold, not suppressed and primary_ >= 0.9 as anomaly, env.malicious as expected_anomaly from p join env using (event_id)""")
def score_records(spark, d):
    from tidewatch.sources import logs

    return r6(logs.score_records(_decided(spark, d), "scaled", 0.9, "malicious").drop("syscall_name"))


@query("score_summary", WITH_ENV + _DECIDED + """, j as (select not suppressed and primary_ >= 0.9 as a, malicious as e from p join env using (event_id))
select count(*) as events_scored, count(*) filter (where a) as predicted_anomalies, count(e) as labeled_events, count(*) filter (where a and e) as tp, count(*) filter (where a and not e) as fp, count(*) filter (where not a and e) as fn, count(*) filter (where not a and not e) as tn, '{"threshold": 0.9}' as settings from j""")
def score_summary(spark, d):
    from tidewatch.sources import logs

    return logs.score_summary(logs.score_records(_decided(spark, d), "scaled", 0.9, "malicious"), {"threshold": 0.9})


@query("reasons", WITH_ENV + _DECIDED + " select event_id, printf('score %.3f >= 0.900', primary_) as reason from p where not suppressed and primary_ >= 0.9")
def reasons(spark, d):
    return _decided(spark, d).where("reason is not null").select("event_id", "reason")


@query("diagnostic_report", WITH_ENV + _DECIDED + """, q as (select count(*) as n, stddev_pop(scaled) as std, quantile_cont(scaled, 0.99) - quantile_cont(scaled, 0.5) as gap from p)
select n, round(std, 6) as std, round(gap, 6) as tail_gap, concat_ws('; ', case when std < 0.03 then 'scores spread little' end, case when gap < 0.08 then 'the upper tail is weak' end) as issues,
concat_ws('; ', case when std >= 0.03 then 'scores spread' end, case when gap >= 0.08 then 'there is an upper tail' end) as positives, 'mixed' as verdict from q""")
def diagnostic_report(spark, d):
    out = analytics.diagnostic_report(_decided(spark, d))
    return out.withColumns({c: F.array_join(c, "; ") for c in ("issues", "positives")})


@query("sql_functions", f"select event_id, round({H.format('comm')}, 6) as h, printf('%016x-%08x', ts_unix_nano // 1000, cast(pid as bigint)) as id from env")
def sql_functions(spark, d):
    features.register_sql(spark)
    return spark.sql("select event_id, round(hash01(comm), 6) as h, event_id_text(ts_unix_nano div 1000, cast(pid as bigint)) as id from {e}", e=env(spark, d))


@query("concat_features", f"select event_id, round({H.format('comm')}, 6) as a, cast(2 as double) as b, lower(trim(comm)) as c from env")
def concat_features(spark, d):
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    both = features.concat_features(m(a=F.lit(5.0), b=F.lit(1.0)), m(b=F.lit(2.0), a=features.hash01(F.col("comm"))), F.lit(None).cast("map<string,double>"))
    return r6(env(spark, d).select("event_id", both["a"].alias("a"), both["b"].alias("b"), features.field_text("comm").alias("c")))


@query("recordings", WITH_ENV + ", l as (select seq, recording_name, lag(recording_name) over (order by seq) as before from env) select cast(sum(case when before is null or before <> recording_name then 1 else 0 end) as bigint) as recordings from l")
def recordings(spark, d):
    """A recording begins wherever the name changes; each range of rows is looked at by itself, and its ends against its
    neighbours'."""
    return analytics.changes(env(spark, d), "recording_name").select(F.col("changes").alias("recordings"))


@query("event_ids", "select event_id, printf('%016x-%08x', epoch_us(ts), user_id) as id from events")
def event_ids(spark, d):
    e = env(spark, d)
    return e.select(F.col("seq").alias("event_id"), features.event_id(F.expr("ts_unix_nano div 1000"), F.col("pid")).alias("id"))


@query("inherited_paths", """with recursive o as (select user_id as pid, cast(json_extract_string(props, '$.k') as bigint) % 4 as fd, min(event_id) as path from events where event_type = 'click' group by all),
p as (select distinct user_id as pid, user_id // 2 as ppid from events), up as (select pid, pid as anc, 0 as hop from p union all select up.pid, p.ppid, up.hop + 1 from up join p on up.anc = p.pid where up.hop < 8 and p.ppid <> p.pid),
r as (select up.pid, o.fd, o.path, up.hop, row_number() over (partition by up.pid, o.fd order by up.hop) as rn from up join o on up.anc = o.pid)
select pid, fd, path, hop from r where rn = 1""")
def inherited_paths(spark, d):
    from tidewatch.operators import lineage

    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    opened = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("pid"), (k % 4).alias("fd")).agg(F.min("event_id").alias("path"))
    return lineage.inherited_paths(opened, e.select(F.col("user_id").alias("pid"), F.expr("user_id div 2").alias("ppid")).distinct())


def _calls(spark, d):
    """The events as calls on file numbers: opens, closes, reads and connects of a few numbers a process."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "read", "click", "openat", "signup", "close", "purchase", "connect")]), F.col("event_type"))
    fd = k % 3
    value = F.when(kind == "openat", F.when(k % 11 == 0, -2).otherwise(fd)).when(kind == "connect", F.when(k % 7 == 0, -111).otherwise(0)).otherwise(0)
    return e.select(
        F.col("event_id"), F.col("user_id").alias("pid"), F.coalesce(kind, F.lit("write")).alias("syscall_name"), fd.alias("fd"), value.alias("return_value"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_unix_nano"), F.col("event_id").alias("seq"),
        F.concat(F.lit("/p"), k.cast("string")).alias("path"), F.when(k % 5 == 0, "AF_UNIX").otherwise("AF_INET").alias("family"), F.concat(F.lit("10.0.0."), k.cast("string")).alias("addr"), (k + 1024).cast("string").alias("port"),
    )


_CALLS = """with x as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
calls as (select event_id, user_id as pid, case event_type when 'view' then 'read' when 'click' then 'openat' when 'signup' then 'close' when 'purchase' then 'connect' else 'write' end as call, k % 3 as fd, ts, k from x),
marks as (select pid, fd, ts, event_id, case when call = 'openat' then '/p' || k end as v from calls where call = 'close' or (call = 'openat' and k % 11 <> 0)),
peers as (select pid, fd, ts, event_id, case when call = 'connect' then '10.0.0.' || k || ':' || (k + 1024) end as v from calls where call = 'close' or (call = 'connect' and k % 7 <> 0 and k % 5 <> 0)),
"""
_HELD = "select c.event_id, arg_max({'v': m.v}, (m.ts, m.event_id)).v as v from c join %s m on m.pid = c.pid and m.fd = c.fd and (m.ts, m.event_id) < (c.ts, c.event_id) group by 1"


@query("fd_paths", _CALLS + f"c as (select * from calls where call in ('read', 'write')), h as ({_HELD % 'marks'}) select event_id, v as open_path from c left join h using (event_id)")
def fd_paths(spark, d):
    from tidewatch.operators import lineage

    calls = _calls(spark, d)
    return lineage.as_of(calls.where(F.col("syscall_name").isin("read", "write")), lineage.path_marks(calls), out="open_path").select("event_id", "open_path")


@query("fd_peers", _CALLS + f"c as (select * from calls where call in ('read', 'write')), h as ({_HELD % 'peers'}) select event_id, v as peer from c left join h using (event_id)")
def fd_peers(spark, d):
    from tidewatch.operators import lineage

    calls = _calls(spark, d)
    out = lineage.as_of(calls.where(F.col("syscall_name").isin("read", "write")), lineage.peer_marks(calls), out="peer")
    return out.select("event_id", F.concat("peer.addr", F.lit(":"), "peer.port").alias("peer"))


@query("fd_inherited", _CALLS.replace("with x", "with recursive x") + f"""p as (select distinct user_id as pid, user_id // 2 as ppid from events), up as (select pid, pid as anc, 0 as hop from p union all select up.pid, p.ppid, up.hop + 1 from up join p on up.anc = p.pid where up.hop < 7 and p.ppid <> p.pid),
c as (select event_id * 8 + hop as event_id, calls.event_id as id, up.anc as pid, fd, ts, hop from calls join up on up.pid = calls.pid where call in ('read', 'write')),
h as ({(_HELD % 'marks').replace('(c.ts, c.event_id)', '(c.ts, c.id)')}), g as (select id, arg_min(v, hop) as v, min(hop) as hop from c join h using (event_id) where v is not null group by id)
select calls.event_id, v as open_path, coalesce(cast(hop as bigint), -1) as hop from calls left join g on g.id = calls.event_id where call in ('read', 'write')""")
def fd_inherited(spark, d):
    from tidewatch.operators import lineage

    calls = _calls(spark, d)
    parents = calls.select("pid", F.expr("pid div 2").alias("ppid")).distinct()
    out = lineage.inherited(calls.where(F.col("syscall_name").isin("read", "write")), lineage.path_marks(calls), parents, out="open_path")
    return out.select("event_id", "open_path", F.coalesce(F.col("hop").cast("long"), F.lit(-1)).alias("hop"))


@query("rule_of_sql", WITH_ENV + _CLASSIFIED + " select event_id, rule from hit")
def rule_of_sql(spark, d):
    """The classifier as a function of SQL."""
    rules.register_sql(spark, rules.load(RULES))
    e = env(spark, d)
    given = ", ".join(p if p in e.columns else "cast(null as string)" for p in rules.PARAMETERS)
    return spark.sql(f"select event_id, rule_of({given}) as rule from {{e}}", e=e)


@query("flags_sql", """with k as (select event_id, cast(json_extract_string(props, '$.k') as bigint) * 37 % 2048 as v from events), m as (select event_id, v, ['O_RDONLY', 'O_WRONLY', 'O_RDWR', null][v % 4 + 1] as mode from k)
select event_id, coalesce(nullif(concat_ws('|', mode, case when v & 64 <> 0 then 'O_CREAT' end, case when v & 512 <> 0 then 'O_TRUNC' end, case when v & 1024 <> 0 then 'O_APPEND' end, case when v & 128 <> 0 then 'O_EXCL' end), ''), '0') as flags from m""")
def flags_sql(spark, d):
    features.register_sql(spark)
    e = table(spark, d, "events")
    return spark.sql("select event_id, flags_text(257, cast(get_json_object(props, '$.k') as bigint) * 37 % 2048) as flags from {e}", e=e)


@query("since_last_poll", "with p as (select event_type as source, event_id // 1000 as poll_s, max(event_id) - case when event_id // 1000 = 5 then 4000 else 0 end as total, count(*) as recent from events group by event_type, event_id // 1000), l as (select *, lag(total) over (partition by source order by poll_s) as b from p) select source, poll_s, case when b is null or total < b then recent else total - b end as new from l")
def since_last_poll(spark, d):
    p = table(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.expr("event_id div 1000").alias("poll_s")).agg(F.max("event_id").alias("m"), F.count(F.lit(1)).alias("recent"))
    return analytics.since_last(p.withColumn("total", F.col("m") - F.when(F.col("poll_s") == 5, 4000).otherwise(0)))


@query("counters", WITH_ENV + _DECIDED.replace("select event_id, seq, ts_unix_nano, event_group,", "select event_id, seq, ts_unix_nano, event_group,") + " select event_group, count(*) as events, count(*) filter (where not suppressed and primary_ >= 0.9) as anomalies, cast(0 as bigint) as errors, max(ts_unix_nano) as last from p group by 1")
def counters(spark, d):
    return analytics.counters(_decided(spark, d))


@query("principal_components")
def principal_components(spark, d):
    out = analytics.principal_components(table(spark, d, "embeddings"), "embedding", 2)
    return out.select("vec_id", *[F.round(F.abs(F.get("pc", F.lit(i))), 6).alias(f"pc{i}") for i in range(2)])


@query("model_diagnostics")
def model_diagnostics(spark, d):
    from tidewatch.streaming import keyed

    return r6(keyed.diagnose(keyed.train(features.extract(env(spark, d), _NAMES), "memstream", _NAMES)))
