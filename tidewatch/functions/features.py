"""Numeric features of events as Column expressions, all in [0, 1]."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NS_PER_DAY = 86_400_000_000_000
#: Path prefixes used where a group's rules give none.
SENSITIVE, TEMPORARY = ("/etc", "/root", "/proc", "/sys", "/boot"), ("/tmp", "/var/tmp", "/dev/shm")


def number(c: Column) -> Column:
    """As an integer; what isn't one is 0."""
    return F.coalesce(c.cast("string").try_cast("bigint"), F.lit(0)).cast("double")


def attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def hash01_raw(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") % 10000 / 10000.0


def hash01(c: Column) -> Column:
    """The first eight hex digits of md5, modulo 10000, over 10000; empty and missing give 0."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0.0)).otherwise(hash01_raw(c))


def ratio(c: Column, most: float) -> Column:
    return F.least(F.greatest(number(c), F.lit(0.0)) / most, F.lit(1.0))


def log_ratio(c: Column, most: float) -> Column:
    return F.least(F.log1p(F.abs(number(c))) / most, F.lit(1.0))


def parts(path: Column) -> Column:
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")


def starts(path: Column, prefixes: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.coalesce(F.greatest(*[low.startswith(p).cast("double") for p in prefixes], F.lit(0.0)), F.lit(0.0))


def _registry() -> dict[str, Column]:
    ns, path, rv = F.col("ts_unix_nano"), attribute("fd_path"), attribute("return_value")
    day = F.pmod(ns, F.lit(NS_PER_DAY)).cast("double") / float(NS_PER_DAY)
    dom = F.dayofmonth(F.timestamp_micros(F.expr("ts_unix_nano div 1000")))
    is_socket = F.col("syscall_name") == "socket"
    family = F.upper(F.coalesce(attribute("fd_sock_family"), F.lit("")))
    fam = F.when(is_socket, number(F.col("arg0"))).when(family.contains("INET6") | (family == "10"), 10.0).when(family.contains("INET") | (family == "2"), 2.0).otherwise(0.0)
    return {
        "pid_norm": ratio(F.col("pid"), 4194304.0), "tid_norm": ratio(F.col("tid"), 4194304.0), "uid_norm": ratio(F.col("uid"), 4294967295.0),
        "arg0_norm": log_ratio(F.col("arg0"), 20.0), "arg1_norm": log_ratio(F.col("arg1"), 20.0),
        "path_depth_norm": F.least(F.size(parts(path)) / 20.0, F.lit(1.0)),
        "return_success": (number(rv) >= 0).cast("double"), "return_errno_norm": log_ratio(rv, 12.0),
        "hostname_hash": hash01(F.col("hostname")), "pid_hash": hash01(F.coalesce("pid", F.lit("0"))), "path_hash": hash01(path),
        "path_prefix_hash": hash01(F.get(parts(path), F.lit(0))), "syscall_nr_norm": ratio(F.col("syscall_nr"), 500.0),
        "day_fraction_norm": day, "day_cycle_sin": F.sin(day * 2 * math.pi), "day_cycle_cos": F.cos(day * 2 * math.pi),
        "week_of_month_norm": (F.least(F.lit(4), F.floor((dom - 1) / 7) + 1) - 1) / 3.0,
        "file_sensitive_path": starts(path, SENSITIVE), "file_tmp_path": starts(path, TEMPORARY), "file_flags_hash": hash01(attribute("flags")),
        "net_socket_family_norm": F.least(F.greatest(fam, F.lit(0.0)) / 10.0, F.lit(1.0)), "net_dport_norm": ratio(attribute("fd_sock_remote_port"), 65535.0),
        "net_socket_type_hash": hash01(F.when(is_socket, F.col("arg1")).otherwise(F.lit("0"))),
        "net_daddr_hash": hash01(attribute("fd_sock_remote_addr")), "net_af_hash": hash01(attribute("fd_sock_family")),
    }


#: Feature sets by the family of model they feed.
SETS = {
    "default": ("syscall_nr_norm", "day_cycle_sin", "day_cycle_cos"),
    "frequency": ("syscall_nr_norm", "day_fraction_norm", "hostname_hash", "pid_hash", "path_hash", "path_prefix_hash", "net_socket_type_hash", "net_daddr_hash", "net_af_hash"),
    "tabular": (
        "syscall_nr_norm", "pid_norm", "tid_norm", "uid_norm", "arg0_norm", "arg1_norm", "day_cycle_sin", "day_cycle_cos", "week_of_month_norm", "path_depth_norm", "path_prefix_hash",
        "return_success", "return_errno_norm", "file_sensitive_path", "file_tmp_path", "file_flags_hash", "net_socket_family_norm", "net_dport_norm",
    ),
    "network": ("net_daddr_hash", "net_dport_norm", "net_socket_family_norm"),
}


def features_for(algorithm: str) -> tuple[str, ...]:
    """The set that feeds an algorithm unless told otherwise; sequence models take their own context vectors, which
    ``native.context`` makes, so no feature of the event."""
    if algorithm in ("sequence_mlp", "sequence_transformer"):
        return ()
    return SETS["frequency" if algorithm in ("freq1d", "copulatree", "latentcluster", "zscore") else "default"]


def names() -> list[str]:
    return list(_registry())


def extract(events: DataFrame, wanted: list[str], prefixes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Append the features asked for; ``name*`` asks for all that begin so. A day's sine and cosine come together."""
    known = _registry()
    if prefixes:
        path = attribute("fd_path")
        known["file_sensitive_path"] = starts(path, prefixes.get("sensitive_paths", SENSITIVE))
        known["file_tmp_path"] = starts(path, prefixes.get("tmp_paths", TEMPORARY))
    chosen: dict[str, Column] = {}
    for w in wanted:
        hits = [n for n in known if n == w or (w.endswith("*") and n.startswith(w[:-1]))]
        if not hits:
            raise ValueError(f"unknown feature {w!r}")
        if any(h.startswith("day_cycle") for h in hits):
            hits += ["day_cycle_sin", "day_cycle_cos"]
        chosen.update({h: known[h] for h in hits})
    return events.withColumns(chosen)


def field_text(name: str) -> Column:
    """A field as blocks read it: trimmed and in lower case, empty if missing."""
    return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))


def concat_features(*maps: Column) -> Column:
    """One map of several; of a name that more than one has, the last counts. Null maps have nothing."""
    out = empty = F.create_map().cast("map<string,double>")
    for m in maps:
        m = F.coalesce(m, empty)
        out = F.map_concat(F.map_filter(out, _not_in(m)), m)
    return out


def _not_in(m: Column) -> Callable[[Column, Column], Column]:
    return lambda k, _: ~F.map_contains_key(m, k)


def register_sql(spark: SparkSession) -> None:
    """hash01(text), event_id_text(micros, counter) and flags_text(call number, value) as functions of this session's SQL, in
    SQL themselves. ``rules.register_sql`` adds the classifier of a rule set."""
    spark.sql("create or replace temporary function hash01(x string) returns double return case when coalesce(x, '') = '' then 0.0 else cast(conv(substring(md5(x), 1, 8), 16, 10) as bigint) % 10000 / 10000.0 end")
    spark.sql("create or replace temporary function event_id_text(micros bigint, counter bigint) returns string return format_string('%016x-%08x', micros, counter)")
    spark.sql(f"create or replace temporary function flags_text(nr bigint, value bigint) returns string return {flags_sql('nr', 'value')}")


#: open(2) flag bits and socket(2) types, in the order in which they are named.
OPEN_MODES = {0: "O_RDONLY", 1: "O_WRONLY", 2: "O_RDWR"}
OPEN_BITS = {"O_CREAT": 64, "O_TRUNC": 512, "O_APPEND": 1024, "O_CLOEXEC": 524288, "O_EXCL": 128, "O_DIRECTORY": 65536, "O_NOFOLLOW": 131072, "O_SYNC": 1052672, "O_DSYNC": 4096}
SOCKET_TYPES = {1: "SOCK_STREAM", 2: "SOCK_DGRAM", 3: "SOCK_RAW", 4: "SOCK_RDM", 5: "SOCK_SEQPACKET", 6: "SOCK_DCCP", 10: "SOCK_PACKET"}
SOCKET_BITS = {"SOCK_CLOEXEC": 524288, "SOCK_NONBLOCK": 2048}
OPEN_CALLS, SOCKET_CALL = (2, 257, 437), 41


def flags_sql(nr: str, value: str) -> str:
    """The SQL text of ``decode_flags`` over two bigint expressions."""
    pick = lambda of, names, other: f"case {of} " + " ".join(f"when {k} then '{n}'" for k, n in names.items()) + f" else {other} end"
    bits = lambda names: ", ".join(f"case when {value} & {b} <> 0 then '{n}' end" for n, b in names.items())
    opened = f"coalesce(nullif(concat_ws('|', {pick(f'{value} & 3', OPEN_MODES, 'null')}, {bits(OPEN_BITS)}), ''), '0')"
    socket = f"concat_ws('|', {pick(f'{value} & 255', SOCKET_TYPES, f'cast({value} & 255 as string)')}, {bits(SOCKET_BITS)})"
    return f"case when {value} is null then null when {nr} in {OPEN_CALLS} then {opened} when {nr} = {SOCKET_CALL} then {socket} end"


def decode_flags(nr: Column, value: Column) -> Column:
    """Open flags of calls 2, 257 and 437: the access mode, then the bits (``0`` if there is nothing to name); the type,
    or its number, and bits of 41; null for other calls and for values that are no numbers."""
    v = value.cast("string").try_cast("bigint")
    bit = lambda names: [F.when(v.bitwiseAND(F.lit(b).cast("bigint")) != 0, F.lit(n)) for n, b in names.items()]

    def kind(mask: int, names: dict[int, str], other: Column) -> Column:
        of = v.bitwiseAND(F.lit(mask).cast("bigint"))
        return F.coalesce(*[F.when(of == k, F.lit(n)) for k, n in names.items()], other)

    opened = F.concat_ws("|", kind(3, OPEN_MODES, F.lit(None).cast("string")), *bit(OPEN_BITS))
    socket = F.concat_ws("|", kind(255, SOCKET_TYPES, v.bitwiseAND(F.lit(255).cast("bigint")).cast("string")), *bit(SOCKET_BITS))
    return F.when(nr.isin(*OPEN_CALLS) & v.isNotNull(), F.coalesce(F.nullif(opened, F.lit("")), F.lit("0"))).when((nr == SOCKET_CALL) & v.isNotNull(), socket)


def event_id(micros: Column, counter: Column) -> Column:
    """Microseconds and a counter in hex, so that ids sort by time."""
    return F.format_string("%016x-%08x", micros.cast("bigint"), counter.cast("bigint"))


def epoch_ns(since_boot_ns: Column, boot_ns: Column) -> Column:
    return since_boot_ns.cast("bigint") + boot_ns.cast("bigint")


def fd_attributes(syscall: Column, path: Column, remote: Column) -> Column:
    """What is known of a file number: socket over path; read and write without one have an empty path."""
    pairs = F.array(
        F.struct(F.lit("fd_path").alias("key"), F.when(F.coalesce(path, F.lit("")) != "", path).when(syscall.isin("read", "write"), F.lit("")).alias("value")),
        F.struct(F.lit("fd_sock_remote_addr").alias("key"), remote.alias("value")),
        F.struct(F.lit("fd_resource_kind").alias("key"), F.when(F.coalesce(remote, F.lit("")) != "", "tcp").when(F.coalesce(path, F.lit("")) != "", "file").otherwise("unknown").alias("value")),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
