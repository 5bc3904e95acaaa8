"""Fields of traced calls as other tools print them, as Column expressions: file numbers with their paths, socket
tuples, base64 arguments, labels of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def param(params: Column, name: str) -> Column:
    return _none(F.try_element_at(params, F.lit(name)))


def maybe_base64(c: Column) -> Column:
    """Decoded, if it is well-formed base64 of text that is mostly printable; else as it is."""
    well = c.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (F.length(c) > 0)
    raw = F.when(well, F.try_to_binary(c, F.lit("base64")))
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    printable = F.length(F.regexp_replace(text, r"[\p{Cntrl}&&[^\t\n\r]]", ""))
    return F.when(text.isNotNull() & (F.length(text) > 0) & (printable > 0.8 * F.length(text)), text).otherwise(c)


def strip_fd(c: Column) -> Column:
    """``36(<f>/p)`` gives ``36``; suffixes of another form stay."""
    return F.coalesce(_none(F.regexp_extract(c, r"^(-?\d+)\(<", 1)), c)


def strip_number(c: Column) -> Column:
    """``N(anything)`` gives ``N``."""
    return F.coalesce(_none(F.regexp_extract(c, r"^(-?\d+)\(.*\)$", 1)), c)


def fd_path(params: Column) -> Column:
    """The path in the first of fd, in_fd, out_fd and arg0 that names a file."""
    return F.coalesce(*[_none(F.regexp_extract(F.try_element_at(params, F.lit(p)), r"<f>(.*)\)", 1)) for p in ("fd", "in_fd", "out_fd", "arg0")])


def host_port(c: Column) -> Column:
    """struct(host, port); IPv6 hosts stand in brackets."""
    six = F.regexp_extract(c, r"^\[([^\]]+)\]:(\d+)$", 1)
    host = F.when(six != "", six).otherwise(_none(F.regexp_extract(c, r"^([^\[\]]*):(\d+)$", 1)))
    return F.struct(host.alias("host"), _none(F.regexp_extract(c, r":(\d+)$", 1)).alias("port"))


_TUPLE = r"\(<([46])(\w?)>(\S+?)->(\S+?)\)"


def socket_tuple(c: Column) -> Column:
    """Map of socket attributes of a ``(<4t>a:p->b:q)`` tuple; null if there is none."""
    family, proto = F.regexp_extract(c, _TUPLE, 1), F.regexp_extract(c, _TUPLE, 2)
    local, remote = host_port(F.regexp_extract(c, _TUPLE, 3)), host_port(F.regexp_extract(c, _TUPLE, 4))
    pairs = F.array(
        F.struct(F.lit("fd_sock_family").alias("k"), F.when(family == "6", "AF_INET6").otherwise("AF_INET").alias("v")),
        F.struct(F.lit("fd_resource_kind").alias("k"), F.when(proto == "u", "udp").when(proto == "t", "tcp").otherwise("unknown").alias("v")),
        F.struct(F.lit("fd_sock_local_addr").alias("k"), local["host"].alias("v")), F.struct(F.lit("fd_sock_local_port").alias("k"), local["port"].alias("v")),
        F.struct(F.lit("fd_sock_remote_addr").alias("k"), remote["host"].alias("v")), F.struct(F.lit("fd_sock_remote_port").alias("k"), remote["port"].alias("v")),
    )
    return F.when(family != "", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())))


def merge_first(maps: list[Column]) -> Column:
    """The first non-empty value of each key."""
    empty = F.create_map().cast("map<string,string>")
    entries = F.flatten(F.array(*[F.map_entries(F.map_filter(F.coalesce(m, empty), lambda _, v: v != "")) for m in maps]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"]))


def resource_kind(attributes: Column, fd: Column) -> Column:
    """socket over path over pipe tag over unknown."""
    has = lambda k: F.coalesce(F.try_element_at(attributes, F.lit(k)), F.lit("")) != ""
    told = _none(F.try_element_at(attributes, F.lit("fd_resource_kind")))
    return F.when(has("fd_sock_family") | has("fd_sock_remote_addr"), F.coalesce(F.nullif(told, F.lit("unknown")), F.lit("tcp"))).when(has("fd_path"), "file").when(F.coalesce(fd.contains("<p>"), F.lit(False)), "pipe").otherwise("unknown")


#: The parameters that arguments and return values are taken from, the first that is there.
RETURNS = ("res", "ret", "retval", "return", "return_value")
ARGUMENTS = {0: ("arg0", "fd", "dirfd", "domain", "flags", "oldfd"), 1: ("arg1", "cmd", "flags", "type", "addrlen", "newfd")}
OF_CALL = {
    0: {"socket": ("domain", "family", "fd", "dirfd"), "open": ("flags", "fd", "dirfd"), "openat": ("dirfd", "fd"), "openat2": ("dirfd", "fd")},
    1: {**dict.fromkeys(("connect", "bind", "accept", "accept4", "listen"), ("addrlen", "backlog", "type")), "socket": ("type", "flags"), "openat": ("flags", "mode"), "openat2": ("flags", "mode"), "open": ("mode",)},
}
ATTRIBUTES = {"fd_sock_remote_port": ("sin_port", "dest_port"), "fd_sock_remote_addr": ("sin_addr", "dest_ip"), "fd_sock_local_port": ("sin_local_port", "src_port"), "fd_sock_local_addr": ("sin_local_addr", "src_ip", "src_addr"), "fd_sock_family": ("sa_family", "family")}


def argument(name: Column, params: Column, which: int) -> Column:
    """arg0 or arg1 of a call: a parameter of that very name, even if empty; else the call's own parameters, or for
    calls without such the generic ones; else empty. Suffixes of numbers go."""
    call, first = F.lower(F.trim(name)), lambda ps: F.coalesce(*[param(params, p) for p in ps], F.lit(""))
    out = first(ARGUMENTS[which])
    for c, keys in OF_CALL[which].items():
        out = F.when(call == c, first(keys)).otherwise(out)
    return strip_number(strip_fd(F.coalesce(F.try_element_at(params, F.lit(f"arg{which}")), out)))


def attributes(name: Column, params: Column, direction: Column) -> Column:
    """Map of what the parameters say: the return value of calls that end, flags (of mmap also from a decorated
    argument), addresses and ports of sockets. Empty values are left out."""
    mapped = param(params, "arg1")
    flags = F.coalesce(param(params, "flags"), F.when((F.lower(F.trim(name)) == "mmap") & mapped.contains("("), mapped))
    pairs = {"return_value": F.when(direction == "<", F.coalesce(*[F.try_element_at(params, F.lit(p)) for p in RETURNS])), "flags": flags}
    pairs |= {k: F.coalesce(*[param(params, p) for p in ps]) for k, ps in ATTRIBUTES.items()}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def roles(containers: Column) -> Column:
    """Map of normalised address to role of an array of structs (ip, role); the last of an address counts."""
    plain = F.transform(containers, lambda c: F.struct(_address(c["ip"]).alias("key"), F.lower(F.trim(F.coalesce(c["role"], F.lit("")))).alias("value")))
    return F.aggregate(F.filter(plain, lambda e: (e["key"] != "") & (e["value"] != "")), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))


def _address(c: Column) -> Column:
    raw = F.trim(F.coalesce(c, F.lit("")))
    return F.lower(F.coalesce(_none(F.trim(F.regexp_extract(raw, r"^\[([^\]]*)\]", 1))), raw))


def convert(calls: DataFrame, hostname: str, numbers: dict[str, int] | None = None, unknown: int = 0) -> DataFrame:
    """Whole events of traced calls: name, params (map), direction (> or <), ts_unix_nano, process, pid, tid, uid, and
    of the recording recording_name, exploit, exploit_times and containers; further columns pass through."""
    params, call = F.col("params"), F.lower(F.trim(F.coalesce("name", F.lit(""))))
    tuples = [socket_tuple(F.try_element_at(params, F.lit(p))) for p in ("fd", "in_fd", "out_fd", "arg0")]
    df = calls.withColumns({"syscall_name": call, "path__": fd_path(params), "told__": attributes(call, params, F.col("direction"))})
    empty = F.create_map().cast("map<string,string>")
    path = F.when(F.col("path__").isNotNull(), F.create_map(F.lit("fd_path"), F.col("path__"))).otherwise(empty)
    df = df.withColumn("told__", merge_first([F.col("told__"), *tuples, path]))
    fd = F.coalesce(param(params, "fd"), param(params, "arg0"), F.lit(""))
    kind = F.create_map(F.lit("fd_resource_kind"), resource_kind(F.col("told__"), fd))
    df = df.withColumn("attributes", F.map_concat(F.map_filter("told__", lambda k, _: k != "fd_resource_kind"), kind))
    of = roles(F.col("containers"))
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c)
    nr = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (numbers or {"": unknown}).items() for x in kv]), F.col("syscall_name")), F.lit(unknown)).cast("long")
    keep = [c for c in calls.columns if c not in {"name", "params", "direction", "process", "pid", "tid", "uid", "exploit", "exploit_times", "containers", "ts_unix_nano"}]
    return df.select(
        *keep, "ts_unix_nano", F.lit(hostname).alias("hostname"), "syscall_name", nr.alias("syscall_nr"), F.coalesce("process", F.lit("")).alias("comm"), text("pid", "0"), text("tid", "0"), text("uid", "0"),
        argument(F.col("syscall_name"), params, 0).alias("arg0"), argument(F.col("syscall_name"), params, 1).alias("arg1"), "attributes", malicious(F.col("exploit"), F.col("exploit_times"), F.col("ts_unix_nano")).alias("malicious"),
        F.coalesce(F.try_element_at(of, _address(F.try_element_at("attributes", F.lit("fd_sock_local_addr")))), F.lit("")).alias("local_role"), F.coalesce(F.try_element_at(of, _address(F.try_element_at("attributes", F.lit("fd_sock_remote_addr")))), F.lit("")).alias("remote_role"),
    )


def malicious(exploit: Column, times: Column, ts_ns: Column) -> Column:
    """Null without metadata; false if no exploit; true without times; else from the earliest exploit time on."""
    return F.when(exploit.isNull(), F.lit(None).cast("boolean")).when(~exploit, F.lit(False)).when(F.coalesce(F.size(times), F.lit(0)) <= 0, F.lit(True)).otherwise(ts_ns >= F.array_min(times) * 1e9)


def role(address: Column, roles: Column) -> Column:
    """Of a container, by its normalised address."""
    plain = F.regexp_replace(F.lower(F.trim(address)), "^::ffff:", "")
    return F.try_element_at(roles, plain)


def safe_id(c: Column) -> Column:
    """Letters and digits of any script stay."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")
