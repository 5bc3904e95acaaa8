"""Event logs as DataFrames: framed binary logs, JSON lines, labels, scored records, legacy rows, metrics text.

The readers take paths that Spark resolves, so they work on any store that it reads.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC, GZIP = b"EVT1", b"\x1f\x8b"
_TEXT = ("event_id", "hostname", "pod", "namespace", "container_id", "syscall_name", "event_group", "comm", "pid", "tid", "uid", "arg0", "arg1")
ENVELOPE = T.StructType([T.StructField(n, T.StringType()) for n in _TEXT] + [
    T.StructField("pod_name", T.StringType()), T.StructField("event_name", T.StringType()), T.StructField("syscall_nr", T.StringType()),
    T.StructField("ts_unix_nano", T.LongType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
])


def frames(raw: bytes, permissive: bool = False) -> Iterator[bytes]:
    """The records of a framed log: magic, length (uint32, little endian), payload. A record cut off at the end ends
    the log; another magic is an error, or the end if ``permissive``."""
    raw = gzip.decompress(raw) if raw[:2] == GZIP else raw
    at = 0
    while at + 8 <= len(raw):
        if raw[at : at + 4] != MAGIC:
            if permissive:
                return
            raise ValueError(f"no record at byte {at}")
        (n,) = struct.unpack_from("<I", raw, at + 4)
        if at + 8 + n > len(raw):
            return
        yield raw[at + 8 : at + 8 + n]
        at += 8 + n


def frame(payload: bytes) -> bytes:
    return MAGIC + struct.pack("<I", len(payload)) + payload


def sniff(head: bytes) -> str:
    """evt1 or jsonl, from a file's first bytes, compressed or not."""
    if head[:2] == GZIP:
        import zlib

        head = zlib.decompressobj(31).decompress(head, 4)
    return "evt1" if head[:4] == MAGIC else "jsonl"


def evt1(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """file, seq, value: the JSON texts of framed logs in any store that Spark reads. A file is read by one task; the data source
    of ``evt1`` reads ranges of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(file, i, p.decode()) for i, p in enumerate(frames(raw, permissive))]
                yield pd.DataFrame(rows, columns=["file", "seq", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, seq long, value string")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "")


def envelopes(lines: DataFrame) -> DataFrame:
    """Parsed events; lines that are no JSON objects, or have no event_id (as headers don't), are left out. Absent
    strings are empty, the old names pod_name and event_name count where the new ones are absent, and syscall
    numbers are clamped to 32 bits, 0 if they aren't numbers."""
    e = lines.withColumn("e", F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE"})).where(F.col("e.event_id").isNotNull())
    text = {n: F.coalesce(F.col(f"e.{n}"), F.lit("")) for n in _TEXT}
    text["pod"] = F.coalesce("e.pod", "e.pod_name", F.lit(""))
    text["syscall_name"] = F.coalesce("e.syscall_name", "e.event_name", F.lit(""))
    nr = F.least(F.greatest(F.coalesce(F.col("e.syscall_nr").try_cast("bigint"), F.lit(0)), F.lit(0)), F.lit(4294967295))
    keep = [c for c in lines.columns if c != "value"]
    return e.select(*keep, *[c.alias(n) for n, c in text.items()], nr.alias("syscall_nr"), F.coalesce("e.ts_unix_nano", F.lit(0)).alias("ts_unix_nano"), F.coalesce("e.attributes", F.create_map().cast("map<string,string>")).alias("attributes"))


def bounded(events: DataFrame, start_ms: int | None = None, end_ms: int | None = None, skip: int = 0, most: int | None = None, stop: bool = False, seq: str = "seq") -> DataFrame:
    """Time filter, then skip, then limit, by sequence number. stop: the log ends at its first event behind end_ms,
    as framed logs are read; otherwise later ones are left out one by one."""
    ms = F.expr("ts_unix_nano div 1000000")
    if stop and end_ms is not None:
        first = events.where(ms > end_ms).agg(F.min(seq).alias("__end"))
        events = events.join(F.broadcast(first), F.col("__end").isNull() | (F.col(seq) < F.col("__end"))).drop("__end")
    out = events.where((ms >= start_ms) if start_ms is not None else F.lit(True)).where((ms <= end_ms) if end_ms is not None else F.lit(True))
    out = out.orderBy(seq).offset(skip) if skip else out
    return out.orderBy(seq).limit(most) if most is not None else out


def labels(rows: DataFrame, include_suspicious: bool = False) -> DataFrame:
    """event_id, positive of rows (event_id, sus, evil, line); the last row of an id counts."""
    n = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    hit = (n("evil") > 0) | ((n("sus") > 0) if include_suspicious else F.lit(False))
    return rows.where(F.coalesce("event_id", F.lit("")) != "").groupBy("event_id").agg(F.max_by(hit, "line").alias("positive"))


def anomaly_ids(rows: DataFrame) -> DataFrame:
    """The different ids of flagged events."""
    return rows.where(F.coalesce("event_id", F.lit("")) != "").select("event_id").distinct()


def flagged(spark: SparkSession, path: str) -> DataFrame:
    """The ids in an anomaly log (JSON lines); a log that is not there has none."""
    from pyspark.errors import AnalysisException

    try:
        lines = jsonl(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "event_id string")
    return anomaly_ids(lines.select(F.get_json_object("value", "$.event_id").alias("event_id")))


def scored(rows: DataFrame) -> DataFrame:
    """The first of score, score_scaled, score_raw that a record has, even if it is not a number: then it is left out."""
    pick = F.coalesce(*[F.col(c).cast("string") for c in ("score", "score_scaled", "score_raw") if c in rows.columns])
    return rows.withColumn("value", pick.try_cast("double")).where("value is not null")


def labelled_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of CSV files with headers, as strings, with source_file and source_row (from 0, in the file's order). Rows
    are counted within the blocks that files are read in, and across them over one row a block."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(list(paths)).select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block__"))
    block = ["source_file", "block__"]
    before = Window.partitionBy("source_file").orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n__")).select(*block, F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("ahead__"))
    within = F.row_number().over(Window.partitionBy(*block).orderBy("at__")) - 1  # ids grow along a block
    return rows.withColumn("at__", F.monotonically_increasing_id()).withColumn("row__", within).join(ahead, block).withColumn("source_row", F.col("ahead__") + F.col("row__")).drop("block__", "at__", "row__", "ahead__")


def network_rows(rows: DataFrame, name: str = "eventName") -> DataFrame:
    from tidewatch.functions.rules import NETWORK_CALLS

    return rows.where(F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(list(NETWORK_CALLS)))


def csv_events(rows: DataFrame, position: str, start_ns: int, prefix: str) -> DataFrame:
    """Events and labels of labelled CSV rows: an id of prefix and position, a millisecond from one to the next, socket
    attributes where a row has them, else its socket address as arg1. Columns that a file lacks count as missing."""
    there = {c.lower() for c in rows.columns}
    col = lambda c: F.col(c).cast("string") if c.lower() in there else F.lit(None).cast("string")
    some = lambda c: F.nullif(col(c), F.lit(""))
    number = lambda c: F.greatest(F.coalesce(col(c).try_cast("bigint"), F.lit(0)), F.lit(0))
    socket = F.coalesce(some("sin_port"), some("sin_addr"), some("sa_family")).isNotNull()
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), some(c).alias("value")) for k, c in (("fd_sock_remote_port", "sin_port"), ("fd_sock_remote_addr", "sin_addr"), ("fd_sock_family", "sa_family"))], F.struct(F.lit("fd_path").alias("key"), F.nullif(F.trim(col("path")), F.lit("")).alias("value")))
    return rows.select(
        F.concat(F.lit(f"{prefix}-"), F.col(position).cast("string")).alias("event_id"), F.trim(F.coalesce(some("eventName"), some("syscall_name"), F.lit("unknown"))).alias("syscall_name"), F.lit("network").alias("event_group"),
        (F.lit(start_ns) + F.col(position) * 1_000_000).cast("long").alias("ts_unix_nano"), number("syscall_nr").alias("syscall_nr"), F.trim(F.coalesce(col("comm"), F.lit(""))).alias("comm"),
        *[F.coalesce(col(c), F.lit("0")).alias(c) for c in ("pid", "tid", "uid", "arg0")], F.when(~socket, some("sockaddr")).otherwise(F.lit(None)).alias("address__"), F.coalesce(col("arg1"), F.lit("0")).alias("arg1__"),
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("attributes"), F.coalesce(col("sus").try_cast("int"), F.lit(0)).alias("sus"), F.coalesce(col("evil").try_cast("int"), F.lit(0)).alias("evil"),
    ).withColumn("arg1", F.coalesce("address__", "arg1__")).drop("address__", "arg1__")


def legacy(data: Column) -> dict[str, Column]:
    """Named fields of the positional array of old logs; numbers may be written in hex."""
    names = ("syscall_name", "syscall_nr", "comm", "pid", "tid", "uid", "arg0", "arg1", "path")
    out = {n: F.get(data, F.lit(i)) for i, n in enumerate(names)}
    for n in ("syscall_nr", "pid", "tid", "uid", "arg0", "arg1"):
        v = F.lower(F.trim(out[n]))
        out[n] = F.when(v.startswith("0x"), F.conv(F.substring(v, 3, 32), 16, 10)).otherwise(v).try_cast("bigint")
    return out


def first_recordings(events: DataFrame, n: int, name: str = "recording_name") -> DataFrame:
    """Events before the first one of the (n + 1)th recording in stream order; later repeats of a known one pass.
    The recordings' first rows are few, so only they are ranked. An event without a name is an error."""
    named = F.coalesce(F.col(name), F.lit("")) != ""
    events = events.withColumn(name, F.when(named, F.col(name)).otherwise(F.raise_error(F.lit(f"an event has no {name}")).cast("string")))
    first = events.groupBy(name).agg(F.min("seq").alias("seq"))
    end = first.withColumn("r", F.row_number().over(Window.orderBy("seq"))).where(F.col("r") == n + 1).agg(F.min("seq").alias("__end"))
    return events.join(F.broadcast(end), F.col("__end").isNull() | (F.col("seq") < F.col("__end"))).drop("__end")


def metrics(lines: DataFrame) -> DataFrame:
    """name, labels, value of lines in the exposition format; comments and lines without a number are left out."""
    p = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{.*\})?\s+(\S+)\s*$"
    v = F.trim("value")
    m = lines.where(~v.startswith("#")).select(F.regexp_extract(v, p, 1).alias("name"), F.regexp_extract(v, p, 2).alias("labels"), F.regexp_extract(v, p, 3).try_cast("double").alias("value"))
    return m.where("name <> '' and value is not null")


def label(labels: Column, name: str) -> Column:
    """A label's value, unescaped; null if there is none."""
    raw = F.regexp_extract(labels, r'[{,]\s*' + name + r'="((?:[^"\\]|\\.)*)"', 1)
    text = F.replace(F.replace(F.replace(raw, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(F.regexp_like(labels, F.lit(r'[{,]\s*' + name + '="')), text)


def chosen(m: DataFrame, name: str, by: str) -> DataFrame:
    """One row: the label of the series of this name whose value is 1, as a gauge says which of several modes is on; of
    several the last by name, null if none is."""
    return m.where((F.col("name") == name) & (F.col("value") == 1)).agg(F.max(label(F.col("labels"), by)).alias(by))


def metric_sum(m: DataFrame, name: str) -> DataFrame:
    """Over all labels; null if the name never came."""
    return m.where(F.col("name") == name).agg(F.sum("value").alias("value"))


def to_json(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def write_evt1(events: DataFrame, path: str, max_bytes: int = 64 << 20, compress: bool = False, max_files: int = 0) -> DataFrame:
    """Write framed logs of at most max_bytes a file by the committing sink of ``evt1``; file and records of each file
    that the folder then has."""
    from tidewatch.sources import evt1 as source

    spark = events.sparkSession
    source.register(spark)
    options = {"maxBytes": max_bytes, "maxFiles": max_files, "compress": str(compress).lower()}
    to_json(events).write.format("evt1").options(**options).mode("append").save(path)
    return spark.read.format("evt1").load(path).groupBy("file").agg(F.count(F.lit(1)).alias("records"))


def dump(events: DataFrame, path: str, meta: dict) -> None:
    """Scored events as JSON lines with scores to four places, and what produced them beside."""
    rounded = events.select(*[F.round(c, 4).alias(c) if c.startswith("score") else F.col(c) for c in events.columns])
    rounded.write.mode("append").json(path)
    spark = events.sparkSession
    spark.createDataFrame([(json.dumps({"_meta": True, **meta}),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_meta")


def score_records(decided: DataFrame, mode: str, threshold: float, expected: str | None = None) -> DataFrame:
    """A record for each decided event; write them with ``write.json``."""
    label = F.col(expected) if expected else F.lit(None).cast("boolean")
    return decided.select(
        "event_id", "event_group", "syscall_name", F.col("raw").alias("score_raw"), F.col("scaled").alias("score_scaled"), F.col("primary").alias("score_primary"), F.lit(mode).alias("score_mode"),
        F.col("suppressed").alias("suppress_primary"), F.lit(float(threshold)).alias("threshold"), "anomaly", label.alias("expected_anomaly"),
    )


def score_summary(records: DataFrame, settings: dict | None = None) -> DataFrame:
    """One row: counts of the records, and the settings as JSON text."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    flagged, said = F.col("anomaly"), F.col("expected_anomaly")
    return records.agg(
        F.count(F.lit(1)).alias("events_scored"), n(flagged).alias("predicted_anomalies"), F.count(said).alias("labeled_events"),
        *[n(F.coalesce(c, F.lit(False))).alias(k) for k, c in (("tp", flagged & said), ("fp", flagged & ~said), ("fn", ~flagged & said), ("tn", ~flagged & ~said))],
    ).withColumn("settings", F.lit(json.dumps(settings or {}, sort_keys=True)))


def reports(events: DataFrame, path: str) -> None:
    """Appends id, reason, score and labels of what was flagged to the reports at ``path``."""
    events.where("anomaly").select("event_id", "reason", "score", *[c for c in ("rule", "rule_group", "group_key") if c in events.columns], F.current_timestamp().alias("reported")).write.mode("append").parquet(path)


def anomaly_log(events: DataFrame, path: str) -> None:
    events.where("anomaly").write.mode("append").json(path)


def labelled(**labels: Column | str) -> Column:
    """Labels in the exposition format, with backslashes, quotes and line ends escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = [F.concat(F.lit(f'{n}="'), esc(F.lit(v) if isinstance(v, str) else F.coalesce(v, F.lit(""))), F.lit('"')) for n, v in labels.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def exposition(m: DataFrame, about: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """name, labels, value as lines of the exposition format, in order: the series of a name stand together, behind their HELP
    and TYPE lines. about: type (counter, gauge ...) and help text by name; others are untyped, without help."""
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    series = m.select("name", F.lit(1).alias("k"), F.coalesce("labels", F.lit("")).alias("labels"), F.concat_ws(" ", F.concat("name", F.coalesce("labels", F.lit(""))), number).alias("value"))
    heads = m.select("name").distinct()
    esc = lambda t: t.replace("\\", "\\\\").replace("\n", "\\n")
    told = {n: [f"# HELP {n} {esc(text)}", f"# TYPE {n} {kind}"] for n, (kind, text) in (about or {}).items()}
    lines = F.coalesce(*[F.when(F.col("name") == n, F.array(*map(F.lit, ls))) for n, ls in told.items()], F.array(F.concat(F.lit("# TYPE "), "name", F.lit(" untyped"))))
    heads = heads.select("name", F.posexplode(lines).alias("p", "value")).select("name", F.lit(0).alias("k"), F.col("p").cast("string").alias("labels"), "value")
    return heads.unionByName(series).orderBy("name", "k", "labels").select("value")
