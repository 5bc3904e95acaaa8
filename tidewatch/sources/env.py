"""The envelope view: system events made of the driver's ``events`` table, in Spark SQL and in DuckDB SQL.

Both texts share one template, so they can't drift apart; only clock, JSON and integer division are spelt differently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import configure

_TEMPLATE = """
select cast(event_id as string) as event_id, event_id as seq, {micros} * 1000 as ts_unix_nano,
       case event_type when 'view' then 'read' when 'click' then 'openat' when 'signup' then 'execve' when 'purchase' then 'connect' else 'unlink' end as syscall_name,
       case event_type when 'view' then 0 when 'click' then 257 when 'signup' then 59 when 'purchase' then 42 else 87 end as syscall_nr,
       case event_type when 'signup' then 'process' when 'purchase' then 'network' else 'file' end as event_group,
       case cast(user_id % 5 as int) when 0 then 'bash' when 1 then 'cat' when 2 then 'curl' when 3 then 'sshd' else 'python' end as comm,
       cast(user_id as string) as pid, cast(user_id as string) as tid, cast(user_id % 7 as string) as uid,
       cast({k} as string) as arg0, cast(cast(floor(value) as bigint) as string) as arg1,
       concat('node-', cast(user_id % 4 as string)) as hostname,
       case when event_type in ('signup', 'purchase') then null when event_type = 'view' and {k} % 10 = 0 then ''
            else concat(case cast({k} % 6 as int) when 0 then '/etc' when 1 then '/tmp' when 2 then '/proc' when 3 then '/root' when 4 then '/usr/bin' else '/var/log' end, '/f', cast({k} as string)) end as fd_path,
       case when event_type = 'purchase' then cast(1024 + {k} as string) end as fd_sock_remote_port,
       case when event_type = 'purchase' then concat('10.0.0.', cast({k} as string)) end as fd_sock_remote_addr,
       case when event_type = 'purchase' then 'AF_INET' end as fd_sock_family,
       case when value > 150 then '-13' else '0' end as return_value,
       concat('rec-', cast((event_id {div} 500) as string)) as recording_name,
       ((event_id {div} 500) % 2 = 1 and event_id % 500 >= 400) as malicious, value
from events
"""
SPARK_SQL = _TEMPLATE.format(micros="unix_micros(cast(ts as timestamp))", k="cast(get_json_object(props, '$.k') as bigint)", div="div")
DUCK_SQL = _TEMPLATE.format(micros="epoch_us(ts)", k="cast(json_extract_string(props, '$.k') as bigint)", div="//")
ATTRIBUTES = ("fd_path", "fd_sock_remote_port", "fd_sock_remote_addr", "fd_sock_family", "return_value")


def env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event; ``attributes`` has no entry for what is missing, so that missing and empty stay apart."""
    events = configure(spark).read.parquet(f"{sf_dir}/events.parquet")
    flat = spark.sql(SPARK_SQL.replace("from events", "from {events}"), events=events)
    pairs = F.array(*[F.struct(F.lit(a).alias("key"), F.col(a).alias("value")) for a in ATTRIBUTES])
    return flat.withColumn("attributes", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))
