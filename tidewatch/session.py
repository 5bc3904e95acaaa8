"""Session settings that the event operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Times are UTC throughout, and plans adapt at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def session(name: str = "tidewatch", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    return configure((builder.master(master) if master else builder).getOrCreate())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder's name in ``spark.checkpoint.dir``, which driver and executors share. Where that is unset, as in local
    tests, it is in a folder of our own; on a cluster it is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(told or 'file://' + tempfile.mkdtemp(prefix='tidewatch-')).rstrip('/')}/tidewatch/{name}-{uuid.uuid4().hex}"
