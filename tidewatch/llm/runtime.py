"""What the text operators share: the shared folder for intermediate tables and the workers' import path."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEAN = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled",)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, as in local tests, one of our own is made;
    on a cluster that would be a machine-local folder, so there it is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidewatch-"))


def prepare(spark: SparkSession, batch: int = 512) -> None:
    """Let Python workers find this package, and keep Arrow batches of long texts small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")


def free_names(df: DataFrame, *names: str) -> None:
    """An operator that appends columns doesn't overwrite those of the caller."""
    if there := sorted({n.lower() for n in names} & {c.lower() for c in df.columns}):
        raise ValueError(f"the table has columns that the result is to add: {', '.join(there)}; rename them first")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    there = {c.lower() for c in df.columns}
    while name in there:
        name += "_"
    return name


class Stash:
    """Intermediate tables of one run, written as Parquet to the shared folder, so that losing an executor
    costs no more than the stage that runs. Tables that a later one replaces are dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again. Its shuffle files go when it stands: nothing reads them again."""
        path, conf = f"{self.base}/{name}", self.spark.conf
        was = {k: conf.get(k, "false") for k in _CLEAN}
        for k in _CLEAN:
            conf.set(k, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in was.items():
                conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def only(self, *names: str) -> None:
        """Drop all tables but these."""
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.base)
        there = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(base)
        self.drop(*({f.getPath().getName() for f in there} - {*names}))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
