"""What file numbers stand for: paths opened and peers connected, by process and number and over time, and what processes
inherit of it.

The table of file numbers is a table of marks: at a moment, (pid, fd) begins to stand for something, or for nothing
more (a close). What it stands for at another moment is the last mark before it. Marks and askers are brought together by
(pid, fd) and time in one shuffle, and cut into ranges of time (``scan``), so that a process with very many calls is not
one task's. Ancestors come from parents by pointer doubling: reach doubles with each join, so any number of processes
and hops takes few of them, and nothing recurses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import scan
from tidewatch.operators.native import ORDER

#: Processes whose file numbers are looked through: a process itself and its ancestors above it.
HOPS = 8


def ancestors(parents: DataFrame, hops: int = HOPS) -> DataFrame:
    """parents: pid, ppid. pid, ancestor, hop for up to so many steps; a process without parent, or its own, has none.
    Each join puts what an ancestor can reach behind what reaches it, so there are log2(hops) of them."""
    up = parents.where("ppid is not null and ppid <> pid").select("pid", F.col("ppid").alias("ancestor"), F.lit(1).alias("hop"))
    reach = 1
    while reach < hops:
        far = up.where(F.col("hop") == reach).select("pid", F.col("ancestor").alias("mid"))
        next_ = up.select(F.col("pid").alias("mid"), "ancestor", (F.col("hop") + reach).alias("hop"))
        up = up.unionByName(far.join(next_, "mid").select("pid", "ancestor", "hop"))
        reach *= 2
    return up.where(F.col("hop") <= hops)


def inherited_paths(opened: DataFrame, parents: DataFrame, hops: int = HOPS) -> DataFrame:
    """opened: pid, fd, path. For each process and file number the path of the nearest process that opened it: its
    own, or that of an ancestor within reach."""
    reach = parents.select("pid").distinct().withColumn("ancestor", F.col("pid")).withColumn("hop", F.lit(0)).unionByName(ancestors(parents, hops))
    both = reach.join(opened.select(F.col("pid").alias("ancestor"), "fd", "path"), "ancestor")
    return both.groupBy("pid", "fd").agg(F.min_by("path", "hop").alias("path"), F.min("hop").alias("hop"))


def path_marks(calls: DataFrame, opens: tuple[str, ...] = ("open", "openat", "openat2"), closes: tuple[str, ...] = ("close",)) -> DataFrame:
    """pid, fd, time, seq and v (a path; null where the number is closed) of calls with pid, fd (of the number that is
    closed), return_value, path. An open that fails marks nothing; one that gives a number again overwrites it."""
    opened = F.col("syscall_name").isin(*opens) & (F.col("return_value") >= 0)
    closed = F.col("syscall_name").isin(*closes)
    fd = F.when(opened, F.col("return_value")).otherwise(F.col("fd"))
    return calls.where(opened | closed).select("pid", fd.cast("long").alias("fd"), *ORDER, F.when(opened, F.col("path")).alias("v"))


def peer_marks(calls: DataFrame, family: str = "AF_INET", closes: tuple[str, ...] = ("close",)) -> DataFrame:
    """pid, fd, time, seq and v (address and port; null where the number is closed) of calls with pid, fd,
    return_value, family, addr, port. A connect that fails, or of another family, marks nothing."""
    connected = (F.col("syscall_name") == "connect") & (F.col("return_value") == 0) & (F.col("family") == family)
    closed = F.col("syscall_name").isin(*closes)
    return calls.where(F.coalesce(connected, F.lit(False)) | closed).select("pid", F.col("fd").cast("long").alias("fd"), *ORDER, F.when(connected, F.struct("addr", "port")).alias("v"))


def as_of(asking: DataFrame, marks: DataFrame, key: tuple[str, ...] = ("pid", "fd"), out: str = "v", parts: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Append to the askers the v of the last mark of their key before them; null if there is none, or it closes. A
    mark at an asker's own place (time and seq) does not count yet. sizes: as ``scan.cut_large`` has it."""
    held = marks.select(*key, *ORDER, F.struct("v").alias("__mark"))
    both = asking.withColumn("__asks", F.lit(1)).unionByName(held, allowMissingColumns=True)
    both, many, large = scan.cut_large(both, [*key], ORDER[0], parts, sizes)
    rows = both.withColumn(scan.CARRY, F.lit(0)) if large is None else scan.carried(both, _states(large, key))
    w = Window.partitionBy(*key, scan.PART).orderBy(F.col(scan.CARRY).desc(), *ORDER, F.col("__asks").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = scan.dealt(rows, [*key, scan.PART], many).withColumn(out, F.last("__mark", ignorenulls=True).over(w)["v"])
    return scan.bare(rows.where(F.col("__asks") == 1), asking.columns, out)


def _states(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of each range of a key the last mark before it. Ranges without marks have a state too: that of the last one with any."""
    lasts = rows.groupBy(*key, scan.PART).agg(F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.struct(*ORDER))).alias("__mark"))
    return lasts.select(*key, scan.PART, F.last("__mark", ignorenulls=True).over(scan.before([*key])).alias("__mark"))


def inherited(asking: DataFrame, marks: DataFrame, parents: DataFrame, id: str = "event_id", hops: int = HOPS, out: str = "v", parts: int | None = None) -> DataFrame:
    """As ``as_of``, by (pid, fd); where the process has no open mark at that moment, its parent's counts, and so on, through
    ``hops`` processes in all. Also append hop: 0 for the process's own, null if none has one. ids tell askers apart."""
    own = as_of(asking, marks, out=out, parts=parts)
    reach = ancestors(parents, hops - 1)
    left = own.where(F.col(out).isNull()).select(F.col(id).alias("__id"), F.col("pid").alias("__pid"), "fd", *ORDER)
    asked = left.join(reach, F.col("__pid") == reach["pid"]).select("__id", "hop", F.col("ancestor").alias("pid"), "fd", *ORDER)
    # as if all were left: counts by process are passed up, in place of a run of all this for counting alone
    calls = asking.groupBy(F.col("pid").alias("__pid"), "fd").agg(F.count(F.lit(1)).alias("n"))
    most = calls.join(reach, F.col("__pid") == reach["pid"]).select(F.col("ancestor").alias("pid"), "fd", "n").unionByName(marks.groupBy("pid", "fd").agg(F.count(F.lit(1)).alias("n")))
    found = as_of(asked, marks, out="v", parts=parts, sizes=most.groupBy("pid", "fd").agg(F.sum("n").alias("n"))).where("v is not null").groupBy("__id").agg(F.min_by("v", "hop").alias("__v"), F.min("hop").alias("__hop"))
    both = own.join(found, own[id] == found["__id"], "left")
    value = F.coalesce(F.col(out), F.col("__v"))
    return both.select(*asking.columns, value.alias(out), F.when(F.col(out).isNotNull(), 0).otherwise(F.col("__hop")).alias("hop"))


def enriched(calls: DataFrame, parents: DataFrame, parts: int | None = None) -> DataFrame:
    """Calls with what their file number stands for: open_path (inherited if need be), path_hop, peer."""
    with_path = inherited(calls, path_marks(calls), parents, out="open_path", parts=parts).withColumnRenamed("hop", "path_hop")
    return as_of(with_path, peer_marks(calls), out="peer", parts=parts)

