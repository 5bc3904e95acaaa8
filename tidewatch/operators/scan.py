"""Ordered groups over many tasks: prefix scans by ranges of the order.

A group's rows are cut into ranges of the order's first column. What the rows of a range do to a running state (counts,
sums, means and spreads, last values) is put together for each range first; these partial states are combined in order,
over one row a range; and each range begins with one more row that carries the state of all ranges before it. So a
window never spans more than a range of a group, one group can use as many tasks as there are ranges, and one shuffle of
the rows on (group, range) serves all windows: those on further columns too, as these columns only narrow it.

Bounds are quantiles of the column over all groups, found by one aggregate over that column alone. Rows of equal time
are in one range.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PART, CARRY = "__part", "__carry"
#: Rows that a range should hold at most, over all groups.
ROWS = 1 << 18
#: Bounds that are compared one by one in nested conditions; beyond, they are bisected in an array.
FLAT = 127


def bisect(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are not larger than the value; 0 for null."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(bounds[mid]), half(mid + 1, hi)).otherwise(half(lo, mid))

    if len(bounds) <= FLAT:
        return half(0, len(bounds))
    held, jumps = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    fits = lambda at: (at <= len(bounds)) & (F.try_element_at(held, at) <= value)
    found = F.aggregate(jumps, F.lit(0), lambda at, j: F.when(fits(at + j), at + j).otherwise(at))
    return F.when(value.isNull(), F.lit(0)).otherwise(found)


def bounds(df: DataFrame, at: str, parts: int | None = None, rows: int = ROWS) -> list:
    """Ascending bounds that cut the column into about even ranges: ``parts`` of them, or as many as there are ``rows``
    in the table, and one for each shuffle partition at least."""

    def cut(n: int) -> tuple[list, int]:
        shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
        got = df.agg(F.percentile_approx(at, shares, F.lit(max(10_000, 20 * n))), F.count(F.lit(1))).first()
        return (sorted(set(got[0] or [])) if n > 1 else []), got[1]

    if parts:
        return cut(parts)[0] if parts > 1 else []
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got, n = cut(few)
    return got if n <= few * rows else cut(math.ceil(n / rows))[0]


def cut(df: DataFrame, at: str, parts: int | None = None) -> DataFrame:
    """Append the range of each row."""
    return cut_into(df, at, parts)[0]


def cut_into(df: DataFrame, at: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """``cut``, and how many ranges there are."""
    got = bounds(df, at, parts)
    return df.withColumn(PART, bisect(F.col(at), got)), len(got) + 1


def cut_large(df: DataFrame, key: list[str], at: str, parts: int | None = None, sizes: DataFrame | None = None) -> tuple[DataFrame, int, DataFrame | None]:
    """``cut_into`` where keys may be many: only keys of more than ``ROWS`` rows are cut, as a state for each range of a small
    one would be as many rows as there are. Also how many tasks the rows are for, and the rows of the keys that are cut
    (none if no key is). sizes: the key's columns and n, no fewer rows than it has, where that is cheaper to know than by
    counting; ``parts`` cuts all keys."""
    if parts:
        df, many = cut_into(df, at, parts)
        return df, many, df
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    n, any_ = sizes.agg(F.sum("n"), F.max("n") > ROWS).first()
    many = math.ceil((n or 0) / ROWS)
    if not any_:
        return df.withColumn(PART, F.lit(0)), many, None
    large = F.broadcast(sizes.where(F.col("n") > ROWS).select(*[F.col(c).alias(f"__large_{c}") for c in key], F.lit(True).alias("__large")))  # fewer than rows / ROWS
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__large_{c}")) for c in key])
    columns, df = df.columns, df.join(large, same, "left")
    got = bounds(df.where("__large"), at, rows=ROWS)
    df = df.select(*columns, F.when(F.col("__large"), bisect(F.col(at), got)).otherwise(0).alias(PART), "__large")
    return df.drop("__large"), max(many, len(got) + 1), df.where("__large").drop("__large")


def dealt(df: DataFrame, by: list[str], ranges: int) -> DataFrame:
    """The rows by group and range (or blocks of rows of another kind), to as many tasks as there are ranges once these are
    more than shuffle partitions: a task's rows, and the memory that sorts them, don't grow with the table."""
    return df.repartition(ranges, *by) if ranges > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def before(key: list[str]) -> WindowSpec:
    """Over one row a range: the ranges before this one."""
    return Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def carried(df: DataFrame, states: DataFrame) -> DataFrame:
    """The rows, with the states' rows (key, range and columns of their own) ahead of those of their range."""
    return df.withColumn(CARRY, F.lit(0)).unionByName(states.withColumn(CARRY, F.lit(1)), allowMissingColumns=True)


def within(key: list[str], order: tuple[str, ...], *further: str) -> WindowSpec:
    """Over a range of a group, what is carried first."""
    return Window.partitionBy(*key, PART, *further).orderBy(F.col(CARRY).desc(), *order)


def bare(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """Without carried rows, and without columns other than these."""
    return df.where(F.col(CARRY) == 0).select(*[c for c in columns if c not in more], *more)


def numbered(df: DataFrame, key: list[str], order: tuple[str, ...], out: str = "row", parts: int | None = None) -> DataFrame:
    """Append the row's number within its group, from 1."""
    return numbered_in(df, key, order, out, parts)[0]


def numbered_in(df: DataFrame, key: list[str], order: tuple[str, ...], out: str = "row", parts: int | None = None) -> tuple[DataFrame, int]:
    """``numbered``, and how many ranges there are."""
    columns, (df, many) = df.columns, cut_into(df, order[0], parts)
    counts = df.groupBy(*key, PART).agg(F.count(F.lit(1)).alias("n"))
    states = counts.select(*key, PART, F.coalesce(F.sum("n").over(before(key)), F.lit(0)).alias("__ahead"))
    w = within(key, order)
    rows = dealt(carried(df, states), [*key, PART], many)
    number = F.first("__ahead").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(w) - 1
    return bare(rows.withColumn(out, number), columns, out), many


def last_states(df: DataFrame, key: list[str], order: tuple[str, ...], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """Append the value of the group's row just before this one as a struct's field v, null for the first row: a lag that
    goes on over ranges."""
    columns, (df, many) = df.columns, cut_into(df.withColumn("__v", F.struct(value.alias("v"))), order[0], parts)
    ends = df.groupBy(*key, PART).agg(F.max_by("__v", F.struct(*order)).alias("end"))
    states = ends.select(*key, PART, F.lag("end").over(Window.partitionBy(*key).orderBy(PART)).alias("__v"))
    return bare(dealt(carried(df, states), [*key, PART], many).withColumn(out, F.lag("__v").over(within(key, order))), columns, out)


def summed(df: DataFrame, key: list[str], order: tuple[str, ...], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """Append the sum of the value over the group's rows up to and with this one."""
    columns, (df, many) = df.columns, cut_into(df.withColumn("__v", value), order[0], parts)
    sums = df.groupBy(*key, PART).agg(F.sum("__v").alias("s"))
    states = sums.select(*key, PART, F.sum("s").over(before(key)).alias("__v"))
    return bare(dealt(carried(df, states), [*key, PART], many).withColumn(out, F.sum("__v").over(within(key, order).rowsBetween(Window.unboundedPreceding, 0))), columns, out)
