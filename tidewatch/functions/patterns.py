"""Many patterns at once: paths are looked up by the literal beginnings of patterns rather than tested against each.

A pattern's literal beginning ends at its first special character. Beginnings are filed by their length, so a path's own
beginnings of these lengths, a few at most, name all patterns that can fit it. What is left is decided at once for
plain words and for a beginning followed by one star, and by the pattern's expression for the rest.

``starts`` does it within an expression, as sets of literals by length; ``fits`` as a join, with a table of patterns of any
number. Patterns that begin with a special character have the empty beginning and are tested against every path.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPECIAL = "*?["
TABLE = "place int, pattern string, start string, length int, kind int, expression string"
WORD, STAR, OTHER = 0, 1, 2


def beginning(pattern: str) -> str:
    return pattern[: min((i for i in map(pattern.find, SPECIAL) if i >= 0), default=len(pattern))]


def kind(pattern: str) -> int:
    start = beginning(pattern)
    return WORD if start == pattern else STAR if pattern == start + "*" else OTHER


def starts(c: Column, values: tuple[str, ...]) -> Column:
    """Whether c begins with one of the values; null for null. One set of literals a length."""
    by = defaultdict(list)
    for v in dict.fromkeys(values):
        by[len(v)].append(v)
    tests = [F.when(c.isNotNull(), True) if not n else F.substring(c, 1, n).isin(vs) for n, vs in sorted(by.items())]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def table(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """TABLE of the patterns in their order; of equal ones the first counts."""
    from tidewatch.operators.analytics import glob_regex

    once = {p: i for i, p in reversed(list(enumerate(patterns)))}
    return spark.createDataFrame([(i, p, beginning(p), len(beginning(p)), kind(p), glob_regex(p)) for p, i in once.items()], TABLE)


def fits(paths: DataFrame, patterns: DataFrame, path: str) -> DataFrame:
    """path, place, pattern: every pattern of the table that a path equals or fits, for each different path."""
    lengths = sorted(r[0] for r in patterns.select("length").distinct().collect())  # no more than the longest pattern has characters
    if not lengths:
        return paths.select(path, F.lit(0).alias("place"), F.lit("").alias("pattern")).limit(0)
    own = paths.where(F.col(path).isNotNull()).select(path).distinct()
    keys = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    asked = own.select(path, F.explode(keys).alias("length")).withColumn("start", F.expr(f"substring(`{path}`, 1, length)"))
    met = asked.join(patterns, ["length", "start"])
    sure = F.when(F.col("kind") == WORD, F.col(path) == F.col("pattern")).when(F.col("kind") == STAR, F.lit(True)).otherwise((F.col(path) == F.col("pattern")) | F.expr(f"`{path}` rlike expression"))
    return met.where(sure).select(path, "place", "pattern")


def first(paths: DataFrame, patterns: DataFrame, path: str, out: str = "pattern") -> DataFrame:
    """Append the first pattern in the table's order that the path fits; null if none."""
    best = fits(paths, patterns, path).groupBy(F.col(path).alias("path__")).agg(F.min_by("pattern", "place").alias(out))
    return paths.join(best, F.col(path) == F.col("path__"), "left").drop("path__")
