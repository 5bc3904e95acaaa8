"""Near-duplicate lines across documents by a segment-partition edit join, in DataFrame expressions only.

A line is removed if an equal line, or one within ``edits`` character edits, stands before it: at a smaller
(document id, line number). Lines shorter than ``least`` characters are compared for equality only, and lines of
nothing but white space stay. Distances hold between lines as given, so a removed line still removes later ones.

1. Equal lines are one, with the place of their first occurrence and their number.
2. Each is cut into edits + 1 segments of even length. Of two lines within the distance, one segment of the shorter
   stands unchanged in the longer, near its own place. Segments are indexed by (length, number, content), and each
   line probes them with the substrings that can match at the lengths it can match (left and right errors bound
   the shift: the multi-match-aware selection).
3. Keys that bring two lines together give candidates. For each line the join looks for one that stands earlier, and a
   banded bit-parallel distance decides; before it, lengths and the counts of a few classes of characters, which no
   ``edits`` edits can change by more, rule most others out. It is a semi-join: a line goes with the first that is
   found, so lines of one template don't grow into all their pairs.
4. Places of lines to remove go back to their documents.

Null texts stay null; a text whose lines are all removed becomes empty. Null ids come last in the order; rows with
equal ids and texts are one document, and are treated alike. Columns other than the key and the text pass through; one
named n_lines_removed raises an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.runtime import Stash, free_names, fresh, prepare

_FILTERS = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}


def _keys(edits: int, least: int) -> Column:
    """The index keys of a line, then the keys that it only probes with; null where the shorter line would be too
    short. A probe with the number, length and place of an index key is that key. Of length n, the segment i of
    edits + 1 has ``base`` or, if it is one of the last ``more``, base + 1 characters, so it begins at or behind
    character i + 1 and the shifts stay within the line. Equal segments have equal keys whatever ``bytes`` leaves out."""
    own, probes = [], []
    for s in range(edits + 1):
        base, more = F.col(f"base{s}"), F.col(f"more{s}")
        for i in range(edits + 1):
            start = base * i + F.greatest(F.lit(0), more - (edits + 1 - i)) + 1
            width = base + F.when(more >= edits + 1 - i, 1).otherwise(0)
            for shift in range(max(-i, s - (edits - i)), min(i, s + (edits - i)) + 1):
                key = F.xxhash64(F.lit(i), F.col("n") - s, F.substring("bytes", start + shift, width))
                (own if s == shift == 0 else probes).append(key if s == 0 else F.when(F.col("n") - s >= least, key))
    return F.array(*own, *probes)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, evaluated once however often f names it, inside other lambdas too."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _trimmed(s: Column) -> Column:
    """Struct of two strings a and b without what they begin with in common, and back to front. The length in common
    is found by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(24))])

    def longer(n: Column, k: Column) -> Column:
        fits = (n + k <= F.least(F.length(s["a"]), F.length(s["b"]))) & (s["a"].substr(F.lit(1), n + k) == s["b"].substr(F.lit(1), n + k))
        return F.when(fits, n + k).otherwise(n)

    rest = lambda c, n: F.reverse(c.substr(n + 1, F.length(c)))
    return _let(F.aggregate(steps, F.lit(0), longer), lambda n: F.struct(rest(s["a"], n).alias("a"), rest(s["b"], n).alias("b")))


def bit_parallel(a: Column, b: Column, edits: int) -> Column:
    """Whether strings a and b are within the distance, by bit vectors over the band of 2 * edits + 1 diagonals:
    bit k of a column's vectors stands for the row ``k - edits`` below the diagonal. After each character of b,
    one step of additions and shifts gives all differences in the band at once; the distance is followed along
    the band's lowest row until that leaves a, and then along a's last row. Common ends are cut off first."""

    def verdict(s: Column) -> Column:
        far = F.abs(F.length(s["a"]) - F.length(s["b"])) > edits
        one_left = (s["a"] == "") | (s["b"] == "")
        chars = F.struct(F.split(s["a"], "").alias("a"), F.split(s["b"], "").alias("b"))
        return F.when(far, F.lit(False)).when(one_left, F.lit(True)).otherwise(_let(chars, lambda c: _band(c["a"], c["b"], edits)))

    return _let(F.struct(a.alias("a"), b.alias("b")), lambda s: _let(_trimmed(s), lambda t: _let(_trimmed(t), verdict)))


def _band(a: Column, b: Column, edits: int) -> Column:
    top, width = 2 * edits, 2 * edits + 1
    ones = F.lit((1 << width) - 1).cast("long")
    bit = lambda k: F.lit(1 << k).cast("long")
    inv = lambda x: F.bitwise_not(x).bitwiseAND(ones)
    m, n = F.size(a), F.size(b)
    first = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).cast("int").alias("d"))

    def step(s: Column, j: Column) -> Column:
        c = F.element_at(b, j)
        eq = F.lit(0).cast("long")
        for k in range(width):
            row = j - edits + k
            eq = eq + F.when((row >= 1) & (row <= m) & (F.get(a, row - 1) == c), bit(k)).otherwise(F.lit(0).cast("long"))
        # each value is held once: expressions of a lambda are not shared
        return F.aggregate(F.array(eq), s, lambda t, x: _advance(t, x, j))

    def _advance(t: Column, x: Column, j: Column) -> Column:
        vp, vn = t["vp"], t["vn"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(ones)
        return F.aggregate(F.array(d0), t, lambda u, z: _close(u, z, j))

    def _close(u: Column, z: Column, j: Column) -> Column:
        vp, vn = u["vp"], u["vn"]
        hp, hn = vn.bitwiseOR(inv(z.bitwiseOR(vp))), z.bitwiseAND(vp)
        down = F.shiftright(z, 1)
        low = j + edits <= m  # the band's lowest row is in a
        k = edits + m - j  # else a's last row is this bit
        at_last = F.when((k >= 0) & (k <= top), F.call_function("shiftright", hp, k).bitwiseAND(bit(0)) - F.call_function("shiftright", hn, k).bitwiseAND(bit(0))).otherwise(F.lit(1).cast("long"))
        d = u["d"] + F.when(low, F.when(z.bitwiseAND(bit(top)) == 0, 1).otherwise(0)).otherwise(at_last).cast("int")
        return F.struct(hn.bitwiseOR(inv(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), d.alias("d"))

    # a shorter than the band: its last row is above the lowest from the start
    begun = F.struct(first["vp"].alias("vp"), first["vn"].alias("vn"), F.least(F.lit(edits), m).cast("int").alias("d"))
    return F.aggregate(F.sequence(F.lit(1), n), begun, step)["d"] <= edits


#: Classes of characters whose counts are compared before the distance: an edit moves each by at most 1.
_CLASSES = ("[aeiou]", "[nrstl]", "[0-9]", "[A-Z]", " ")


def near_later(lines: DataFrame, edits: int, least: int, stash: Stash) -> DataFrame:
    """lines: line_id (unique), line (distinct), first (place, unique). line_id of the lines within the distance of one
    whose place is smaller."""
    least = max(least, edits + 1)
    # one byte a character, so that substrings need no search for their place
    flat = F.encode(F.regexp_replace("line", "[^\\x00-\\xFF]", "?"), "ISO-8859-1")
    sized = [F.expr(f"cast((n - {s}) div {edits + 1} as int)").alias(f"base{s}") for s in range(edits + 1)] + [F.expr(f"(n - {s}) % {edits + 1}").alias(f"more{s}") for s in range(edits + 1)]
    long_ = lines.select("line_id", F.length("line").alias("n"), flat.alias("bytes")).where(F.col("n") >= least).select("line_id", "n", "bytes", *sized)
    both = long_.select("line_id", F.posexplode(_keys(edits, least)).alias("at", "key")).where("key is not null").select("line_id", "key", (F.col("at") <= edits).alias("own"))
    # keys with an index entry and a second line, by a window: its one exchange carries every row once
    w = Window.partitionBy("key")
    met = both.withColumn("lo", F.min("line_id").over(w)).withColumn("hi", F.max("line_id").over(w)).withColumn("indexed", F.max("own").over(w))
    hits = stash.keep(met.where("indexed and lo <> hi").select("line_id", "key", "own"), "hits")
    # ids are never negative: the comparison only tells the planner that this side may be worth a filter of the other
    wanted = hits.select("line_id").where("line_id >= 0")
    classes = F.array(*[F.length(F.regexp_replace("line", f"[^{c.strip('[]')}]", "")).cast("short") for c in _CLASSES])
    texts = lines.join(wanted, "line_id", "left_semi").select("line_id", "line", "first", classes.alias("of"))
    full = stash.keep(hits.join(texts, "line_id"), "hit-lines")
    late, early = full.alias("late"), full.alias("early")
    lc, ec = (lambda c: F.col(f"late.{c}")), (lambda c: F.col(f"early.{c}"))
    alike = F.abs(F.length(lc("line")) - F.length(ec("line"))) <= edits
    for i in range(len(_CLASSES)):
        alike = alike & (F.abs(F.get(lc("of"), F.lit(i)) - F.get(ec("of"), F.lit(i))) <= edits)
    close = alike & bit_parallel(lc("line"), ec("line"), edits)
    found = late.join(early, (lc("key") == ec("key")) & (lc("own") | ec("own")) & (ec("first") < lc("first")) & close, "left_semi")
    return found.select("line_id").distinct()


def removals(docs: DataFrame, edits: int, least: int, key: str, text: str, stash: Stash) -> DataFrame:
    """doc, gone: for each document that loses lines, their numbers from 0. doc is a struct of id and text hash."""
    named = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    lines = named.select("id", "h", F.posexplode(F.split("t", "\n", -1)).alias("no", "line")).where(F.col("line").rlike(r"\S"))
    place = F.coalesce(F.col("id").cast("decimal(38,0)"), F.lit(str(1 << 63)).cast("decimal(38,0)")) * F.lit(1 << 32).cast("decimal(12,0)") + F.col("no")
    lines = lines.withColumn("place", place.cast("decimal(38,0)"))
    once = lines.groupBy("line").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).withColumn("line_id", F.monotonically_increasing_id())
    once = stash.keep(once, "lines")
    late = stash.keep(near_later(once.select("line_id", "line", "first"), edits, least, stash).withColumn("near", F.lit(True)), "late")
    stash.drop("hits", "hit-lines")
    ids = [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), "line").alias("k2")]
    verdict = once.select("line_id", *ids, "first", "times").join(late, "line_id", "left").where("times > 1 or near").select("k1", "k2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    hit = lines.select("id", "h", "no", "place", *ids).join(verdict, ["k1", "k2"]).where("near or place <> first")
    return hit.groupBy("id", "h").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def dedup(docs: DataFrame, edits: int = 2, least: int = 20, key: str = "doc_id", text: str = "text", stash: Stash | None = None) -> DataFrame:
    """The documents with their text less the removed lines, and n_lines_removed."""
    spark = docs.sparkSession
    prepare(spark)
    free_names(docs, "n_lines_removed")
    stash = stash or Stash(spark, "lines")
    # where few lines are wanted, a filter of bounded size goes ahead of the shuffle of all lines
    was = {k: spark.conf.get(k) for k in _FILTERS}
    for k, v in _FILTERS.items():
        spark.conf.set(k, v)
    try:
        gone = stash.keep(removals(docs, edits, least, key, text, stash), "gone")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    stash.only("gone")
    hidden = fresh(docs, "hash_of_text")
    gone = gone.select(F.col("id").alias(f"{hidden}1"), F.col("h").alias(f"{hidden}2"), F.col("gone").alias(f"{hidden}3"))
    docs = docs.withColumn(hidden, F.xxhash64(text))
    both = docs.join(gone, docs[key].eqNullSafe(gone[f"{hidden}1"]) & (docs[hidden] == gone[f"{hidden}2"]), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n", -1)) - 1), f"{hidden}3")
    # the array around the split lines binds them to a name; else each index would split the text again
    kept = F.array_join(F.transform(F.array(F.split(text, "\n", -1)), lambda ls: F.transform(stay, lambda i: F.get(ls, i)))[0], "\n")
    out = both.withColumn("n_lines_removed", F.coalesce(F.size(f"{hidden}3"), F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(F.col(f"{hidden}3").isNull(), F.col(text)).otherwise(kept)).drop(hidden, *[f"{hidden}{i}" for i in "123"])
