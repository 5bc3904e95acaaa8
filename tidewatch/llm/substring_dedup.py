"""Removal of word passages that stand more than once in a corpus, by suffix automata of its shards.

Every window of ``window`` words has an anchor: the least hashed of its runs of ``window - 15`` words, leftmost if
tied. Equal windows have equal anchors, so windows can be dealt to shards by anchor, and each shard decides alone
and exactly which of its windows are repeated:

1. anchors are counted over all documents (about one in nine words starts one); a window whose anchor stands
   nowhere else is not repeated. This leaves little but what is repeated;
2. documents with repeated anchors give, for each of them, the words of the windows that have it as theirs. These
   passages, counted by text, are a shard's reference; a suffix automaton of those under one anchor tells for every
   window how often it occurs, and each passage is streamed through it for its matching statistics;
3. the windows found go back to their documents, and the words that they cover are removed.

The automata aren't broadcast: with the corpus itself as reference every document would have to be streamed past
every shard, which grows with the square of the corpus. Anchors route each passage to the one shard that can match
it. Passages that a whole document's copies share are counted, not gathered, so no group size bounds a task.

Hashes (64 bits) only choose anchors and shards; an anchor counted as repeated by a collision costs time, not
correctness. Words are compared as they are. Null and empty texts have no words. Ids need not
differ: rows are told apart by a 64-bit hash of id and text, and equal rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words
from tidewatch.llm.automaton import SuffixAutomaton
from tidewatch.llm.ngram_join import gathered
from tidewatch.llm.runtime import Stash, prepare

SLACK = 15


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minima (or maxima) of all runs of width numbers, from those of runs of powers of two."""
    have = 1
    while have * 2 <= width:
        x, have = pick(x[:-have], x[have:]), have * 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _marked(w: words.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, least, runs): the first word of each window, by first word the hash of the window's anchor (0 where
    no window starts), and the hash of each run that can be an anchor."""
    h = words.word_hashes(w)
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    k = window - SLACK
    g = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        g = g * np.uint64(words._BASE) + h[j : len(h) - k + 1 + j]
    g = words.mix(g)
    least = _slide(g, SLACK + 1, np.minimum)
    whole = np.arange(len(least)) + window <= np.repeat(w.first[1:], np.diff(w.first))[: len(least)]
    return np.flatnonzero(whole), np.where(whole, least, np.uint64(0)), g


def anchors(w: words.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor) of each window."""
    start, least, _ = _marked(w, window)
    return start, least[start]


def anchor_places(w: words.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run that is some window's anchor: it is so if it equals the largest anchor of the
    windows that hold it, as none of these has a larger one than it."""
    _, least, g = _marked(w, window)
    if not len(g):
        return np.zeros(0, np.int64), g
    edge = np.zeros(SLACK, np.uint64)
    at = np.flatnonzero((_slide(np.concatenate([edge, least, edge]), SLACK + 1, np.maximum) == g) & (g > 0))
    return at, g[at]


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """anchor, doc: a row for each place of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            for lo, hi, data, at in words.chunks(batch.column(1)):
                w = words.split(data, at)
                place, anchor = anchor_places(w, window)
                doc = np.searchsorted(w.first, place, "right") - 1
                for k in range(0, len(place), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[part].view(np.int64)), batch.column(0).slice(lo, hi - lo).take(pa.array(doc[part]))], names=["anchor", "doc"])

    return docs.mapInArrow(run, "anchor long, doc long")


def _passages(docs: DataFrame, window: int) -> DataFrame:
    """For each document with repeated anchors: doc, and a row for each of them with the passage of its windows:
    the index of the first word, and the words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi, data, at in words.chunks(batch.column(1)):
                w = words.split(data, at)
                start, anchor = anchors(w, window)
                doc = np.searchsorted(w.first, start, "right") - 1
                raw = data.tobytes()
                edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]), [True]])) if len(start) else np.zeros(1, np.int64)
                hot = {lo + i: np.asarray(batch.column(2)[lo + i].values) for i in range(hi - lo)}
                a, b, d = edge[:-1], edge[1:] - 1, doc[edge[:-1]] if len(edge) > 1 else []
                for i in np.unique(d):
                    own = np.flatnonzero(d == i) if len(hot) == 1 else np.arange(np.searchsorted(d, i), np.searchsorted(d, i, "right"))
                    own = own[np.isin(anchor[a[own]].view(np.int64), hot[lo + int(i)])]
                    for x in own:
                        s, e = start[a[x]], start[b[x]] + window
                        text = b" ".join([raw[p:q] for p, q in zip(w.start[s:e].tolist(), w.end[s:e].tolist(), strict=True)])
                        rows.append((lo + int(i), int(anchor[a[x]].view(np.int64)), int(s - w.first[i]), text.decode()))
            for k in range(0, len(rows), 4096):
                part = list(zip(*rows[k : k + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part[0])), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int32()), pa.array(part[3])], names=["doc", "anchor", "at", "words"])

    return docs.select("doc", "text", "anchors").mapInArrow(run, "doc long, anchor long, at int, words string")


def _matched(window: int):
    """For passages that occur once: the starts of their windows that stand elsewhere, or twice in the passage."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[str, int]]] = {}
        for a, text, n in zip(*(table.column(c).to_pylist() for c in ("anchor", "words", "n")), strict=True):
            by.setdefault(a, []).append((text, n))
        out = []
        for a, found in by.items():
            automaton = SuffixAutomaton((text.split(" "), n) for text, n in found)
            for text, n in found:
                if n < 2 and (starts := automaton.repeated(text.split(" "), window)):
                    out.append((a, text, starts))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.int32())))], names=["anchor", "words", "starts"])

    return run, "anchor long, words string, starts array<int>"


def repeated_windows(docs: DataFrame, window: int, stash: Stash) -> DataFrame:
    """docs: doc (long, unique), text. Returns doc, starts: all its repeated windows' first words, for documents that have any."""
    found = stash.keep(_anchor_rows(docs, window).groupBy("anchor", "doc").agg(F.count(F.lit(1)).alias("n")), "anchors")
    often = found.groupBy("anchor").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("anchor")
    hot = stash.keep(found.join(often, "anchor", "left_semi").groupBy("doc").agg(F.collect_list("anchor").alias("anchors")), "hot")
    stash.drop("anchors")
    passages = stash.keep(_passages(docs.join(hot, "doc"), window), "passages")
    stash.drop("hot")
    counted = stash.keep(passages.groupBy("anchor", "words").agg(F.count(F.lit(1)).alias("n")), "counted")
    run, schema = _matched(window)
    shards = counted.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(1 << 16)))
    single = shards.where("n = 1").select("anchor").distinct()
    matched = shards.join(single, "anchor", "left_semi").groupBy("shard").applyInArrow(run, schema)
    whole = counted.where("n > 1").select("anchor", "words", F.lit(None).cast("array<int>").alias("starts"))
    matched = stash.keep(whole.unionByName(matched), "matched")
    stash.drop("counted")
    every = F.sequence(F.lit(0), F.size(F.split("words", " ")) - window)
    back = passages.join(matched, ["anchor", "words"]).select("doc", F.transform(F.coalesce("starts", every), lambda x: x + F.col("at")).alias("starts"))
    return back.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))


def dedup(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text", stash: Stash | None = None) -> DataFrame:
    """key, n_words, n_removed, kept (the words left, joined by one space) of each document."""
    spark = docs.sparkSession
    prepare(spark)
    stash = stash or Stash(spark, "substrings")
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    docs = docs.withColumn("name", F.xxhash64(F.col("key").cast("string"), F.lit(":"), "text"))
    named = docs.where("text is not null").select(F.col("name").alias("doc"), "text")
    starts = stash.keep(repeated_windows(named, window, stash), "starts")
    stash.only("starts")
    both = docs.join(starts.withColumnRenamed("doc", "name"), "name", "left").select("key", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for lo, hi, data, at in words.chunks(batch.column(1)):
                w, raw = words.split(data, at), data.tobytes()
                for i in range(hi - lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    keep = np.ones(b - a, bool)
                    if batch.column(2)[lo + i].is_valid:
                        cover = np.zeros(b - a + 1, np.int64)
                        s = np.asarray(batch.column(2)[lo + i].values)
                        s = s[s + window <= b - a]  # two rows of one name have each other's windows, perhaps behind the end
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + window, -1)
                        keep = np.cumsum(cover)[:-1] == 0
                    k = np.flatnonzero(keep) + a
                    total.append(b - a)
                    gone.append(b - a - len(k))
                    kept.append(b" ".join([raw[p:q] for p, q in zip(w.start[k].tolist(), w.end[k].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["key", "n_words", "n_removed", "kept"])

    out = both.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("key", key)
