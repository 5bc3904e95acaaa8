"""Ranked lexical search by sort-based accumulation: the best documents for each item of a query set, exactly.

A term is a maximal run of characters other than the ASCII ones that are neither digits nor letters, with A-Z
lower-cased; it is told by its bytes. A document's score is the sum of its impacts over the different terms of an
item, an impact being an integer made of the term's weight (from how many documents hold it), its occurrences and the
document's length (``impacts``).

1. One pass over the texts matches their terms with those of the items, and writes for every document its length and
   its matched terms with their occurrences. Counts over that table give the weights.
2. A second pass turns the matched terms of a block of documents into arrays of items, documents and impacts, one
   entry for each item that has the term. Entries are packed into (item, document) keys and sorted by radix, 16 bits
   at a time; equal keys are then neighbours, and their impacts are added up by ``reduceat``. A block is a range of the
   documents and of the items, so the arrays are bounded by ``ENTRIES`` and one document's own terms.
3. Each task keeps the ``k`` best of every item in a heap and gives them out at its end; the lists are merged in two
   levels, dealt by item.

A document is in one task as a whole, so no key's impacts lie in two tasks, and common terms, long texts or groups of
copies make no task longer than its share of the input. Items are taken in blocks of ``PAIRS`` of their terms (a block
has at least one item), so what is handed to the workers is bounded however many items there are; each block reads the
texts once.

Null texts and texts without terms have no score; items without terms find nothing. Rows with equal or null ids are
documents and items of their own; of equal scores the smaller id is first, null last, rows of one id in no set order. An empty
table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import words
from tidewatch.llm.runtime import Stash, prepare

#: Pairs of an item and one of its terms that are handed to the workers at a time.
PAIRS = 1 << 20
#: Entries that are sorted at a time; a document's own are never parted.
ENTRIES = 1 << 22
#: Items and documents of a block, so that each is one digit of the packed key.
DIGIT = 1 << 16
#: Lists that a task merges before the last merge.
FAN = 64
#: Bytes as terms see them: those that end a term are spaces, capitals are small.
_TERM = np.full(256, 32, np.uint8)
_TERM[48:58] = np.arange(48, 58)
_TERM[97:123] = _TERM[65:91] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)


class Index(NamedTuple):
    """The terms of a block of items, sorted by hash, and the items that have each."""

    hashes: np.ndarray
    data: np.ndarray  # the terms' bytes, one behind the other
    start: np.ndarray  # of each term in data, and its end
    first: np.ndarray  # items of term t are items[first[t] : first[t + 1]]
    items: np.ndarray  # numbers of items, ascending within a term
    ids: list  # the items' ids by number


def split(data: np.ndarray, at: np.ndarray) -> words.Words:
    return words.split(_TERM[data], at)


def index(items: list[tuple[int | None, str]]) -> Index:
    texts = pa.array([t for _, t in items], pa.large_string())
    data, at = words.text_bytes(texts)
    w = split(data, at)
    owner = np.repeat(np.arange(len(items)), np.diff(w.first))
    known: dict[bytes, int] = {}
    term = np.array([known.setdefault(w.data[a:b].tobytes(), len(known)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)], np.int64)
    spelt = sorted(known, key=known.get)
    bytes_, ends = np.frombuffer(b"".join(spelt), np.uint8), np.cumsum([len(t) for t in spelt], dtype=np.int64)
    starts = ends - np.array([len(t) for t in spelt], np.int64)
    h = words.word_hashes(words.Words(bytes_, starts, ends, np.array([0, len(spelt)])))
    order = np.argsort(h, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    pairs = np.unique(place[term] * len(items) + owner) if len(term) else np.zeros(0, np.int64)
    first = np.searchsorted(pairs // max(1, len(items)), np.arange(len(order) + 1))
    return Index(h[order], bytes_, np.stack([starts[order], ends[order]]), first, pairs % max(1, len(items)), [i for i, _ in items])


def matches(w: words.Words, ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """(word, term) for every word that is a term of the index; hashes find it, bytes decide."""
    h = words.word_hashes(w)
    at = np.searchsorted(ix.hashes, h)
    at[at == len(ix.hashes)] = 0
    word = np.flatnonzero(ix.hashes[at] == h) if len(ix.hashes) else np.zeros(0, np.int64)
    term = at[word]
    # two terms of one hash are neighbours; the next is tried where the bytes differ
    found, left = np.zeros(len(word), bool), np.arange(len(word))
    while len(left):
        same = _equal(w, ix, word[left], term[left])
        found[left[same]] = True
        left = left[~same]
        term[left] += 1
        left = left[term[left] < len(ix.hashes)]
        left = left[ix.hashes[term[left]] == h[word[left]]]
    return word[found], term[found]


def _equal(w: words.Words, ix: Index, word: np.ndarray, term: np.ndarray) -> np.ndarray:
    n = w.end[word] - w.start[word]
    same = ix.start[1, term] - ix.start[0, term] == n
    one, two = (np.ndarray((len(d) + 1,), "<u8", np.concatenate([d, np.zeros(8, np.uint8)]).data, strides=(1,)) for d in (w.data, ix.data))
    left = np.flatnonzero(same)
    for k in range(0, int(n[left].max(initial=0)), 8):
        left = left[n[left] > k]
        unused = (8 - np.minimum(n[left] - k, 8)).astype(np.uint64) * np.uint64(8)
        differ = (one[w.start[word[left]] + k] ^ two[ix.start[0, term[left]] + k]) << unused != 0
        same[left[differ]] = False
        left = left[~differ]
    return same


def _matched(ix):
    """doc_id, n, terms, tfs of each document; documents without a matched term have empty lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in words.chunks(batch.column(1)):
                w = split(data, at)
                n = np.diff(w.first)
                word, term = matches(w, ix.value)
                doc = np.searchsorted(w.first, word, "right") - 1
                key, tf = np.unique(doc * np.int64(1 << 32) + term, return_counts=True)
                first = np.searchsorted(key >> 32, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in ((key & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def impacts(tf: np.ndarray, weight: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The fixed formula of an occurrence count, the term's weight and the document's length factor."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned 32-bit keys: a counting sort for each digit of 16 bits, the lower one first. A digit
    that is in order already needs none."""
    low, order = (keys & np.uint32(DIGIT - 1)).astype(np.uint16), None
    if not np.all(low[1:] >= low[:-1]):
        order = np.argsort(low, kind="stable")
    high = (keys >> np.uint32(16)).astype(np.uint16)
    return np.argsort(high, kind="stable") if order is None else order[np.argsort(high[order], kind="stable")]


def accumulated(item: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) with the impacts of equal pairs added up, sorted by item, then doc."""
    keys = item.astype(np.uint32) << np.uint32(16) | doc.astype(np.uint32)
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    score = np.add.reduceat(impact[order], first) if len(first) else np.zeros(0, np.int64)
    return (keys[first] >> np.uint32(16)).astype(np.int64), (keys[first] & np.uint32(DIGIT - 1)).astype(np.int64), score


class Best:
    """The k best (score, id) of each item, in heaps whose least is on top."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        heap = self.heaps.setdefault(item, [])
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            if len(heap) == self.k:
                least = max(least, heap[0][0])
            able = np.flatnonzero(scores >= least)
            able = able[np.lexsort((ids[able], null[able], -scores[able]))][: self.k]
            scores, ids, null = scores[able], ids[able], null[able]
        for s, i, no in zip(scores.tolist(), ids.tolist(), null.tolist(), strict=True):
            entry = (s, _NONE if no else -i)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


#: Stands for a null id, negated as the others are: behind every other.
_NONE = -(1 << 64)


def _blocks(entries: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ENTRIES entries, or of one document."""
    upto, lo = np.concatenate([[0], np.cumsum(entries)]), 0
    while lo < len(entries):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + ENTRIES, "right")) - 1)
        yield lo, min(hi, lo + DIGIT, len(entries))
        lo = min(hi, lo + DIGIT)


def _scored(ix, weights, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix_, w, best = ix.value, weights.value, Best(k)
        many = np.diff(ix_.first)  # items of each term
        for batch in batches:
            ids, null = np.asarray(batch.column(0).fill_null(0)), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            first = np.asarray(batch.column(2).offsets).astype(np.int64)
            terms, tfs = (np.asarray(batch.column(c).values) for c in (2, 3))
            upto = np.concatenate([[0], np.cumsum(many[terms])])
            for lo, hi in _blocks(upto[first[1:]] - upto[first[:-1]]):
                a, b = first[lo], first[hi]
                t, doc = terms[a:b], np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
                x = impacts(tfs[a:b], w[t], m[lo + doc])
                n = many[t]
                own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                item, doc, x = ix_.items[np.repeat(ix_.first[t], n) + own], np.repeat(doc, n), np.repeat(x, n)
                for low in range(0, len(ix_.ids), DIGIT):
                    mine = slice(None) if len(ix_.ids) <= DIGIT else (item >= low) & (item < low + DIGIT)
                    i, d, s = accumulated(item[mine] - low, doc[mine], x[mine])
                    i, d, s = i[s > 0], d[s > 0], s[s > 0]
                    edge = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else []
                    for p, q in zip(edge, edge[1:], strict=False):
                        best.add(low + int(i[p]), s[p:q], ids[lo + d[p:q]], null[lo + d[p:q]])
        rows = [(i, None if d == _NONE else -d, s) for i, heap in best.heaps.items() for s, d in heap]
        cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["item", "doc_id", "score"])

    return run


def _item_blocks(items: DataFrame, pairs: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about so many pairs of an item and a term, or of single items: every item is in the block
    that its hash gives it."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 2 / pairs))  # a term takes two bytes at least, with what ends it
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [(r[0], r[1]) for r in items.where(block == b).orderBy("item_id", "text").collect()]


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", pairs: int = PAIRS, stash: Stash | None = None) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item, those of score 0 left out. Ids are
    whole numbers of at most 64 bits."""
    spark = docs.sparkSession
    prepare(spark)
    stash = stash or Stash(spark, "lexical")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_text), F.lit("")).alias("text"))
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    out = []
    for b, block in enumerate(_item_blocks(items, pairs)):
        ix = spark.sparkContext.broadcast(index(block))
        table = stash.keep(docs.mapInArrow(_matched(ix), "doc_id long, n long, terms array<int>, tfs array<long>"), f"matched-{b}")
        n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = np.zeros(len(ix.value.hashes), np.int64)
        counted = table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toPandas()  # at most a block's terms
        df[counted["t"].to_numpy(np.int64)] = counted["df"].to_numpy(np.int64)
        weights = spark.sparkContext.broadcast(np.array([weight(n_docs, int(x)) for x in df], np.int64))
        lists = table.where(F.size("terms") > 0).mapInArrow(_scored(ix, weights, n_docs, n_terms or 1, k), "item int, doc_id long, score long")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        near = Window.partitionBy("item", "fan").orderBy(*order)
        lists = lists.withColumn("fan", F.pmod(F.spark_partition_id(), F.lit(FAN))).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
        best = lists.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(ix.value.ids)), "item int, item_id long")
        out.append(stash.keep(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), f"best-{b}"))
        stash.drop(f"matched-{b}")
    return reduce(DataFrame.unionByName, out)
