"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

Words are maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased; of words of more
than ``LONG`` bytes each ``PIECE`` bytes count as a word, so unspaced text has words, too. At each anchor (a common word of
the language list below) the content words that follow, those that are no anchors, make chains: one for each of ``CHAINS``, a
pair of how many words and of how many words from one to the next. An anchor with its chain is a signature; a chain
that the text ends is one up to there. Anchors are frequent in prose and rare elsewhere, so signatures stand for
the text proper. Where no anchor is among the ``GAP`` words before a word and itself, as in lists, code or other
languages, the word stands as its own anchor, and its chain is of all words. Both rules look at the words near by
alone, so an edit changes signatures near by alone, whatever their number. A text without words is its own one signature.

A fingerprint is the sorted set of 40-bit hashes of the signatures, in fixed-width hex; likeness is Jaccard. Pairs
are compared only if the smaller set can reach the wanted likeness at all (partitioning by set length), and a
comparison stops when what is left can't change the outcome.

Null texts are empty. An empty text has the empty fingerprint, whose likeness to itself is 1 and to others 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import lexical, words
from tidewatch.llm.runtime import Stash, prepare

#: (words, from one to the next) of the chains; words that are cut, and into how much; words without anchor.
CHAINS, LONG, PIECE, GAP, WIDTH = ((2, 1), (3, 1), (2, 2)), 16, 8, 8, 10
#: Characters whose words are hashed at a time, unless one text is longer.
BATCH = 1 << 21
#: Fixed list of anchors: common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
    der die und das von zu den mit ist des im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    le la les et un une du en est que qui dans pour par sur pas au plus ne se ce il sont aux avec
    el los las y del se por con no para al lo como su más o pero sus ha era""".split()
)
_ANCHORS = {a.encode() for a in ANCHORS}


def _pieces(w: words.Words) -> words.Words:
    """Words with long ones cut."""
    n = w.end - w.start
    parts = np.where(n > LONG, -(-n // PIECE), 1)
    own = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(w.start, parts) + own * PIECE
    end = np.where(np.repeat(parts == 1, parts), np.repeat(w.end, parts), np.minimum(start + PIECE, np.repeat(w.end, parts)))
    return words.Words(w.data, start, end, np.concatenate([[0], np.cumsum(parts)])[w.first])


def _words(text: str) -> list[bytes]:
    data, at = words.text_bytes(pa.array([text], pa.large_string()))
    w = _pieces(lexical.split(data, at))
    return [w.data[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]


def _chains(text: str) -> set[tuple]:
    """The signatures of anchors, one by one: (anchor, chain's kind, words ... and None where the text ends them)."""
    ws, out = _words(text), set()
    content = [w for w in ws if w not in _ANCHORS]
    k = 0  # content words before the current word
    for w in ws:
        if w in _ANCHORS:
            for c, (n, step) in enumerate(CHAINS):
                out.add((w, c, *(content[k + j * step] if k + j * step < len(content) else None for j in range(n))))
        else:
            k += 1
    return out


def signatures(text: str) -> set[tuple]:
    """All signatures of a text, one by one; ``_hashes`` has the same for many texts at once."""
    ws, out, last = _words(text), _chains(text), None
    for i, w in enumerate(ws):
        last = i if w in _ANCHORS else last
        if last is None or i - last > GAP:
            out |= {(w, len(CHAINS) + c, *(ws[i + (j + 1) * step] if i + (j + 1) * step < len(ws) else None for j in range(n))) for c, (n, step) in enumerate(CHAINS)}
    return out or ({(text.encode("utf-8", "surrogatepass"),)} if text else set())


def _anchor_hashes() -> np.ndarray:
    data = b"".join(sorted(_ANCHORS))
    end = np.cumsum([len(a) for a in sorted(_ANCHORS)])
    start = end - np.array([len(a) for a in sorted(_ANCHORS)])
    return np.sort(words.word_hashes(words.Words(np.frombuffer(data, np.uint8), start, end, np.array([0, len(start)]))))


def _linked(head: np.ndarray, kind: int, parts: list[np.ndarray]) -> np.ndarray:
    """A hash of a head, the chain's kind and its words in order."""
    out = words.mix(head + np.uint64(kind + 1))
    for p in parts:
        out = words.mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def _signed(texts: list[str]) -> list[np.ndarray]:
    """The hashes of ``signatures`` of each text, ascending and different."""
    data, at = words.text_bytes(pa.array(texts, pa.large_string()))
    w = _pieces(lexical.split(data, at))
    h, n = words.word_hashes(w), np.diff(w.first)
    text = np.repeat(np.arange(len(texts)), n)
    anchor = np.isin(h, _anchor_hashes())
    none = np.uint64(0x5851F42D4C957F2D)
    place = np.arange(len(h))

    def chains(heads: np.ndarray, begin: np.ndarray, seq: np.ndarray, upto: np.ndarray, first: int) -> list[np.ndarray]:
        """Chains of seq from begin on, not beyond upto, of the words at heads."""
        padded, out = np.append(seq, none), []
        for c, (k, step) in enumerate(CHAINS):
            got = [padded[np.where(begin + j * step < upto, begin + j * step, len(seq))] for j in range(k)]
            out.append(_linked(h[heads], first + c, got))
        return out

    before = np.concatenate([[0], np.cumsum(~anchor)])  # content words before each place
    heads = np.flatnonzero(anchor)
    found = chains(heads, before[heads], h[~anchor], before[w.first[1:]][text[heads]] if len(h) else heads, 0)
    last = np.maximum.accumulate(np.where(anchor, place, -1)) if len(h) else place
    lone = np.flatnonzero((last < w.first[:-1][text]) | (place - last > GAP)) if len(h) else place
    # a lone word's chain begins a step behind it
    for c, (k, step) in enumerate(CHAINS):
        upto = w.first[1:][text[lone]] if len(h) else lone
        padded = np.append(h, none)
        got = [padded[np.where(lone + (j + 1) * step < upto, lone + (j + 1) * step, len(h))] for j in range(k)]
        found.append(_linked(h[lone], len(CHAINS) + c, got))
    owner = np.concatenate([text[heads]] * len(CHAINS) + [text[lone]] * len(CHAINS))
    hashes = np.concatenate(found) >> np.uint64(64 - 4 * WIDTH)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    if len(hashes):
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])
        owner, hashes = owner[new], hashes[new]
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = [hashes[a:b] for a, b in zip(edge, edge[1:], strict=False)]
    for i in np.flatnonzero(n == 0):
        if texts[i]:  # without words
            out[i] = np.array([int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=WIDTH // 2).digest())], np.uint64)
    return out


def _hashes(text: str) -> np.ndarray:
    return _signed([text])[0]


def _hex(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH // 2 :].tobytes().hex()


def fingerprint(text: str) -> str:
    return _hex(_hashes(text))


def _set(print_: str) -> set[str]:
    return {print_[i : i + WIDTH] for i in range(0, len(print_), WIDTH)}


def likeness(a: str, b: str, least: float = 0.0) -> float:
    """Jaccard of two fingerprints; 0 if it is below ``least``, as told by lengths alone or part of the way."""
    n, m = len(a) // WIDTH, len(b) // WIDTH
    if a == b:
        return 1.0
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    x, y = (_set(a), _set(b)) if n <= m else (_set(b), _set(a))
    spare = len(x) - least / (1 + least) * (n + m)  # misses that can be afforded
    common = 0
    for s in x:
        if s in y:
            common += 1
        else:
            spare -= 1
            if spare < -1e-9:
                return 0.0
    return common / (n + m - common)


def similar(docs: DataFrame, least: float = 0.5, key: str = "doc_id", text: str = "text", stash: Stash | None = None) -> DataFrame:
    """a, b, likeness: pairs of different fingerprints, by hash, at or above ``least``; with ``members`` for the rows
    of each. Sets are partitioned by length: length classes grow by 1 / least, so a partner is in the same class or
    the next, and each class is probed with the prefix that a partner can't miss."""
    prepare(docs.sparkSession)
    stash = stash or Stash(docs.sparkSession, "spots")
    prints = F.md5("fingerprint")
    rows = stash.keep(fingerprints(docs, key, text).select(prints.alias("id"), "fingerprint").where("fingerprint <> ''").distinct(), "prints")
    n = F.length("fingerprint") / WIDTH
    rows = rows.withColumn("n", n.cast("int")).withColumn("class", F.floor(F.log("n") / F.lit(-math.log(least)) + 1e-9).cast("int"))
    prefix = (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int")
    sig = F.explode(F.transform(F.sequence(F.lit(0), prefix - 1), lambda i: F.col("fingerprint").substr(i * WIDTH + 1, F.lit(WIDTH)))).alias("sig")
    a = rows.select("id", "n", "class", sig)
    probe = a.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    near = F.least("n", "m") >= F.greatest("n", "m") * least
    met = probe.select(F.col("id").alias("a"), "n", "class", "sig").join(a.select(F.col("id").alias("b"), F.col("n").alias("m"), "class", "sig"), ["class", "sig"]).where("a <> b").where(near)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = met.join(rows.select(F.col("id").alias("a"), F.col("fingerprint").alias("fa")), "a").join(rows.select(F.col("id").alias("b"), F.col("fingerprint").alias("fb")), "b").select("a", "b", "fa", "fb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [likeness(x, y, least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["a", "b", "likeness"])

    return both.mapInArrow(run, "a string, b string, likeness double").where(F.col("likeness") >= least)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint of each whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_hex(h) for h in _signed([t or "" for t in batch.column(1).to_pylist()])], pa.string())], names=[key, "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def edited(text: str, other: str) -> str:
    """The text with its last third replaced by the beginning of another, as much of it as there is."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """``likeness`` of two fingerprints' hashes."""
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 1.0


def _compared(rows: list[tuple[int, str, str]]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, next text: the row of each, for runs of rows of a bounded number of characters."""
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    lo = 0
    while lo < len(rows):
        hi, size = lo, 0
        while hi < len(rows) and (hi == lo or size < BATCH):
            size += len(rows[hi][1]) + len(rows[hi][2])
            hi += 1
        part = rows[lo:hi]
        own = _signed([t for _, t, _ in part] + [part[-1][2]])  # but for the last, a row's next is the row behind it
        after = [own[k + 1] if part[k][2] == part[k + 1][1] else _hashes(part[k][2]) for k in range(len(part) - 1)] + own[-1:]
        texts = [edited(t, n) for _, t, n in part]
        new = _signed(texts)
        out = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), _hex(f), _hex(g), _jaccard(f, g), _jaccard(f, a)) for (i, t, _), e, f, g, a in zip(part, texts, own, new, after, strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], x) for c, x in enumerate(types)], names=[c.split()[0] for c in _OUT.split(", ")])
        lo = hi


def _ranges(d: DataFrame, parts: int) -> DataFrame:
    """Append part: ranges of doc_id from the largest down, about even, nulls in one of their own. The bounds are
    ``parts`` numbers, looked up by bisection."""
    got = d.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(max(10_000, 20 * parts)))).first()[0] if parts > 1 else None
    bounds = np.unique(np.array(got or [], np.int64))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        at = len(bounds) - np.searchsorted(bounds, ids.fillna(0).to_numpy().astype(np.int64), "right")
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, at).astype(np.int32))

    return d.withColumn("part", part(F.col("doc_id")))


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, and its likeness to that of the edited text and that of the next document in
    descending order of the key (the last one's next is the first; null keys come last, ties by text).

    Rows are dealt by ranges of the key; the first row of the range behind, found from keys alone, stands at the end
    of each range as well. So each sorted range is one stream in which a row's next follows it, and texts are moved
    once. Only as many rows as there are ranges are joined, ranked or broadcast."""
    spark = docs.sparkSession
    prepare(spark)
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = _ranges(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")), parts)
    heads = d.groupBy("part").agg(F.max("doc_id").alias("head"))
    w = Window.orderBy("part")
    turn = heads.select("part", "head", F.coalesce(F.lag("part").over(w), F.max("part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    turn = F.broadcast(turn.select(F.col("part").alias("p"), "head", "before"))  # a row a range
    first = d.join(turn, (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("before").agg(F.min("text").alias("text"))
    ends = first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("part"), F.lit(1).alias("end"))
    every = d.withColumn("end", F.lit(0)).unionByName(ends).repartition("part").sortWithinPartitions("part", "end", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if held is not None:
                rows.insert(0, held)
            if rows:
                held = rows[-1]
                yield from _compared([(x[0], x[1], y[1]) for x, y in zip(rows, rows[1:], strict=False) if not x[3]])

    return every.mapInArrow(run, _OUT)
