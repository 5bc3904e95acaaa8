"""Exact Jaccard self-join on word n-grams by vertical partitioning, and the groups that its links make.

The n-grams of all documents stand in one global order: rarest first, ties by hash. The hash range is cut into
fragments, each dealt to a task of its own with nothing but its n-grams, and

1. a fragment tells which of its n-grams more than one text holds, and in how many; one that a single text holds
   can't be in any overlap, but counts as the rarest of its text;
2. each text gets these back from all fragments. It can have a partner only if n-grams of its prefix in the global
   order are shared; the prefix is what may be missing from a partner, and one more;
3. texts that share a prefix n-gram are candidates. Their sets, cut into vertical segments by hash again, are
   intersected segment by segment, and the partial overlaps summed per pair.

Equal texts are one text from the start: copies meet as equal ids within a fragment and count once. Groups of near
copies don't grow into all their pairs: in a few rounds each text is only held against one text of each of its prefix
n-grams, another one each time, and n-grams whose texts are all connected are left out from then on; at last every pair
that is not connected and shares a prefix n-gram is counted. So links between texts of one group that others already
connect need not be counted, and no other link is lost. Texts of one group that only just fail to link are refuted pair
by pair; bounds inside the join keep most of these pairs from being made, but their number still follows the square of
such a group.

Texts are told apart by 64 bits of hash, n-grams by 52 bits within their fragment; two texts are taken for copies by
chance once in about 2 ** 64 pairs. Null texts and texts without words have no n-grams and no links; texts with fewer than n words
have one n-gram, the whole. Rows with equal ids are treated as the separate texts that they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import words
from tidewatch.llm.components import components
from tidewatch.llm.runtime import Stash, prepare

#: n-grams that a fragment should hold; with their texts' ids they take some 100 MB of a task's memory.
FRAGMENT = 1 << 21
#: Texts and bytes that are sorted into fragments at a time.
TEXTS, BYTES = 4096, 8 << 20
_ROW = "frag int, ids binary, ns binary, grams binary"
SEGMENTS = 8
#: Rounds against single texts, at most; they end when few pairs are left, or a round has settled few of them.
ROUNDS = 4


def fragments_for(docs: DataFrame, text: str, per_byte: float = 1 / 6, least: int = 64) -> int:
    """A power of two, from the amount of text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, 1 << int(np.ceil(np.log2(max(1, total * per_byte / FRAGMENT)))))


def gathered(batches: Iterator[pa.RecordBatch], texts: int = TEXTS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together up to so many rows or bytes."""
    held, n, b = [], 0, 0
    for batch in batches:
        if held and (n + batch.num_rows > texts or b + batch.nbytes > size):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, b = [], 0, 0
        if batch.num_rows:
            held.append(batch)
            n, b = n + batch.num_rows, b + batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _to_fragments(docs: DataFrame, k: int, frags: int) -> DataFrame:
    """A row for each batch and fragment: ids of the batch's texts that are in it, and their n-grams (52 bits of hash,
    12 of index into the ids). Rows from ``frags`` on hold sizes of sets instead, dealt by text id, and from twice that on the batch's
    table of documents, which is dealt anyhow."""
    shift = np.uint64(64 - int(np.log2(frags)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            ids, got = [], []
            for lo, _, data, at in words.chunks(batch.column(1)):
                w = words.split(data, at, lower=True)
                h = words.word_hashes(w)
                g, text = words.grams(h, w.first, k, short=True)
                got.append(np.sort((g & ~np.uint64(4095)) | (text + lo).astype(np.uint64)))
                whole = words.run_hashes(h, w.first[:-1], w.first[1:])
                ids.append(np.where(np.diff(w.first) > 0, whole, np.uint64(0)))
            ids, grams = np.concatenate(ids), np.concatenate(got)
            grams.sort(kind="stable")
            if len(grams):
                grams = grams[np.concatenate([[True], grams[1:] != grams[:-1]])]
            n = np.bincount((grams & np.uint64(4095)).astype(np.int64), minlength=len(ids)).astype(np.int32)
            keys = batch.column(0).cast(pa.int64())
            known = ~np.asarray(keys.is_null())
            keys = np.asarray(keys.fill_null(0))
            out = [(2 * frags + int(words.mix(keys[:1].view(np.uint64))[0] % np.uint64(frags)), ids.tobytes(), n.tobytes(), keys.tobytes() + known.tobytes())]
            # copies in one batch: the first stands for all
            once, first = np.unique(ids, return_index=True)
            one = np.zeros(len(ids), bool)
            one[first] = True
            home = (once >> shift).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
            out += [(frags + int(home[x]), once[x:y].tobytes(), n[first[x:y]].tobytes(), b"") for x, y in zip(edge, edge[1:], strict=False)]
            if len(grams):
                grams = grams[one[(grams & np.uint64(4095)).astype(np.int64)]]
                frag = (grams >> shift).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1], [True]]))
                for x, y in zip(edge, edge[1:], strict=False):
                    held, at = np.unique(grams[x:y] & np.uint64(4095), return_inverse=True)
                    out.append((int(frag[x]), ids[held.astype(np.int64)].tobytes(), b"", words.to_planes((grams[x:y] & ~np.uint64(4095)) | at.astype(np.uint64))))
            for lo in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[lo : lo + 64], strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["frag", "ids", "ns", "grams"])

    return docs.mapInArrow(run, _ROW)


def _shared(frags: int):
    """For each fragment: its n-grams that at least two different texts hold, with the number that do (df), dealt
    by text id for step 2. Document tables pass through."""
    shift = np.uint64(64 - int(np.log2(frags)))
    names, types = ["bucket", "kind", "ids", "grams", "df"], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        f, out = key[0].as_py(), []
        if f >= frags:
            ids, ns, keys = (table.column(c).to_pylist() for c in ("ids", "ns", "grams"))
            out = [(f % frags, f // frags, i, k, n) for i, n, k in zip(ids, ns, keys, strict=True)]
        else:
            grams, ids = [], []
            for i, g in zip(table.column("ids"), table.column("grams"), strict=True):
                g = words.from_planes(g.as_buffer())
                grams.append(g >> np.uint64(12))
                ids.append(np.frombuffer(i.as_buffer(), np.uint64)[(g & np.uint64(4095)).astype(np.int64)])
            grams, ids = np.concatenate(grams), np.concatenate(ids)
            order = np.argsort(grams, kind="stable")
            grams, ids = grams[order], ids[order]
            same = grams[1:] == grams[:-1]
            often = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            grams, ids = grams[often], ids[often]
            order = np.lexsort((ids, grams))
            grams, ids = grams[order], ids[order]
            if len(grams):
                new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (ids[1:] != ids[:-1])])
                grams, ids = grams[new], ids[new]
                _, where, df = np.unique(grams, return_inverse=True, return_counts=True)
                df = df[where].astype(np.int32)
                at = np.argsort(ids, kind="stable")
                at = at[df[at] > 1]
                grams, ids, df = grams[at], ids[at], df[at]
                bucket = (ids >> shift).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(ids) else []
                out = [(int(bucket[a]), 0, ids[a:b].tobytes(), grams[a:b].tobytes(), df[a:b].tobytes()) for a, b in zip(edge, edge[1:], strict=False)]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return run, "bucket int, kind int, ids binary, grams binary, df binary"


def _candidates(share: float):
    """For each text that shares enough n-grams to have a partner: its set's size n, its shared n-grams in the
    global order, and how many of them are in its prefix."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        cols = {c: table.column(c).to_pylist() for c in ("ids", "grams", "df")}
        size = {}
        for k in np.flatnonzero(kind == 1):
            size.update(zip(np.frombuffer(cols["ids"][k], np.uint64).tolist(), np.frombuffer(cols["df"][k], np.int32).tolist(), strict=True))
        pick = np.flatnonzero(kind == 0)
        rows = []
        if len(pick):
            ids, grams, df = (np.concatenate([np.frombuffer(cols[c][k], t) for k in pick]) for c, t in (("ids", np.uint64), ("grams", np.uint64), ("df", np.int32)))
            order = np.lexsort((grams, df, ids))
            ids, grams = ids[order], grams[order].view(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
            for a, b in zip(edge, edge[1:], strict=False):
                n = size[int(ids[a])]
                need = int(np.ceil(share * n - 1e-9))
                prefix = n - need + 1 - (n - (b - a))
                if prefix > 0:
                    rows.append((int(ids[a].view(np.int64)), n, grams[a:b], int(prefix)))
        types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["id", "n", "grams", "prefix"])

    return run, "id long, n int, grams array<long>, prefix int"


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose overlap is enough: 100 |A and B| >= percent |A or B|. Partial overlaps are counted segment by
    segment and summed per pair."""
    a = segments.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("segments").alias("ga"))
    b = segments.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("segments").alias("gb"))
    parts = F.zip_with("ga", "gb", lambda x, y: F.size(F.array_intersect(x, y)))
    both = pairs.join(a, "a").join(b, "b").select(*pairs.columns, "na", "nb", F.aggregate(parts, F.lit(0), lambda s, x: s + x).alias("o"))
    return both.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select(pairs.columns)


def _open(post: DataFrame) -> DataFrame:
    """Postings of the n-grams that still bring texts of different roots together."""
    still = post.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
    return post.join(still, "gram", "left_semi")


def join(docs: DataFrame, k: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text", every_link: bool = False, stash: Stash | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, links). membership: key, id (of its text; null without words), n_shingles and component (least
    text id that links lead to; null without words). links: pairs a, b of text ids with at least percent/100 of their
    n-grams in common: those that were needed for the components, which are complete, or with ``every_link`` all of
    them, which in a group of near copies grow with its square. Keys are numbers that 64 bits hold."""
    spark = docs.sparkSession
    prepare(spark)
    stash = stash or Stash(spark, "ngrams")
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    frags = fragments_for(docs, "text")
    run, schema = _shared(frags)
    shared = stash.keep(_to_fragments(docs, k, frags).groupBy("frag").applyInArrow(run, schema), "shared")
    run, schema = _candidates(percent / 100)
    cand = stash.keep(shared.where("kind < 2").groupBy("bucket").applyInArrow(run, schema), "candidates")

    post = cand.select("id", "n", F.posexplode(F.slice("grams", 1, F.col("prefix"))).alias("i", "gram"), (F.col("n") - F.size("grams")).alias("single"))
    post = stash.keep(post.select("gram", "id", "n", (F.col("n") - F.col("single") - F.col("i") - 1).alias("rest"), F.col("id").alias("root")), "postings")
    segments = cand.select("id", "n", F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda k: F.filter("grams", lambda x: F.shiftrightunsigned(x, 49) == k)).alias("segments"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")

    links, merged, size, ahead = [], [], cand.count(), None
    for r in range(0 if every_link else ROUNDS):
        own = stash.keep(_open(post), f"open-{r}")
        stash.drop("postings" if r == 0 else f"open-{r - 1}")
        post = own
        left = own.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("gram").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("p"))
        ahead, before = left.agg(F.sum("p")).first()[0] or 0, ahead
        if ahead <= size or before is not None and ahead > 0.9 * before:
            break
        order = F.xxhash64("id", F.lit(r))
        lead = own.groupBy("gram").agg(*[F.min_by(c, order).alias(t) for c, t in (("id", "b"), ("n", "nb"), ("root", "other"))])
        stars = own.select("gram", "root", F.col("id").alias("a"), F.col("n").alias("na")).join(lead, "gram").where("root <> other").where(near).select("a", "b", "root", "other").distinct()
        links.append(stash.keep(_verified(stars, segments, percent), f"links-{r}"))
        if not links[-1].take(1):
            break
        step = stash.keep(components(links[-1].select(F.col("root").alias("a"), F.col("other").alias("b")), stash, f"steps-{r}"), f"merged-{r}")
        merged.append(step)
        post = own.join(step.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")

    # a pair is met at its first common prefix n-gram alone, if its prefixes have enough in common: what it shares
    # behind the prefix that ends first in the global order is at most what that text has behind it
    head = cand.select("id", F.slice("grams", 1, F.col("prefix")).alias("head"), (F.size("grams") - F.col("prefix")).alias("tail"))
    own = (post if every_link else _open(post)).join(head, "id")
    a, b = (own.select("gram", *[F.col(c).alias(c + s) for c in ("id", "n", "rest", "root", "head", "tail")]) for s in "ab")
    both = F.array_intersect("heada", "headb")
    need = percent * (F.col("na") + F.col("nb"))
    bound = ((1 + F.least("resta", "restb")) * (100 + percent) >= need) & ((F.size(both) + F.greatest("taila", "tailb")) * (100 + percent) >= need) & (F.get(both, F.lit(0)) == a["gram"])
    pairs = a.join(b, (a["gram"] == b["gram"]) & (F.col("ida") < F.col("idb")) & (F.col("roota") != F.col("rootb")) & near & bound)
    pairs = pairs.select(F.col("ida").alias("a"), F.col("idb").alias("b"), F.col("roota").alias("root"), F.col("rootb").alias("other"))
    links.append(stash.keep(_verified(pairs, segments, percent), "links-last"))
    edges = [links[-1].select(F.col("root").alias("a"), F.col("other").alias("b")), *(m.select(F.col("node").alias("a"), F.col("root").alias("b")) for m in merged)]
    final = stash.keep(components(reduce(DataFrame.unionByName, edges), stash, "steps-last"), "groups")

    table = _documents(shared.where("kind = 2"))
    member = table.join(final.select(F.col("node").alias("id"), F.col("root")), "id", "left").select("key", "id", "n_shingles", F.coalesce("root", "id").alias("component"))
    return member, reduce(DataFrame.unionByName, [x.select("a", "b") for x in links])


def _documents(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, keys, ns in zip(batch["ids"], batch["grams"], batch["df"], strict=True):
                i, n = np.frombuffer(ids, np.uint64), np.frombuffer(ns, np.int32)
                known = np.frombuffer(keys, bool, offset=8 * len(i))
                yield pd.DataFrame({
                    "key": pd.Series(np.frombuffer(keys, np.int64, count=len(i)), dtype="Int64").where(known),
                    "id": pd.Series(i.view(np.int64), dtype="Int64").where(i != 0),
                    "n_shingles": n.astype(np.int64),
                })

    return rows.select("ids", "grams", "df").mapInPandas(run, "key long, id long, n_shingles long")


def groups(docs: DataFrame, k: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text", stash: Stash | None = None) -> DataFrame:
    """key, n_shingles, component_id: the least key in the component (the own key for a text without words)."""
    stash = stash or Stash(docs.sparkSession, "ngrams")
    member, _ = join(docs, k, percent, key, text, stash=stash)
    member = stash.keep(member, "members")
    stash.only("members")
    # written, so that the join below may split a large component's rows
    least = stash.keep(member.where("component is not null").groupBy("component").agg(F.min("key").alias("component_id")), "least")
    return member.join(least, "component", "left").select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"))
