"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is cut into leaves, which are encoded independently and in parallel threads, and neighbours are joined
two by two, level by level, by encoding a window around each join again. What makes the joined ids those of the whole
text:

- A scan decides about a piece by the characters of the piece and at most one behind it, but for an apostrophe, behind
  which it looks for two letters. So the left side's pieces are those of the whole text, save one that ends at the cut, and
  an apostrophe two characters before it, which the cut may have parted from its second letter: the left side has
  the pieces ``'`` and ``l`` where the text has ``'ll``. ``s`` is where the first of these begins. From there the whole
  text is scanned along with the right side until both have a boundary at the same place ``e``; from equal places on,
  equal text gives equal pieces. Only what is between s and e can change.
- Where a letter is followed by an ASCII character that is none, every scan has a boundary, wherever it began and
  whatever comes behind: no piece goes on from a letter to anything but a letter. If there are such places near by on
  both sides of the cut, they are taken for s and e, and the text between them is encoded anew.
- If that is one long piece cut in two (a run of letters, digits, CJK or white space), it is joined within the piece.
  Merges go by rank, so a sequence of tokens is the encoding of its bytes exactly if each pair of neighbours is the
  encoding of theirs. Sides and window have only such pairs within; a window that begins with the token of the left
  side that stands there, and ends with that of the right side, makes no other pair. Until both hold, it grows.

Null and empty texts give no ids. Any other text, however long, is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.runtime import prepare

#: Fixed value: the piece pattern of this family of byte-level vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 1 << 15
#: Bytes of texts, or of ids, that are worked on together.
SLICE = 1 << 20
#: Threads that encode the leaves of one text; the engine lets go of the interpreter meanwhile.
THREADS = 4
_LOADED: dict[str, Codec] = {}


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that such vocabulary files use for bytes: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One vocabulary file of the ``tokenizers`` library, run by a faster engine with the same ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.engine = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_ids = special
        self.pieces = regex.compile(PIECES)

    def decode(self, ids: list[int]) -> str:
        return self.engine.decode(ids, errors="replace")

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> list[int]:
        if len(text) <= leaf:
            return self.engine.encode(text, allowed_special="all")
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._tree(text[at : m.start()], leaf)
            out.append(self.special_ids[m[0]])
            at = m.end()
        return out + self._tree(text[at:], leaf)

    def _tree(self, text: str, leaf: int) -> list[int]:
        """Leaves of the same size first, then joins level by level."""
        if not text:
            return []
        cuts = [*range(0, len(text), leaf), len(text)]
        leaves = self.engine.encode_ordinary_batch([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], num_threads=THREADS)
        parts = list(zip(cuts, cuts[1:], leaves, strict=False))
        while len(parts) > 1:
            joined = [self._join(text, parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0][2]

    def _join(self, text: str, left: tuple, right: tuple) -> tuple:
        """Ids of text[a:b] from those of text[a:c] and text[c:b]."""
        (a, c, one), (_, b, two) = left, right
        for reach in (64, 512):  # in prose there are places near by where every scan has a boundary
            s = next((i for i in range(max(a, c - reach) + 1, c) if self._sure(text, i)), None)
            e = next((i for i in range(min(b, c + reach) - 1, c, -1) if self._sure(text, i)), None)
            if s is not None and e is not None:
                return a, b, one[: self._upto(one, text[s:c])] + self.engine.encode_ordinary(text[s:e]) + two[self._upto(two, text[c:e], front=True) :]
        s, opened = self._last_start(text, a, c)
        whole, e = [(s, self.pieces.match(text, s, b).end())], self.pieces.match(text, c, b).end()
        first = e
        while whole[-1][1] != e:
            if whole[-1][1] < e:
                whole.append((whole[-1][1], self.pieces.match(text, whole[-1][1], b).end()))
            else:
                e = self.pieces.match(text, e, b).end()
        if len(whole) == 1 and e == first and not opened:
            return a, b, self._within(text, one, two, s, c, e)
        ids = [i for p, q in whole for i in self._piece(text[p:q].encode())]
        return a, b, one[: self._upto(one, text[s:c])] + ids + two[self._upto(two, text[c:e], front=True) :]

    def _within(self, text: str, one: list[int], two: list[int], s: int, c: int, e: int) -> list[int]:
        """The join within the piece text[s:e], of which one ends with text[s:c] and two begins with text[c:e]."""
        behind, ahead, token = len(text[s:c].encode()), len(text[c:e].encode()), self.engine.decode_single_token_bytes
        back: list[bytes] = []  # tokens of the left side, from the cut back
        fore: list[bytes] = []
        n = m = 0
        reach = 32
        while True:
            while n < min(reach, behind):
                back.append(token(one[-1 - len(back)]))
                n += len(back[-1])
            while m < min(reach, ahead):
                fore.append(token(two[len(fore)]))
                m += len(fore[-1])
            window = self._piece(b"".join(reversed(back)) + b"".join(fore))
            if (n == behind or window[0] == one[-len(back)]) and (m == ahead or window[-1] == two[len(fore) - 1]):
                return one[: len(one) - len(back)] + window + two[len(fore) :]
            reach *= 2

    def _piece(self, data: bytes) -> list[int]:
        return self.engine._encode_single_piece(data)

    def _last_start(self, text: str, a: int, c: int) -> tuple[int, bool]:
        """Where the last piece of a scan of text[a:c] begins, or the one before it, if that is an apostrophe whose
        two letters the cut may have parted; and whether it is."""
        at = next((i for i in range(c - 1, max(a, c - 4096), -1) if self._sure(text, i)), a)
        before = at
        while (end := self.pieces.match(text, at, c).end()) < c:
            before, at = at, end
        opened = at == c - 1 and before == c - 2 and text[before] == "'"
        return (before, True) if opened else (at, False)

    @staticmethod
    def _sure(text: str, i: int) -> bool:
        """No piece goes on from a letter to something else, so a piece ends here wherever its scan began."""
        return text[i - 1].isalpha() and text[i] < "\x80" and not text[i].isalpha()

    def _upto(self, ids: list[int], text: str, front: bool = False) -> int:
        """Where in ids the text that they end (or begin) with starts (or stops); both are piece boundaries."""
        left, n = len(text.encode()), 0
        one = self.engine.decode_single_token_bytes
        for i in reversed(ids) if not front else ids:
            if left <= 0:
                break
            left -= len(one(i))
            n += 1
        return n if front else len(ids) - n


def codec(path: str) -> Codec:
    """The vocabulary at this path, loaded once in each worker process."""
    mine = sys.modules["tidewatch.llm.bpe"]._LOADED if "tidewatch.llm.bpe" in sys.modules else _LOADED
    if path not in mine:
        mine[path] = Codec(path)
    return mine[path]


def _slices(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose column ``of`` has about SLICE bytes, or of one row that has more: what Python holds
    at a time is bounded by a slice, and goes back when the task ends."""
    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            hi, size = lo, 0
            while hi < batch.num_rows and (hi == lo or size < SLICE):
                size += batch.column(of)[hi : hi + 1].nbytes
                hi += 1
            yield batch.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()


def token_lengths(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Append the number of ids of each whole text (0 for null)."""
    prepare(docs.sparkSession)
    at, schema = docs.columns.index(text), docs.drop(out).schema.add(out, "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in _slices(batches, at):
            n = pa.array([len(c.encode(t)) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            kept = [(f, x) for f, x in zip(batch.schema.names, batch.columns, strict=True) if f != out]
            yield pa.RecordBatch.from_arrays([x for _, x in kept] + [n], names=[f for f, _ in kept] + [out])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Append ``ids`` (array<int>) of each whole text; null counts as empty."""
    prepare(docs.sparkSession)
    at, schema = docs.columns.index(text), docs.drop("ids").schema.add("ids", T.ArrayType(T.IntegerType(), False), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in _slices(batches, at):
            ids = pa.array([c.encode(t) if t else [] for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            kept = [(f, x) for f, x in zip(batch.schema.names, batch.columns, strict=True) if f != "ids"]
            yield pa.RecordBatch.from_arrays([x for _, x in kept] + [ids], names=[f for f, _ in kept] + ["ids"])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded``, the text of each row's ids; no ids, or null, give the empty text."""
    prepare(encoded.sparkSession)
    at, schema = encoded.columns.index(ids), encoded.drop("decoded").schema.add("decoded", "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in _slices(batches, at):
            said = pa.array([c.decode(x) if x else "" for x in batch.column(at).to_pylist()], pa.string())
            kept = [(f, x) for f, x in zip(batch.schema.names, batch.columns, strict=True) if f != "decoded"]
            yield pa.RecordBatch.from_arrays([x for _, x in kept] + [said], names=[f for f, _ in kept] + ["decoded"])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``encode`` then ``decode`` in one pass over each batch, giving counts and digests in place of ids and text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in _slices(batches, 1):
            n, shas, texts = [], [], []
            for t in batch.column(1).to_pylist():
                ids = c.encode(t) if t else []
                n.append(len(ids))
                shas.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                texts.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shas), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
