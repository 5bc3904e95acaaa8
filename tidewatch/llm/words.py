"""Words and word sequences of whole Arrow batches of texts, hashed with numpy and without a Python object per word.

A word is a maximal run of bytes other than space and tab to carriage return. Hashes of words and of whole texts are
64-bit: each element is mixed with its place in the run by multiplications and shifts, and the results are added up,
so no fixed pair of runs collides by their algebra, as it would under a polynomial modulo a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that are hashed at a time, unless one text is longer.
CHUNK = 2 << 20


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # index of each text's first word; one more at the end


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA5A3564E27F8A869)
    return x ^ (x >> np.uint64(32))


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end] of numbers; equal runs have equal hashes. Runs are in order and don't
    overlap; a run may be empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    begun = np.zeros(len(values) + 1, np.int64)
    begun[start] = start
    place = np.arange(len(values)) - np.maximum.accumulate(begun)[:-1]
    # the place alone is mixed first, so that no value at one place stands for another at the next
    place = _places(int(place.max(initial=0)) + 1)[place]
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ place), out=total[1:])
    return mix((total[end] - total[start]) + (end - start).astype(np.uint64) * np.uint64(_BASE))


_PLACES = [np.zeros(0, np.uint64)]


def _places(n: int) -> np.ndarray:
    if len(_PLACES[0]) < n:
        _PLACES[0] = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * np.uint64(_BASE))
    return _PLACES[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and where each text starts (one more at the end)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split(data: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    fresh, done = word.copy(), word.copy()
    fresh[1:] &= ~word[:-1]
    done[:-1] &= ~word[1:]
    full = at[:-1][at[:-1] < at[1:]]  # starts of texts that aren't empty
    fresh[full] = word[full]
    last = at[1:][at[:-1] < at[1:]] - 1
    done[last] = word[last]
    start, end = np.flatnonzero(fresh), np.flatnonzero(done) + 1
    return Words(data, start, end, np.searchsorted(start, at))


#: Words up to so many bytes are hashed 8 bytes at a time, chained; longer ones by ``run_hashes`` of their bytes.
SHORT = 64


def word_hashes(w: Words) -> np.ndarray:
    n = w.end - w.start
    out = n.astype(np.uint64) * np.uint64(_BASE)
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(w.data) + 1,), "<u8", padded.data, strides=(1,))
    left = np.flatnonzero(n <= SHORT)
    for k in range(0, SHORT, 8):
        left = left[n[left] > k]
        if not len(left):
            break
        unused = (8 - np.minimum(n[left] - k, 8)).astype(np.uint64) * np.uint64(8)
        part = (eight[w.start[left] + k] << unused) >> unused
        out[left] = mix(out[left] ^ part) + np.uint64(_BASE)
    if len(far := np.flatnonzero(n > SHORT)):
        at = np.cumsum(n[far])
        own = np.arange(at[-1]) + np.repeat(w.start[far] - (at - n[far]), n[far])
        out[far] = run_hashes(w.data[own].astype(np.uint64), at - n[far], at)
    return mix(out)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The batch in runs of texts (from, to) of about ``size`` bytes, or of one text that is longer."""
    data, at = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def grams(hashes: np.ndarray, first: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of k consecutive words. short: texts of 1 to k-1 words give one run of them all."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    i = np.flatnonzero(np.arange(len(hashes)) + k <= np.repeat(first[1:], n))
    out = np.zeros(len(i), np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + hashes[i + j]
    out, text = mix(out + np.uint64(k)), text[i]
    if short and len(few := np.flatnonzero((n > 0) & (n < k))):
        whole = run_hashes(hashes, first[few], first[few + 1])
        out, text = np.concatenate([out, whole]), np.concatenate([text, few])
    return out, text


def to_planes(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers byte plane by byte plane: the upper planes are long runs, which shuffles compress."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
