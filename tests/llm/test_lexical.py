"""Ranked lexical search against a plain ranking of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import lexical, words

DOCS, ITEMS = "doc_id long, text string, score string, rank int", "item_id long, text string, doc_id long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t, *_ in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    N, L, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text, *_ in items:
        said = []
        for i, c, n in held:
            m = 100 - 90 + 90 * n * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                said.append((-s, i is None, i or 0))
        out += [(q, r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(said)[:k])]
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["the", "The", "of", "ÜBER", "über", "日本", "naïve", "x1", "a_b", "É", "longwordlongwordlongword", "longwordlongwordlongwore"] + [f"w{i}" for i in range(60)]
    text = lambda n: r.choice(" \n-").join(r.choice(vocab) for _ in range(n))
    docs = [(i if i % 17 else None, text(r.randrange(0, 60)), "s", 1) for i in range(150)]
    docs += [(500 + i, "the same text of w1 w2", "s", 1) for i in range(25)] + [(7, "w1 w1 w1", "s", 1), (900, None, "s", 1), (901, "--- !!", "s", 1), (902, "w3 " * 9000, "s", 1)]
    items = [(i, text(r.randrange(0, 12)), 3) for i in range(20)] + [(3, "w1 w2 w1", 3), (None, "the of", 3), (77, None, 3), (78, "...", 3), (79, "unheard of", 3)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_brute(spark, seed, monkeypatch):
    docs, items = corpus(seed)
    d, q = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)
    got = lambda **o: sorted(map(tuple, lexical.search(d, q, **o).collect()), key=str)
    want = brute(docs, items)
    assert got() == want
    assert got(pairs=20) == want  # many blocks of items
    assert got(k=3) == brute(docs, items, 3)


def test_small_blocks_of_entries(monkeypatch):
    r = np.random.default_rng(0)
    monkeypatch.setattr(lexical, "ENTRIES", 7)
    n = r.integers(0, 12, 50)
    runs = list(lexical._blocks(n))
    assert [a for a, _ in runs] == [0, *[b for _, b in runs[:-1]]] and runs[-1][1] == 50
    assert all(n[a:b].sum() <= 7 or b == a + 1 for a, b in runs)


def test_radix_and_sums():
    r = np.random.default_rng(1)
    for n in (0, 1, 5000):
        keys = r.integers(0, 1 << 32, n).astype(np.uint32)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
        item, doc, x = r.integers(0, 40, n), r.integers(0, 60, n), r.integers(0, 1 << 40, n)
        i, d, s = lexical.accumulated(item, doc, x)
        want = Counter()
        for a, b, c in zip(item.tolist(), doc.tolist(), x.tolist(), strict=True):
            want[a, b] += c
        assert list(zip(i.tolist(), d.tolist(), strict=True)) == sorted(want) and s.tolist() == [want[k] for k in sorted(want)]


def test_terms_of_one_hash_are_told_by_their_bytes(monkeypatch):
    monkeypatch.setattr(words, "word_hashes", lambda w: np.full(len(w.start), 5, np.uint64))
    ix = lexical.index([(1, "aa bb abcdefghij"), (2, "bb cc")])
    data, at = words.text_bytes(__import__("pyarrow").array(["bb xx abcdefghij abcdefghik aa"]))
    w = lexical.split(data, at)
    word, term = lexical.matches(w, ix)
    spelt = [ix.data[a:b].tobytes() for a, b in ix.start.T]
    assert [(k, spelt[t]) for k, t in zip(word.tolist(), term.tolist(), strict=True)] == [(0, b"bb"), (2, b"abcdefghij"), (4, b"aa")]


def test_empty(spark):
    d, q = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 2)], ITEMS)
    assert lexical.search(d, q).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "a", "s", 1)], DOCS), spark.createDataFrame([], ITEMS)).collect() == []
