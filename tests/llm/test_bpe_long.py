"""Joins within long unsplit runs: the ids are the library's, and little more than the text is encoded."""

import random

import pytest

from tidewatch.llm import bpe, queries


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return bpe.Codec(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())


def _runs(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    some = lambda s: "".join(r.choice(s) for _ in range(n))
    return [some("abcdefghijklmnopqrstuvwxyz"), "ab" * (n // 2), "a" * n, some("0123456789"), some("日本語中文字的是不了人我在有他"), " " * n + "x", some(" \n\t"), some("'sltdmrev "), some("é ñ日'。1 ,"), some("!?-=*/")]


def test_small_leaves(pair):
    c, lib = pair
    for seed in range(12):
        for text in _runs(240, seed):
            for leaf in (3, 7, 16, 50):
                assert c.encode(text, leaf) == lib.encode(text, add_special_tokens=False).ids


def test_real_leaves(pair):
    c, lib = pair
    for text in _runs(3 * bpe.LEAF_CHARS + 11):
        assert c.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_little_is_encoded_twice(pair):
    c, _ = pair
    n = 300_000
    text, spent, piece = _runs(n)[0], [], c._piece
    c._piece = lambda data: (spent.append(len(data)), piece(data))[1]
    try:
        c.encode(text)
    finally:
        del c._piece
    assert sum(spent) < 0.3 * n


def test_contractions_at_cuts(pair):
    """A cut between the letters of a contraction, with nothing near by where every scan has a boundary."""
    c, lib = pair
    r = random.Random(9)
    parts = ["'ll", "'re", "'ve", "'s", "'", "''", "l", "r", " ", "  ", "\n", "1", "22", "日本", "٣٤", "!", "'l", "é", "\u0301", "\u3000", "<|endoftext|>", "\t ", "'LL"]
    for _ in range(3000):
        text = r.choice(["", "1", " ", "日", "!", "'"]) * r.randrange(30) + "".join(r.choice(parts) for _ in range(r.randrange(1, 30)))
        leaf = r.randrange(1, 9)
        assert c.encode(text, leaf) == lib.encode(text, add_special_tokens=False).ids, (text, leaf)


@pytest.mark.parametrize("said", ["'ll", "'re", "'ve"])
@pytest.mark.parametrize("digit", ["7", "\u0663"])
def test_contractions_at_the_leaf_in_use(pair, said, digit):
    c, lib = pair
    text = digit * (bpe.LEAF_CHARS - 2) + said + " 1" + digit * 30_000
    assert c.encode(text) == lib.encode(text, add_special_tokens=False).ids
