"""The prefix trie against a plain one of nested dictionaries, on null, tied, repeated and very long conversations."""

import hashlib
import random
import re
import zlib

import pytest

from tidewatch.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
NONE = hashlib.sha256(b"").hexdigest()


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(x)] for c, x in own.items()}
    made = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    at = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            at.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in at.items():
        below = [p for p in at if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in at)
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = sorted(c for c in members if len(made[c]) == len(path))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(path), min(at[path[:-1]]) if path else None, len(members), kids(path), sum(not kids(p) for p in below), sum((len(at[p]) - 1) * words(p) for p in below), sha))
    return out


def trie(df):
    return prefix_trie.nodes(prefix_trie.borrowed(prefix_trie.turns(df))).collect()


def conversations(seed, n=60):
    r = random.Random(seed)
    say = lambda: r.choice(["hello there", "ok", "", "  two  words \n", "日本 語", "yes\x1fno"])
    rows = []
    for c in [*range(n), -3, -20, 10**12 + 7, 961]:
        if c % 13 == 5:  # gaps: bases that are absent among them
            continue
        k = r.randrange(1, 7)
        rows += [(c, t if r.random() < 0.95 else None, r.choice(["user", "user", "assistant", None]), say() if r.random() < 0.95 else None, "x") for t in range(k)]
        if r.random() < 0.1:
            rows.append(rows[-1])
    common = [("user", "start"), ("assistant", "a b"), ("user", "again"), ("assistant", "c")]
    for c in range(200, 240):  # copies, also of copies' beginnings
        rows += [(c, t, *common[t], "x") for t in range(2 + c % 3)]
    rows += [(None, 1, "user", "nobody", "x")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute(spark, seed):
    rows = conversations(seed)
    r = random.Random(seed)
    r.shuffle(rows)
    assert sorted(map(tuple, trie(spark.createDataFrame(rows, SCHEMA)))) == sorted(brute(rows))


def test_long_shared_prefixes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "IDS", 16)
    long = [(t, "user", f"turn number {t}") for t in range(70)]
    rows = [(c, *t, "x") for c in (0, 40, 60) for t in long] + [(20, *t, "x") for t in long[:66]] + [(80, *t, "x") for t in [*long[:69], (69, "user", "other")]]
    rows += [(c, 0, "user", "short", "x") for c in range(100, 140)]
    assert sorted(map(tuple, trie(spark.createDataFrame(rows, SCHEMA)))) == sorted(brute(rows))


def test_empty_and_turnless(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = trie(spark.createDataFrame([(turnless, 0, "user", "gone", "x")], SCHEMA))
    assert [tuple(r) for r in got] == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
