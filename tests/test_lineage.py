"""What file numbers stand for, however many keys there are and whether or not keys are cut into ranges."""

import random

import pytest

from tidewatch.operators import lineage, scan


@pytest.fixture(scope="module")
def tables(spark):
    """Askers (process 1 or null has most of them), marks and parents, as rows and as tables."""
    r = random.Random(3)
    pid = lambda: r.choice([*[1] * 30, None, *range(2, 40)])
    asks = [(f"e{i}", pid(), r.randrange(2), r.randrange(60), i) for i in range(500)]
    marks = [(pid(), r.randrange(2), r.randrange(60), 1000 + i, r.choice([None, f"/p{i}"])) for i in range(250)]
    parents = [(p, p // 2) for p in range(1, 40)]
    made = spark.createDataFrame(asks, "event_id string, pid long, fd long, ts_unix_nano long, seq long"), spark.createDataFrame(marks, "pid long, fd long, ts_unix_nano long, seq long, v string"), spark.createDataFrame(parents, "pid long, ppid long")
    return asks, marks, made


def last(marks, pid, fd, at):
    before = [m for m in marks if m[0] == pid and m[1] == fd and m[2:4] < at]
    return max(before, key=lambda m: m[2:4])[4] if before else None


def wanted(asks, marks):
    out = {}
    for id_, pid, fd, *at in asks:
        p, hop, v = pid, 0, last(marks, pid, fd, tuple(at))
        while v is None and p is not None and p // 2 != p and hop < 7:
            p, hop = p // 2, hop + 1
            v = last(marks, p, fd, tuple(at))
        out[id_] = (v, hop if v is not None else None)
    return out


@pytest.mark.parametrize("most", [None, 40])
def test_inherited_against_a_plain_loop(tables, monkeypatch, most):
    asks, marks, (a, m, p) = tables
    if most:
        monkeypatch.setattr(scan, "ROWS", most)
    got = lineage.inherited(a, m, p).collect()
    assert {r["event_id"]: (r["v"], r["hop"]) for r in got} == wanted(asks, marks) and len(got) == len(asks)


def test_only_large_keys_are_cut(tables, monkeypatch):
    """A state for each range of each small key would be about as many rows as there are."""
    asks, marks, (a, m, _) = tables
    carried, states = scan.carried, []
    monkeypatch.setattr(scan, "carried", lambda df, s: states.append(s) or carried(df, s))
    lineage.as_of(a, m).collect()
    assert not states
    monkeypatch.setattr(scan, "ROWS", 40)
    got = lineage.as_of(a, m).collect()
    assert {r["event_id"]: r["v"] for r in got} == {e: last(marks, p, f, tuple(at)) for e, p, f, *at in asks}
    assert len(states) == 1 and {r["pid"] for r in states[0].select("pid").distinct().collect()} == {1}
