import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import features
from tidewatch.operators import models
from tidewatch.plans import pipelines
from tidewatch.sources.env import env
from tidewatch.streaming import keyed

NAMES = ["arg1_norm", "path_hash", "return_errno_norm"]


@pytest.mark.parametrize("name", sorted(models.MODELS))
def test_scores_are_finite_and_separate(name):
    rng = np.random.default_rng(0)
    extra = {"grace_map": 50, "grace_train": 300} if name == "kitnet" else {"beta": 5.0, "warmup": 64} if name == "memstream" else {}
    m = models.make(name, [f"f{i}" for i in range(4)], **extra)
    scores = [m.step(np.clip(rng.normal(0.5, 0.02, 4), 0, 1)) for _ in range(700)]
    assert all(math.isfinite(s) and s >= 0 for s in scores)
    assert m.score(np.array([0.01, 0.99, 0.02, 0.98])) >= np.median(scores[-100:])
    assert 0 <= m.scaled(scores[-1]) <= max(1, scores[-1])


def test_unknown_names():
    with pytest.raises(ValueError):
        models.make("loda", ["a"])
    with pytest.raises(ValueError):
        models.make("knn", ["a"], metric="canberra")
    with pytest.raises(ValueError):
        pipelines.Config(pipeline="legacy")


def test_rolling_rank_against_a_plain_loop():
    r, rank, seen = random.Random(1), models.RollingRank(50, 10), []
    for _ in range(400):
        x = r.choice([r.random(), 0.5])
        last = [math.log1p(v) for v in seen[-50:]]
        want = sum(v <= math.log1p(x) for v in last) / len(last) if len(last) >= 10 else 0.0
        assert abs(rank.step(x) - want) < 1e-12
        seen.append(x)


def test_spanning_tree_is_maximal():
    w = np.array([[0, 3, 1, 0], [3, 0, 2, 5], [1, 2, 0, 4], [0, 5, 4, 0]], float)
    assert sum(w[i, j] for i, j in models.spanning_tree(w)) == 12


def test_batch_equals_native_zscore(spark, sf):
    from tidewatch.operators import native

    e = features.extract(env(spark, sf), NAMES)
    a = {r["event_id"]: r["raw"] for r in keyed.score(e, "zscore", NAMES).collect()}
    b = {r["event_id"]: r["raw"] for r in native.zscore(e, NAMES, ["event_group"]).select("event_id", "raw").collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_stream_equals_batch(spark, sf, tmp_path):
    e = features.extract(env(spark, sf), NAMES).select("event_group", "event_id", "ts_unix_nano", "seq", *NAMES)
    e.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"))
    (tmp_path / "fed").mkdir()
    for i, f in enumerate(files):
        f.rename(tmp_path / "fed" / f"{i}.parquet")
    import os
    import time

    for i in range(len(files)):
        os.utime(tmp_path / "fed" / f"{i}.parquet", (time.time() + i, time.time() + i))
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "fed"))
    q = keyed.stream(src, "loda_ema", NAMES).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["event_id"]: round(r["raw"], 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["event_id"]: round(r["raw"], 9) for r in keyed.score(e, "loda_ema", NAMES).collect()}
    assert got == want


def test_checkpoint_goes_on(spark, sf):
    e = features.extract(env(spark, sf), NAMES)
    half = e.agg(F.expr("max(seq) div 2")).first()[0]
    got = {r["event_id"]: r["raw"] for r in keyed.resume(e.where(F.col("seq") > half), keyed.train(e.where(F.col("seq") <= half), "knn", NAMES), NAMES).collect()}
    want = {r["event_id"]: r["raw"] for r in keyed.score(e, "knn", NAMES).where(F.col("seq") > half).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_marginals_against_plain_counts():
    """Surprisal and cumulative shares with decay: counts shrink before the new value is added."""
    r, names = random.Random(2), ["a_hash", "b_norm", "return_success"]
    m, seen = models.Marginals(names, 16, 1.0, 0.97, inflated=True), [[], [], []]
    scale = 1.0
    for _ in range(300):
        x = np.array([r.choice([0.1, 0.25, 0.9]), r.random(), float(r.random() < 0.3)])
        if seen[0]:
            u, s = m.cdf(x), m.surprisal(x)
            for j in range(3):
                total = sum(w for _, w in seen[j])
                size = 16.0 if j == 1 else max(2.0, len({k for k, _ in seen[j]}) + 1.0)
                upto, same = sum(w for k, w in seen[j] if k <= m.key(j, x[j])), sum(w for k, w in seen[j] if k == m.key(j, x[j]))
                assert abs(u[j] - min(max((upto + 1) / (total + size), 1e-12), 1 - 1e-12)) < 1e-9
                assert abs(s[j] - max(0.0, -math.log((same + 1) / (total + size)) - math.log(size))) < 1e-9
        scale *= 0.97
        for j in range(3):
            seen[j].append((m.key(j, x[j]), 1 / scale))
        m.learn(x)


def test_knn_in_blocks_equals_step_by_step():
    rng = np.random.default_rng(3)
    x = rng.random((900, 3))
    for metric in ("euclidean", "manhattan", "chebyshev"):
        a, b = models.make("knn", ["a", "b", "c"], memory=300, metric=metric), models.make("knn", ["a", "b", "c"], memory=300, metric=metric)
        want = [a.step(v) for v in x]
        got = [s for part in np.split(x, [1, 3, 4, 500]) for s in b.steps(part)]
        assert np.allclose(got, want, atol=1e-12) and (a.ring == b.ring).all()


def test_loda_and_clusters_keep_moving_averages():
    m = models.make("loda_ema", ["a", "b"], rate=0.1)
    y = m.w @ np.array([0.5, 0.25])
    m.step(np.array([0.5, 0.25]))
    assert np.allclose(m.mean, 0.1 * y) and np.allclose(m.var, 0.9 + 0.1 * y * y)
    c = models.make("latentcluster", ["a_norm"], rate=0.1)
    raws = [c.step(np.array([v])) for v in (0.2, 0.4, 0.9)]
    ema, var = raws[0], 0.0
    for r in raws[1:]:
        ema, var = 0.9 * ema + 0.1 * r, 0.9 * var + 0.1 * (r - ema) ** 2
    assert abs(c.ema - ema) < 1e-12 and abs(c.emvar - var) < 1e-12


@pytest.mark.parametrize("name", sorted(models.MODELS))
def test_state_is_plain_text(name):
    import json

    rng = np.random.default_rng(5)
    x = np.clip(rng.normal(0.5, 0.2, (160, 3)), 0, 1)
    m = models.make(name, ["a_hash", "b", "return_success"], **({"grace_map": 20, "grace_train": 60} if name == "kitnet" else {"window": 50} if name == "halfspacetrees" else {}))
    for v in x[:120]:
        m.step(v)
    again = models.restored(json.loads(json.dumps(models.plain(m))))
    assert [again.step(v) for v in x[120:]] == [m.step(v) for v in x[120:]]


def test_bad_rows_and_new_keys(spark):
    rows = [("g" if i % 2 else "h", f"e{i}", i, i, 0.1 * (i % 7), float("nan") if i == 9 else float("inf") if i == 11 else 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "event_group string, event_id string, ts_unix_nano long, seq long, a double, b double")
    got = {r["event_id"]: r for r in keyed.score(df, "zscore", ["a", "b"]).collect()}
    assert len(got) == 60 and got["e11"]["error"].startswith("scoring error") and got["e11"]["raw"] == 0 and got["e9"]["error"] is None and got["e13"]["error"] is None
    out = keyed.resume(df.where("seq >= 30"), keyed.train(df.where("event_group = 'g' and seq < 30"), "zscore", ["a", "b"]), ["a", "b"]).collect()
    assert {r["event_group"] for r in out} == {"g", "h"} and len(out) == 30
    s = keyed.sanity(df, "knn", ["a", "b"], top=2, k=1, eps=(0.1,)).collect()
    assert len(s) == 2 * 2 * 1 * 2 and keyed.top_features(keyed.explain(df, "knn", ["a", "b"], top=2), 1).count() == 4
    assert {r["weight"] for r in keyed.explain(df, "knn", ["a", "b"], top=1, scored=lambda m: lambda x: 0.0).collect()} == {0.0}


def test_knn_of_a_long_key_is_cut_into_blocks(spark):
    """Blocks with an overlap of memory and window score as one pass does, with rows that can't be scored in between."""
    rng = np.random.default_rng(4)
    rows = [("g" if i % 3 else "h", f"e{i}", i, i, float(a), float("nan") if i % 97 == 5 else float("inf") if i % 89 == 7 else float(b)) for i, (a, b) in enumerate(rng.random((1500, 2)))]
    df = spark.createDataFrame(rows, "event_group string, event_id string, ts_unix_nano long, seq long, a double, b double")
    got = {r["event_id"]: r for r in keyed.score(df, "knn", ["a", "b"], window=16, warmup=8, memory=20).collect()}
    assert len(got) == 1500
    for g in "gh":
        s = keyed.Scorer("knn", ["a", "b"], {"memory": 20}, 16, 8)
        want = s.run(df.where(F.col("event_group") == g).orderBy("seq").toPandas())
        for w in want.itertuples():
            r = got[w.event_id]
            assert abs(r["raw"] - w.raw) < 1e-12 and r["percentile"] == w.percentile and abs(r["scaled"] - w.scaled) < 1e-12 and r["error"] == w.error and r["event_group"] == g
@pytest.mark.parametrize("name, params", [("latentcluster", {}), ("loda_ema", {}), ("copulatree", {"interval": 7}), ("copulatree", {"decay": 0.97}), ("halfspacetrees", {"window": 50}), ("kitnet", {"grace_map": 60, "grace_train": 200}), ("zscore", {}), ("freq1d", {}), ("freq1d", {"decay": 0.97, "how": "soft_topk_mean"}), ("memstream", {"warmup": 40, "memory": 32})])
def test_rows_in_blocks_score_as_one_by_one(name, params):
    """A block of rows is learnt at once, not row by row: with the same scores, and the same state behind it."""
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.choice([0.0, 0.1, 0.25, 0.9], 900), np.clip(rng.normal(0.5, 0.2, 900), 0, 1), rng.random(900) < 0.2])
    a, b = (models.make(name, ["a_hash", "b", "return_success"], **params) for _ in "ab")
    assert type(b).steps is not models.Model.steps
    want = [a.step(v) for v in x]
    got = [s for part in np.split(x, [1, 2, 45, 46, 700]) for s in b.steps(part)]
    assert np.allclose(got, want, atol=1e-9) and a.n == b.n
    assert np.allclose(b.steps(x[:200]), [a.step(v) for v in x[:200]], atol=1e-9)


def test_sequence_model_against_plain_steps():
    """One array of parameters, moved in place from the first part that is not silent, gives what a plain Adam gives."""
    rng, m = np.random.default_rng(8), models.NextToken(["a", "b"], hidden=6, rate=0.05)
    p, dice, classes = {i: w.copy() for i, w in enumerate(m._views(m.p))}, np.random.default_rng(42), 0
    dice.bit_generator.state = m.rng.bit_generator.state
    for k in range(1500):
        x, target = rng.normal(size=2) * (1 if k < 700 else 0.01), k % 3
        if classes < (now := min(k + 1, 3)):
            w = np.vstack([np.hstack([p[2][:-1], dice.uniform(-1, 1, (6, now - classes)) / math.sqrt(6)]), np.concatenate([p[2][-1], np.zeros(now - classes)])])
            p[2], classes, adam = w, now, models.Adam(0.05)
        target = min(target, classes - 1)

        def forward(masks):
            hs = [np.append(x, 1.0)]
            for i in range(2):
                hs.append(np.append(np.maximum(0.0, hs[-1] @ p[i] * masks[i]), 1.0))
            e = np.exp(hs[-1] @ p[2] - (hs[-1] @ p[2]).max())
            return hs, e / e.sum()

        masks = (dice.random((2, 6)) >= 0.5) / 0.5
        hs, back = forward(masks)
        back[target] -= 1
        grads = {}
        for i in (2, 1, 0):
            grads[i] = np.outer(hs[i], back)
            back = (p[i][:-1] @ back) * (hs[i][:-1] > 0) * (masks[i - 1] if i else 1)
        adam(p, grads)
        assert abs(m.observe(x, target, classes) - (1 - forward(np.ones((2, 6)))[1][target])) < 1e-7
    assert all(np.allclose(v, p[i], atol=1e-6) for i, v in enumerate(m._views(m.p)))


def test_a_pipeline_scores_once(spark, sf):
    """Numbering the rows for the warm-up must not run the model again."""
    ran, e = spark.sparkContext.accumulator(0), env(spark, sf).withColumn("group_key", F.col("event_group"))

    def seen(batches):
        for pdf in batches:
            ran.add(len(pdf))
            yield pdf

    scores = keyed.score(features.extract(e, NAMES), "zscore", NAMES, "group_key")
    counted = scores.mapInPandas(seen, scores.schema)
    c = pipelines.Config(algorithm="zscore", features=tuple(NAMES), score_mode="scaled", warmup=20)
    assert pipelines._decided(counted, e, c).where("suppressed").count() == 60 and ran.value == e.count()


def test_vectors_of_many_tokens_equal_those_one_by_one():
    r = random.Random(5)
    actors, tokens = [r.choice("abc") for _ in range(3000)], [r.choice("uvwxyz" if i > 400 else "uv") for i in range(3000)]
    one, many = models.Word2Vec(), models.Word2Vec()
    want = [one.add(a, t).tolist() for a, t in zip(actors, tokens, strict=True)]
    assert many.adds(actors[:1111], tokens[:1111]) + many.adds(actors[1111:], tokens[1111:]) == want
    assert models.plain(one) == models.plain(many) and any(want[-1])


@pytest.mark.parametrize("n", [5, 50, 51, 400])
def test_a_rank_that_only_takes_scores_up_is_the_same(n):
    r = random.Random(2)
    x, a, b = [r.choice([r.random(), 0.5]) for _ in range(n)], models.RollingRank(50, 10), models.RollingRank(50, 10)
    for v in x:
        a.step(v)
    b.take(x[: n // 3])
    b.take(x[n // 3 :])
    assert (list(a.order), a.sorted) == (list(b.order), b.sorted)


def test_training_ranks_nothing_and_has_the_state_of_scoring(monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.random((700, 2)), columns=["a", "b"]).assign(event_id="e", seq=range(700))
    pdf.loc[90, "a"] = np.inf
    ran, learnt = (keyed.Scorer("memstream", ["a", "b"], {"memory": 64, "warmup": 64, "beta": 0.3}, 128, 32) for _ in range(2))
    ran.run(pdf)
    monkeypatch.setattr(models.RollingRank, "step", lambda *_: 1 / 0)
    for i in range(0, 700, 300):
        learnt.learn(pdf.iloc[i : i + 300])
    assert ran.state() == learnt.state() and ran.model.filled > 64
