"""Cases in which an operator once did less than its whole job."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions import features
from tidewatch.operators import models, native
from tidewatch.plans import pipelines
from tidewatch.sources.env import env
from tidewatch.streaming import keyed


def _events(spark, names):
    rows = [("g", str(i % 2), str(i), i, i, t) for i, t in enumerate(names)]
    return spark.createDataFrame(rows, "event_group string, tid string, event_id string, ts_unix_nano long, seq long, syscall_name string")


def test_sequences_of_many_tokens(spark):
    """Over 64 tokens: the scores are those of the model on the Word2Vec vectors, and no two tokens share a vector."""
    rng = np.random.default_rng(2)
    names = [f"Call{i}" for i in rng.integers(0, 150, 700)]
    got = {r["event_id"]: r["raw"] for r in keyed.sequence_scores(_events(spark, names), "syscall_name", "event_group", 3).collect()}
    table, mlp, ids, recent = models.Word2Vec(), models.NextToken([str(i) for i in range(10)]), {}, {"0": [], "1": []}
    for i, t in enumerate(x.lower() for x in names):
        q, v = recent[str(i % 2)], table.add(str(i % 2), t)
        k = ids.setdefault(t, len(ids))
        want = mlp.observe(np.concatenate(q[-2:]), k, len(ids)) if len(q) >= 2 else 0.0
        assert abs(got[str(i)] - want) < 1e-9
        q.append(v)
    assert len(ids) > 64 and len(np.unique(table.vec, axis=0)) == len(table.ids) > 64


def test_word2vec_learns_company():
    rng, table = np.random.default_rng(6), models.Word2Vec()
    for i in range(6000):
        kind = i // 50 % 2
        table.add("a", f"{'xy'[kind]}{rng.integers(0, 40)}")
    unit = table.vec / np.linalg.norm(table.vec, axis=1, keepdims=True)
    like, kinds = unit @ unit.T, np.array([t[0] for t in table.ids])
    same = kinds[:, None] == kinds[None, :]
    assert len(kinds) == 80 and np.isfinite(unit).all() and like[same].mean() > like[~same].mean() + 0.3


def test_fusion_is_of_sequences_and_zscores(spark, sf):
    names, events = ["arg1_norm", "path_hash"], env(spark, sf).limit(300).cache()
    got = pipelines.build(events, pipelines.Config(pipeline="las_gas_fusion", features=tuple(names), score_mode="scaled", warmup=20, ngram=4))
    keyed_events = events.withColumn("group_key", native.group_key(F.col("event_group")))
    z = keyed.score(features.extract(keyed_events, names), "zscore", names, "group_key").select("event_id", F.col("scaled").alias("z"))
    s = keyed.sequence_scores(keyed_events, "syscall_name", "group_key", 4).select("event_id", native.scaled(F.col("raw"), "exp1m").alias("s"))
    rows = got.join(z, "event_id").join(s, "event_id").collect()
    assert len(rows) == 300 and all(abs(r["scaled"] - 1 / (1 + math.exp(-(r["z"] + r["s"]) / 2))) < 1e-9 for r in rows)


def test_short_grams_are_kept(spark, sf):
    """A thread's first rows have the gram of what there is, and are not ready; none is without one."""
    from tidewatch.queries import queries

    rows = queries()["ngram"](spark, sf).collect()
    assert all(r["gram"] and r["ready"] == (r["gram"].count(",") == 3) for r in rows) and {r["gram"].count(",") for r in rows} == {0, 1, 2, 3}
