"""Runs a model over each key's events in order: the same function over a table and over a stream.

Over a table, rows are dealt by key and sorted within the task, and a key's model goes from one Arrow batch to the next,
so memory does not grow with a key's rows. Streaming keeps the model in the state store, so a key's model goes on where
the last micro-batch left it. Order within a key is (ts_unix_nano, seq) in both. State is JSON text, never code: what
a checkpoint holds is read by name into a fixed set of classes.

An event that can't be scored gets scores of 0 and the error's text, and the model goes on without it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators import scan
from tidewatch.operators.models import Model, RollingRank, attribution, make, plain, restored
from tidewatch.operators.native import ORDER

OUT = "event_id string, seq long, raw double, scaled double, percentile double, error string"


def learnt(model: Model, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(raw, error) of the next rows, which the model learns."""
    x = pdf[model.names].fillna(0.0).to_numpy(float)
    fine = np.isfinite(x).all(1)
    raws, errors = np.zeros(len(x)), np.where(fine, None, "scoring error: a feature is not a finite number").astype(object)
    if type(model).steps is not Model.steps:  # in blocks
        raws[fine] = model.steps(x[fine])
        return raws, errors
    for i in np.flatnonzero(fine):
        try:
            raws[i] = model.step(x[i])
        except Exception as e:  # whatever it is, the next event is scored
            errors[i] = f"scoring error: {e}"
    return raws, errors


class Scorer:
    """A model and its calibration, for one key."""

    def __init__(self, algorithm: str, names: list[str], params: dict, window: int, warmup: int):
        self.model: Model = make(algorithm, names, **params)
        self.rank = RollingRank(window, warmup)

    def run(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """Scores of the key's next rows, which come in order."""
        raws, errors = learnt(self.model, pdf)
        fine = np.array([e is None for e in errors], bool)
        ranks = [self.rank.step(r) if f else 0.0 for r, f in zip(raws.tolist(), fine, strict=True)]
        scaled = [self.model.scaled(r) if f else 0.0 for r, f in zip(raws.tolist(), fine, strict=True)]
        return pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "seq": pdf["seq"].to_numpy(), "raw": raws, "scaled": scaled, "percentile": ranks, "error": errors})

    def learn(self, pdf: pd.DataFrame) -> None:
        """``run``, where no scores are asked for."""
        raws, errors = learnt(self.model, pdf)
        self.rank.take(raws[np.array([e is None for e in errors], bool)].tolist())

    def state(self) -> str:
        return json.dumps({"model": plain(self.model), "rank": plain(self.rank)})

    @classmethod
    def of(cls, state: str) -> Scorer:
        out, held = object.__new__(cls), json.loads(state)
        out.model, out.rank = restored(held["model"]), restored(held["rank"])
        return out


def _selected(df: DataFrame, features: list[str], key: str) -> tuple[DataFrame, list[str]]:
    names = sorted(features)
    return df.select(key, "event_id", "ts_unix_nano", "seq", *names), names


def in_order(rows: DataFrame, key: str, schema: str, start: Callable[[object], object], step: Callable[[object, pd.DataFrame], pd.DataFrame | None], end: Callable[[object, object], pd.DataFrame | None] = lambda k, s: None) -> DataFrame:
    """Run ``step(state, rows)`` over each key's rows in order, part by part, from ``start(key)``; ``end(key, state)``
    may add rows behind the last part. A null key is a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key_of, begun = None, None, False
        for pdf in batches:
            if not len(pdf):
                continue
            named = pdf[key].where(pdf[key].notna(), None)
            new = np.flatnonzero(np.concatenate([[True], (named.to_numpy()[1:] != named.to_numpy()[:-1])]))
            for a, b in zip(new, [*new[1:], len(pdf)], strict=True):
                k = named.iloc[a]
                if not begun or k != key_of:
                    if begun and (last := end(key_of, held)) is not None:
                        yield last
                    held, key_of, begun = start(k), k, True
                if (out := step(held, pdf.iloc[a:b])) is not None:
                    yield out
        if begun and (last := end(key_of, held)) is not None:
            yield last

    # a number that is told, as plans that adapt would put small keys together in one task, one behind the other
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(many, key).sortWithinPartitions(key, *ORDER).mapInPandas(run, schema)


def _keyed(key: str, of: Callable[[object, pd.DataFrame], pd.DataFrame]) -> Callable[[object, pd.DataFrame], pd.DataFrame]:
    def step(state: object, pdf: pd.DataFrame) -> pd.DataFrame:
        out = of(state, pdf)
        out.insert(0, key, pdf[key].to_numpy()[: len(out)])
        return out

    return step


#: Own rows of a block for each row that is only there ahead of them.
OWN = 4


def score(df: DataFrame, algorithm: str, features: list[str], key: str = "event_group", window: int = 2048, warmup: int = 128, **params) -> DataFrame:
    """Append raw, scaled, percentile and error to (key, event_id, seq). One model a key; a model that looks back over a set number
    of rows is one for each block of a key's rows, so that a key is no one task's."""
    rows, names = _selected(df, features, key)
    model = make(algorithm, names, **params)  # unknown names fail here, not in a task
    start = lambda _: Scorer(algorithm, names, params, window, warmup)
    if model.horizon() is not None:
        return _in_blocks(rows, names, key, model.horizon(), max(window, warmup), start)
    return in_order(rows, key, f"{key} string, {OUT}", start, _keyed(key, lambda s, pdf: s.run(pdf)))


def _in_blocks(rows: DataFrame, names: list[str], key: str, horizon: int, window: int, start: Callable[[object], Scorer]) -> DataFrame:
    """Rows are numbered within their key (``scan``) and cut into blocks. Ahead of a block stand the last rows of the one before:
    ``horizon`` that only fill the model's memory, then ``window`` whose scores fill the calibration. Rows that can't be
    scored count in neither, so they are not numbered."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.abs(c) == float("inf"), F.lit(False)) for c in names])
    lost = rows.where(bad).select(key, "event_id", "seq", *[F.lit(0.0).alias(c) for c in ("raw", "scaled", "percentile")], F.lit("scoring error: a feature is not a finite number").alias("error"))
    ahead = horizon + window
    size = OWN * ahead
    at = F.col("at__") - 1
    fine = scan.numbered(rows.where(~bad), [key], ORDER, "at__").withColumns({"block__": F.floor(at / size), "left__": F.lit(size) - at % size})  # rows to the block's end
    again = fine.where(F.col("left__") <= ahead).withColumns({"block__": F.col("block__") + 1, "role__": F.when(F.col("left__") > window, 2).otherwise(1)})
    both = fine.withColumn("role__", F.lit(0)).unionByName(again).drop("at__", "left__")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, place = None, None
        for pdf in batches:
            here = list(zip(pdf[key].where(pdf[key].notna(), None), pdf["block__"], strict=True))
            new = [i for i in range(len(pdf)) if i == 0 or here[i] != here[i - 1]]
            for a, b in zip(new, [*new[1:], len(pdf)], strict=True):
                if held is None or here[a] != place:
                    held, place = start(here[a][0]), here[a]
                part = pdf.iloc[a:b]
                role = part["role__"].to_numpy()
                if (role == 2).any():
                    held.model.prime(part[names].fillna(0.0).to_numpy(float)[role == 2])
                if (role < 2).any():
                    part = part[role < 2]
                    out = held.run(part)
                    out.insert(0, key, part[key].to_numpy())
                    yield out[role[role < 2] == 0]

    schema = f"{key} string, {OUT}"
    scored = both.repartition(key, "block__").sortWithinPartitions(key, "block__", *ORDER).mapInPandas(run, schema)
    return scored.unionByName(lost.select(scored.columns))


def train(df: DataFrame, algorithm: str, features: list[str], key: str = "event_group", window: int = 2048, warmup: int = 128, **params) -> DataFrame:
    """A checkpoint: one row a key with the learnt state as JSON text, and the configuration to start further keys from."""
    rows, names = _selected(df, features, key)
    config = json.dumps({"algorithm": algorithm, "names": names, "params": params, "window": window, "warmup": warmup})

    def step(s: Scorer, pdf: pd.DataFrame) -> None:
        s.learn(pdf)

    def end(k: object, s: Scorer) -> pd.DataFrame:
        return pd.DataFrame({key: [k], "algorithm": [algorithm], "config": [config], "events": [s.model.n], "state": [s.state()]})

    return in_order(rows, key, f"{key} string, algorithm string, config string, events long, state string", lambda _: Scorer(algorithm, names, params, window, warmup), step, end)


def resume(df: DataFrame, checkpoint: DataFrame, features: list[str], key: str = "event_group") -> DataFrame:
    """Score and go on learning from a checkpoint; keys that it doesn't know start anew with its configuration. A key's
    state comes as a row ahead of its events, so that memory does not grow with them."""
    rows, _ = _selected(df, features, key)
    checkpoint = checkpoint.persist()  # a row a key; it is read twice, and may have to be learnt first
    first = checkpoint.select("config").first()
    if first is None:
        raise ValueError("the checkpoint is empty")
    fresh = json.loads(first["config"])

    def step(held: dict, pdf: pd.DataFrame) -> pd.DataFrame | None:
        if len(known := pdf[pdf["state__"].notna()]):
            held["scorer"] = Scorer.of(known["state__"].iloc[0])
            pdf = pdf[pdf["state__"].isna()]
        if not len(pdf):
            return None
        if "scorer" not in held:
            held["scorer"] = Scorer(**fresh)
        out = held["scorer"].run(pdf)
        out.insert(0, key, pdf[key].to_numpy())
        return out

    first_of_all = F.lit(-(1 << 63)).cast("long")
    states = checkpoint.select(key, F.col("state").alias("state__"), *[first_of_all.alias(c) for c in ORDER])
    both = rows.withColumn("state__", F.lit(None).cast("string")).unionByName(states, allowMissingColumns=True)
    return in_order(both, key, f"{key} string, {OUT}", lambda _: {}, step)


def stream(df: DataFrame, algorithm: str, features: list[str], key: str = "event_group", window: int = 2048, warmup: int = 128, **params) -> DataFrame:
    """The same over a stream, in append mode, with the model as the key's state."""
    rows, names = _selected(df, features, key)

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Scorer.of(state.get[0]) if state.exists else Scorer(algorithm, names, params, window, warmup)
        got = list(pdfs)  # order needs all of the micro-batch's rows of the key
        if got:
            out = s.run(pd.concat(got).sort_values(list(ORDER), kind="stable"))
            out.insert(0, key, k[0])
            state.update((s.state(),))
            yield out

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, {OUT}", "state string", "append", GroupStateTimeout.NoTimeout)


def sequence_scores(df: DataFrame, token: str, key: str, n: int = 4, vectors: dict | None = None, **params) -> DataFrame:
    """Next-token scores: the vectors of each actor's last n - 1 tokens, each as it was learnt when the token came,
    predict the next one. One model and one table of vectors (Word2Vec with the parameters ``vectors``) for all actors
    of a group, in the group's order; any number of different tokens."""
    from tidewatch.operators.models import NextToken, Word2Vec

    def start(_: object) -> tuple:
        table = Word2Vec(**(vectors or {}))
        return table, NextToken([str(i) for i in range(table.dim * (n - 1))], **params), {}, {}

    def step(state: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (table, model, ids, recent), raw = state, []
        for actor, t in zip(pdf["tid"], pdf[token], strict=True):
            t = t.strip().lower() if isinstance(t, str) else ""
            i, v = ids.setdefault(t, len(ids)), table.add(actor, t)
            q = recent.setdefault(actor, [])
            raw.append(model.observe(np.concatenate(q), i, len(ids)) if len(q) == n - 1 else 0.0)
            recent[actor] = (q + [v])[-(n - 1) :]
        return pd.DataFrame({key: pdf[key].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "seq": pdf["seq"].to_numpy(), "raw": raw})

    return in_order(df.select(key, "tid", "event_id", "ts_unix_nano", "seq", token), key, f"{key} string, event_id string, seq long, raw double", start, step)


def token_vectors(df: DataFrame, token: str, key: str, **vectors) -> DataFrame:
    """Append the Word2Vec vector of each event's token as learnt when it came (zeros while unknown). One table of vectors
    a group, sentences by actor."""
    from tidewatch.operators.models import Word2Vec

    def step(table: Word2Vec, pdf: pd.DataFrame) -> pd.DataFrame:
        got = table.adds(pdf["tid"].tolist(), [t.strip().lower() if isinstance(t, str) else "" for t in pdf[token]])
        return pd.DataFrame({key: pdf[key].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "vector": got})

    return in_order(df.select(key, "tid", "event_id", "ts_unix_nano", "seq", token), key, f"{key} string, event_id string, vector array<double>", lambda _: Word2Vec(**vectors), step)


def _replayed(df: DataFrame, algorithm: str, features: list[str], key: str, top: int, params: dict, schema: str, of: Callable) -> DataFrame:
    """``of(model, vector)`` for the ``top`` highest scores of each key, ties by time, against the model as it stood before
    each. A first pass finds them and keeps no others; the second learns again and stops at each."""
    rows, names = _selected(df, features, key)
    new = lambda: make(algorithm, names, **params)

    def find(state: dict, pdf: pd.DataFrame) -> None:
        part = pdf[["event_id", *ORDER]].assign(score=learnt(state["model"], pdf)[0])
        both = pd.concat([state["best"], part]) if "best" in state else part
        state["best"] = both.sort_values(["score", *ORDER], ascending=[False, True, True], kind="stable").head(top)

    new()  # unknown names fail here, not in a task
    asked = in_order(rows, key, "event_id string, seq long, asked boolean", lambda _: {"model": new()}, find, lambda _, s: s["best"][["event_id", "seq"]].assign(asked=True))
    rows = rows.join(F.broadcast(asked), ["event_id", "seq"], "left")  # ``top`` rows a key

    def step(model: Model, pdf: pd.DataFrame) -> pd.DataFrame:
        out, at = [], 0
        for i in np.flatnonzero(pdf["asked"].notna()):
            if i > at:
                learnt(model, pdf.iloc[at:i])
            out += [(pdf["event_id"].iloc[i], *r) for r in of(model, pdf[names].iloc[i].fillna(0.0).to_numpy(float))]
            at = i
        learnt(model, pdf.iloc[at:])
        out = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return in_order(rows, key, f"{key} string, {schema}", lambda _: new(), step)


def explain(df: DataFrame, algorithm: str, features: list[str], key: str = "event_group", top: int = 20, scored: Callable[[Model], Callable[[np.ndarray], float]] | None = None, **params) -> DataFrame:
    """Attributions of the ``top`` highest scores of each key. scored: what is explained in place of the raw score, as
    a function of the model that gives one of a vector."""
    names = sorted(features)
    return _replayed(df, algorithm, features, key, top, params, "event_id string, feature string, weight double", lambda m, x: zip(names, attribution(scored(m) if scored else m.score, x).tolist(), strict=True))


def sanity(df: DataFrame, algorithm: str, features: list[str], key: str = "event_group", top: int = 5, k: int = 3, eps: tuple[float, ...] = (0.01, 0.05, 0.1), **params) -> DataFrame:
    """How the raw, logarithmic and scaled scores of the ``top`` highest scores move with each of their k features of
    largest attribution: flipped (step 0) and by each of ``eps``, within 0 and 1."""
    names = sorted(features)

    def of(m: Model, x: np.ndarray) -> Iterator[tuple]:
        base = m.score(x)
        weights = attribution(m.score, x)
        for j in np.argsort(-np.abs(weights), kind="stable")[:k]:
            for e in (0.0, *eps):
                y = x.copy()
                y[j] = min(1.0, x[j] + e) if e else 1.0 - x[j]
                raw = m.score(y)
                yield names[j], float(weights[j]), float(e), raw - base, float(np.log1p(max(0.0, raw)) - np.log1p(max(0.0, base))), m.scaled(max(0.0, raw)) - m.scaled(max(0.0, base))

    return _replayed(df, algorithm, features, key, top, params, "event_id string, feature string, weight double, eps double, d_raw double, d_log double, d_scaled double", of)


def top_features(weights: DataFrame, k: int, key: str = "event_group") -> DataFrame:
    """Of each event the k features with the largest attribution in size, ties by name."""
    w = Window.partitionBy(key, "event_id").orderBy(F.desc(F.abs("weight")), "feature")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diagnose(checkpoint: DataFrame, key: str = "event_group") -> DataFrame:
    """key, metric, value: what the models of a checkpoint of ours hold: events, and their own counts and spreads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, state in zip(pdf[key], pdf["state"], strict=True):
                m = Scorer.of(state).model
                facts = {"events": m.n}
                facts |= {n: float(np.mean(getattr(m, n))) for n in ("mean", "var", "std", "ema") if getattr(m, n, None) is not None}
                facts |= {f"debug_{n}": float(v) for n, v in getattr(m, "debug", {}).items()} | ({"memory": m.filled} if hasattr(m, "filled") else {}) | ({"mass": float(m.hist.sum())} if hasattr(m, "hist") else {})
                out += [(k, n, float(v)) for n, v in facts.items()]
            yield pd.DataFrame(out, columns=[key, "metric", "value"])

    return checkpoint.select(key, "state").mapInPandas(run, f"{key} string, metric string, value double")
