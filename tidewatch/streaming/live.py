"""Running streams from outside: models taken out of a stream and put into another, and metrics while it runs.

``scores`` is ``keyed.stream`` as a stateful processor: a key's model is a value in the state store, and a stream can start
from models learnt elsewhere. ``models`` reads them out of a stream's checkpoint through the state data source, as a table
of the form that ``keyed.train`` gives; so table and stream hand models to each other in both directions.

``Counters`` are observed aggregates of each micro-batch, put together by a listener on the driver, a few numbers a
batch, and written as text in the exposition format.
"""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from tidewatch.operators.models import make
from tidewatch.operators.native import ORDER
from tidewatch.streaming.keyed import OUT, Scorer

_STATE = "config string, events long, state string"


class _Scoring(StatefulProcessor):
    def __init__(self, key: str, config: dict):
        self.key, self.config = key, config

    def init(self, handle) -> None:
        self.model = handle.getValueState("model", _STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.model.update((row["config"], int(row["events"]), row["state"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        config = json.dumps(self.config)
        if self.model.exists():
            config, _, state = tuple(self.model.get())
            s = Scorer.of(state)
        else:
            s = Scorer(**self.config)
        frame = pd.concat(list(rows))  # order needs all of the micro-batch's rows of the key
        out = s.run(frame.sort_values(list(ORDER), kind="stable"))
        out.insert(0, self.key, key[0])
        self.model.update((config, int(s.model.n), s.state()))
        yield out

    def close(self) -> None:
        pass


def scores(df: DataFrame, algorithm: str, features: list[str], key: str = "event_group", window: int = 2048, warmup: int = 128, start: DataFrame | None = None, **params) -> DataFrame:
    """Append raw, scaled, percentile and error to (key, event_id, seq) over a stream, in append mode. start: models to go on
    from (key, config, events, state), as ``keyed.train`` and ``models`` give them; they count in the stream's first
    batch only. Needs the state store of ``pending.configure``."""
    names = sorted(features)
    make(algorithm, names, **params)  # unknown names fail here, not in a task
    config = {"algorithm": algorithm, "names": names, "params": params, "window": window, "warmup": warmup}
    rows = df.select(key, "event_id", *ORDER, *names).groupBy(key)
    first = start.select(key, "config", "events", "state").groupBy(key) if start is not None else None
    return rows.transformWithStateInPandas(_Scoring(key, config), f"{key} string, {OUT}", "append", "none", initialState=first)


def models(spark: SparkSession, checkpoint: str, key: str = "event_group") -> DataFrame:
    """key, algorithm, config, events, state: the models of a stream of ``scores``, running or not, as of its last
    committed batch."""
    held = spark.read.format("statestore").option("stateVarName", "model").load(checkpoint)
    return held.select(F.col(f"key.{key}").alias(key), F.get_json_object("value.config", "$.algorithm").alias("algorithm"), "value.*")


class Counters(StreamingQueryListener):
    """Events, anomalies, errors and the last time of a stream, in all and by group. ``observe`` the stream's rows (with
    event_group, anomaly, reason, ts_unix_nano), add this listener, and read ``text`` or the file."""

    def __init__(self, groups: tuple[str, ...] = (), prefix: str = "tidewatch", path: str | None = None, name: str = "counters"):
        self.groups, self.prefix, self.path, self.name = groups, prefix, path, name
        self.lock, self.totals, self.last = threading.Lock(), {}, {}
        self.batches: set = set()

    def _sums(self, when: Column, i: str) -> list[Column]:
        flag = F.coalesce(F.col("anomaly"), F.lit(False))
        error = F.coalesce(F.col("reason").contains("error"), F.lit(False))
        return [F.count_if(when).alias(f"events{i}"), F.count_if(when & flag).alias(f"anomalies{i}"), F.count_if(when & error).alias(f"errors{i}"), F.max(F.when(when, F.col("ts_unix_nano"))).alias(f"last{i}")]

    def observe(self, df: DataFrame) -> DataFrame:
        sums = self._sums(F.lit(True), "")
        for i, g in enumerate(self.groups):
            sums += self._sums(F.coalesce(F.col("event_group") == g, F.lit(False)), f"_{i}")
        return df.observe(self.name, *sums)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        with self.lock:
            if (place := (str(event.progress.runId), event.progress.batchId)) in self.batches:  # a batch without data says nothing new
                return
            self.batches.add(place)
            for i, g in enumerate(("", *self.groups)):
                end = f"_{i - 1}" if i else ""
                for k in ("events", "anomalies", "errors"):
                    self.totals[k, g] = self.totals.get((k, g), 0) + (row[k + end] or 0)
                if row["last" + end] is not None:
                    self.last[g] = max(self.last.get(g, row["last" + end]), row["last" + end])
        if self.path:
            with open(self.path + ".tmp", "w", encoding="utf-8") as f:
                f.write(self.text())
            os.replace(self.path + ".tmp", self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def text(self) -> str:
        """Of the driver's own numbers: HELP and TYPE, then a series for all events and one a group."""
        about = {"events": "Events seen", "anomalies": "Events flagged as anomalous", "errors": "Events that could not be scored"}
        out = []
        with self.lock:
            for k, help_ in about.items():
                name = f"{self.prefix}_{k}_total"
                out += [f"# HELP {name} {help_}", f"# TYPE {name} counter", f"{name} {self.totals.get((k, ''), 0)}"]
                out += [f'{name}{{group="{_escaped(g)}"}} {self.totals.get((k, g), 0)}' for g in self.groups]
            name = f"{self.prefix}_last_event_seconds"
            out += [f"# HELP {name} Time of the latest event", f"# TYPE {name} gauge"]
            out += [f"{name}{f'{{group="{_escaped(g)}"}}' if g else ''} {ns / 1e9:.3f}" for g, ns in self.last.items()]
        return "\n".join(out) + "\n"


def _escaped(label: str) -> str:
    return label.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
