"""Named scoring pipelines: events in, decisions out. Builders are looked up by id and can be added."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import features
from tidewatch.operators import native, scan
from tidewatch.operators.models import MODELS
from tidewatch.streaming import keyed


@dataclass(frozen=True)
class Config:
    pipeline: str = "single_model"
    algorithm: str = "freq1d"
    features: tuple[str, ...] = features.SETS["default"]
    threshold: float = 0.9
    score_mode: str = "raw"
    warmup: int = 10_000
    percentile_window: int = 2048
    percentile_warmup: int = 128
    ngram: int = 8
    key: str = "group_key"
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.pipeline or self.pipeline == "legacy":
            raise ValueError("a pipeline needs an id other than 'legacy'")
        if self.algorithm not in MODELS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if self.score_mode not in ("raw", "scaled", "percentile"):
            raise ValueError(f"unknown score mode {self.score_mode!r}")
        if self.percentile_window < 32:
            raise ValueError("the percentile window must be at least 32")
        if self.ngram < 2:
            raise ValueError("an n-gram has at least 2 tokens")

    @classmethod
    def of(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if k == "features" else v for k, v in values.items() if k in known})

    def to_dict(self) -> dict:
        return asdict(self)


Builder = Callable[[DataFrame, Config], DataFrame]
_BUILDERS: dict[str, Builder] = {}


def register(name: str, builder: Builder) -> None:
    if not name or name == "legacy":
        raise ValueError("a pipeline needs an id other than 'legacy'")
    _BUILDERS[name] = builder


def build(events: DataFrame, config: Config) -> DataFrame:
    if config.pipeline not in _BUILDERS:
        raise ValueError(f"unknown pipeline {config.pipeline!r}")
    keyed_events = events.withColumn("group_key", native.group_key(F.col("event_group")))
    return _BUILDERS[config.pipeline](keyed_events, config)


def _decided(scores: DataFrame, events: DataFrame, c: Config) -> DataFrame:
    """Rows are numbered before they are scored: counting reads them several times, and a model should run once."""
    key = F.lit("all").alias("all") if c.key == "all" else F.col(c.key)
    order = scan.numbered(events.select("event_id", "seq", "ts_unix_nano", key), [c.key], native.ORDER, "row__").drop(c.key)
    return native.decide(scores.join(order, ["event_id", "seq"]), c.threshold, c.score_mode, c.warmup, c.key, row="row__")


def single_model(events: DataFrame, c: Config) -> DataFrame:
    df = features.extract(events, list(c.features))
    if c.key == "all":
        df = df.withColumn("all", F.lit("all"))
    return _decided(keyed.score(df, c.algorithm, list(c.features), c.key, c.percentile_window, c.percentile_warmup, **c.params), events, c)


def sequence_mlp(events: DataFrame, c: Config) -> DataFrame:
    s = keyed.sequence_scores(events, "syscall_name", c.key, c.ngram, **c.params)
    s = s.withColumn("scaled", native.scaled(F.col("raw"), "exp1m")).withColumn("percentile", F.lit(None).cast("double"))
    return _decided(s, events, c)


def las_gas_fusion(events: DataFrame, c: Config) -> DataFrame:
    """The sequence model and z-scores, fused with equal weights."""
    a = keyed.sequence_scores(events, "syscall_name", c.key, c.ngram).select("event_id", "seq", F.col("raw").alias("ra"))
    b = keyed.score(features.extract(events, list(c.features)), "zscore", list(c.features), c.key).select(c.key, "event_id", "seq", F.col("raw").alias("rb"))
    s = b.join(a, ["event_id", "seq"]).withColumn("sa", native.scaled(F.col("ra"), "exp1m")).withColumn("sb", native.scaled(F.col("rb"), "exp1m"))
    raw, scaled = native.fuse(["ra", "rb"], ["sa", "sb"], "linear")
    return _decided(s.select(c.key, "event_id", "seq", raw.alias("raw"), scaled.alias("scaled"), F.lit(None).cast("double").alias("percentile")), events, c)


for _name, _builder in (("single_model", single_model), ("sequence_mlp", sequence_mlp), ("las_gas_fusion", las_gas_fusion)):
    register(_name, _builder)


CELLS = ("tp", "fp", "fn", "tn")


def eval_matrix(events: DataFrame, labels: DataFrame, algorithms: list[str], thresholds: list[float], names: list[str], key: str = "event_group", params: dict[str, dict] | None = None) -> DataFrame:
    """algorithm, threshold, confusion counts, error and seconds. Each algorithm scores once: thresholds don't feed back.
    One that fails has its error in place of counts, and the others go on. They run side by side, as a key is one task's
    for most of them."""
    spark, df = events.sparkSession, features.extract(events, names)

    def one(a: str) -> list[tuple]:
        began, counts, error = time.time(), {}, None
        try:
            s = keyed.score(df, a, names, key, **(params or {}).get(a, {})).select("event_id", "scaled").join(labels, "event_id")
            over, yes = [F.col("scaled") >= t for t in thresholds], F.col("positive")
            cells = [F.coalesce(F.sum(c.cast("long")), F.lit(0)) for o in over for c in (o & yes, o & ~yes, ~o & yes, ~o & ~yes)]
            got = list(s.agg(*cells).first())  # four numbers a threshold
            counts = {t: got[4 * i : 4 * i + 4] for i, t in enumerate(thresholds)}
        except Exception as e:  # whatever it is, it is a result of the evaluation
            error = str(e).splitlines()[0]
        return [(a, float(t), *counts.get(t, [None] * 4), error, time.time() - began) for t in thresholds]

    with ThreadPoolExecutor(max(1, len(algorithms))) as pool:
        out = [row for rows in pool.map(one, algorithms) for row in rows]
    return spark.createDataFrame(out, "algorithm string, threshold double, " + ", ".join(f"{c} long" for c in CELLS) + ", error string, seconds double")
