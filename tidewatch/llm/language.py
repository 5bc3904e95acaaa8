"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text's subwords are its byte n-grams of 2 to 4 bytes, ASCII letters in lower case, hashed into ``BUCKETS``. Their
embeddings are averaged, and a linear softmax over the learned languages follows; both are trained together by
stochastic gradient descent in numpy. For prediction, embeddings and softmax weights fold into one table.

The model is fitted on a bounded sample of labelled rows: at most ``per_lang`` rows of each of at most
``max_langs`` languages (the most frequent, if there are more), and at most ``most`` rows in all, the first in order of
a hash of the id. Of rows with equal ids and languages, the one with the least text counts. The driver holds the
sample's subword shares sparsely, at most 6 bytes a bucket and row, and one batch of them densely.
A fifth of the sample is kept out of training and gives the temperature that calibrates scores, and the score below
which a prediction is rejected: half the way from chance, one divided by the number of languages, to the score that
all but ``reject_share`` of these rows reach. So a text of a learned language is kept, and one in letters that no
language has (whose score is about chance) goes. With one language only, nothing is told apart and nothing goes.

Null texts and texts without a letter get ``und`` with score 0, and are rejected. With no labelled row at all there is
no model to reject anything: every text gets ``und`` with score 0, and only texts without a letter are rejected. Equal
texts get equal predictions. Columns of the input that are named like an output raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import words
from tidewatch.llm.runtime import free_names, fresh, prepare

BITS = 13
BUCKETS = 1 << BITS
SIZES = (2, 3, 4)


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    least: float  # score below which a prediction is rejected


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of every n-gram of these bytes."""
    b = words._LOWER[data].astype(np.uint32)
    out = []
    for n in SIZES:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) + b[j : len(b) - n + 1 + j]
            h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def shares(data: np.ndarray) -> np.ndarray:
    ids = buckets(data)
    return np.bincount(ids, minlength=BUCKETS).astype(np.float32) / max(1, len(ids))


class Sparse(NamedTuple):
    """Rows of shares: row i has x[first[i]:first[i + 1]] at the buckets ``at``."""

    first: np.ndarray
    at: np.ndarray
    x: np.ndarray

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            part = slice(self.first[r], self.first[r + 1])
            out[i, self.at[part]] = self.x[part]
        return out


def train(x: Sparse, y: np.ndarray, rows: np.ndarray, langs: int, dim: int = 16, epochs: int = 15, rate: float = 20.0, batch: int = 32, steps: int = 900, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Embedding table times softmax weights, and bias, after so many epochs or steps over these rows, whichever is more."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (dim, langs)).astype(np.float32), np.zeros(langs, np.float32)
    epochs = max(epochs, -(-steps // max(1, len(rows) // batch)))
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // batch)):
            xb = x.dense(part)
            hidden = xb @ e
            p = softmax(hidden @ w + bias)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            dw, dh = hidden.T @ p, p @ w.T
            e -= step * (xb.T @ dh)
            w -= np.float32(0.05) * step * dw
            bias -= np.float32(0.005) * step * p.sum(0)
    return e @ w, bias


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 600, max_langs: int = 200, most: int = 12_000, reject_share: float = 0.001) -> Model:
    spark = labelled.sparkSession
    prepare(spark)
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null").where(F.col("t").rlike(r"\p{L}"))
    rows = rows.withColumn("k", F.coalesce("k", F.lit("")))
    found = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("k").alias("ids")).orderBy(F.desc("n"), "l").limit(max_langs).collect()
    langs = sorted(r["l"] for r in found)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    per_lang = min(per_lang, max(1, most // len(langs)))
    # of a language with many ids only those with a small hash are ranked: four times as many as are wanted, so
    # that the ranking has a bounded number of rows whatever the table
    chance = F.pmod(F.xxhash64("k", F.lit("chance")), F.lit(1 << 30)) / F.lit(1 << 30)
    bound = F.create_map(*[F.lit(v) for r in found for v in (r["l"], min(1.0, 4.0 * per_lang / r["ids"]) if r["ids"] > 4 * per_lang else 1.0)])
    few = rows.where(F.col("l").isin(langs)).where(chance <= F.try_element_at(bound, F.col("l")))
    w = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    ids = few.select("l", "k").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang).select("k", "l")
    sample = few.join(F.broadcast(ids), ["k", "l"]).groupBy("k", "l").agg(F.min("t").alias("t")).select("k", "t", "l")  # at most ``most`` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shares(np.frombuffer(t.encode(), np.uint8)) for t in batch.column(1).to_pylist()]
            at = [np.flatnonzero(v).astype(np.uint16) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([v[a].tobytes() for v, a in zip(x, at, strict=True)], pa.binary())], names=["k", "l", "at", "x"])

    got = sorted(sample.mapInArrow(run, "k string, l string, at binary, x binary").collect(), key=lambda r: (r["k"], r["l"]))
    y, n = np.array([langs.index(r["l"]) for r in got]), np.array([len(r["x"]) // 4 for r in got])
    x = Sparse(np.concatenate([[0], np.cumsum(n)]), np.frombuffer(b"".join(r["at"] for r in got), np.uint16), np.frombuffer(b"".join(r["x"] for r in got), np.float32))
    del got
    kept_out = np.flatnonzero(np.arange(len(y)) % 5 == 4)
    table, bias = train(x, y, np.setdiff1d(np.arange(len(y)), kept_out), len(langs))
    if not len(kept_out):
        return Model(langs, table, bias, 1.0, 0.0)
    z = np.concatenate([x.dense(part) @ table + bias for part in np.array_split(kept_out, -(-len(kept_out) // 64))])
    loss = {t: -np.log(softmax(z / t)[np.arange(len(z)), y[kept_out]] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    t = min(loss, key=loss.get)
    reached = float(np.quantile(softmax(z / t).max(1), reject_share))
    return Model(langs, table, bias, float(t), (1 / len(langs) + reached) / 2 if len(langs) > 1 else 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score", reject_out: str = "rejected") -> DataFrame:
    """Append the predicted language, its calibrated score, and whether it is rejected. The text alone is used."""
    spark = docs.sparkSession
    prepare(spark)
    free_names(docs, lang_out, score_out, reject_out)
    at = docs.columns.index(text)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    more = T.StructType().add(lang_out, "string", False).add(score_out, "double", False).add(reject_out, "boolean", False)
    schema = T.StructType([*docs.schema.fields, *more.fields])
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            has = np.asarray(batch.column(batch.num_columns - 1))
            data, off = words.text_bytes(batch.column(at))
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for i in np.flatnonzero(has) if model.langs else ():
                p = softmax((shares(data[off[i] : off[i + 1]]) @ model.table + model.bias)[None] / model.temperature)[0]
                lang[i], score[i] = model.langs[int(p.argmax())], min(1.0, float(p.max()))
            out = batch.columns[:-1] + [pa.array(lang), pa.array(score), pa.array((score < model.least) | ~has)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.withColumn(fresh(docs, "letters"), letters).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Rows that the queries keep out of learning: one in four, by the id's checksum."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
