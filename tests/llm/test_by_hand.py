"""Predictions of the language model recomputed in plain Python, and mixing of tables with columns of any name."""

import math

from pyspark.sql import functions as F

from tidewatch.llm import language, mixing


def hand_buckets(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):
            h = n
            for c in b[i : i + n]:
                h = (h * 0x01000193 + c) % 2**32
            h ^= h >> 15
            yield (h * 0x9E3779B1 % 2**32) >> (32 - language.BITS)


def test_language_predictions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    away = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~away))
    got = language.predict(docs.where(away).select("doc_id", "text"), model).collect()
    assert got
    for r in got:
        at = list(hand_buckets(r["text"] or ""))
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        z = [(sum(float(model.table[k][j]) for k in at) / max(1, len(at)) + float(model.bias[j])) / model.temperature for j in range(len(model.langs))]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(len(p)), key=p.__getitem__)
        assert r["lang_pred"] == model.langs[best] and abs(r["score"] - p[best] / sum(p)) < 1e-3
        assert r["rejected"] == (r["score"] < model.least)


def test_mixing_leaves_other_columns(spark):
    rows = [(1, "a b c", "x", 7, "k", 1), (1, "a b c", "x", 7, "k", 1), (2, "d", None, 8, "l", 2), (None, None, "x", 9, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h long, __key string, __tokens long")
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "n_tokens", "copies"]
    assert sorted(((r["doc_id"], r["h"], r["__key"], r["__tokens"], r["n_tokens"]) for r in got.collect()), key=str) == sorted([(1, 7, "k", 1, 3)] * 2 + [(2, 8, "l", 2, 1), (None, 9, None, 3, 1)], key=str)
