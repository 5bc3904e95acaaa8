"""Cases in which an operator once did less than its whole job."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import pii, queries, spotsigs, topk


def test_spotsigs_whatever_the_number_of_chains(spark):
    """Near copies keep their likeness where an edit moves the number of chains past 6."""
    body = " ".join(f"word{i} stone{i * i}" for i in range(60))
    head = "the red house of old stone "
    texts = [head + body + "".join(f" of many{i} more{i}" for i in range(n)) for n in (0, 3, 4, 10)]
    counts = [len(spotsigs._chains(t)) // len(spotsigs.CHAINS) for t in texts]  # anchors
    assert min(counts) < 6 <= max(counts)
    for a in texts:
        for b in texts:
            x, y = spotsigs.fingerprint(a), spotsigs.fingerprint(b)
            p, q = spotsigs.signatures(a), spotsigs.signatures(b)
            assert abs(spotsigs.likeness(x, y) - len(p & q) / len(p | q)) < 1e-9 and spotsigs.likeness(x, y) > 0.5
    docs = spark.createDataFrame([(9 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert all(r["near_next"] > 0.5 for r in spotsigs.against_next(docs).collect())
    assert spotsigs.similar(docs, 0.5).count() == 6


def test_spotsigs_hashes():
    for t in ("", "a", "abc", "abcd", "abcde", "日本", "𝔘𝔫𝔦", "abc\0d", "the the red fox of the hill", "y" * 50):
        assert len(spotsigs._hashes(t)) == len(spotsigs.signatures(t)) and len(spotsigs.fingerprint(t)) == 10 * len(spotsigs._hashes(t))


def test_topk_of_large_components(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.4, (120, 5))
    x[::7] *= 20_000.0
    x[::15] = rng.normal(0, 3e6, (8, 5))
    x[40] = 16384.0
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.OP10_SQL).fetchall()
    got = [tuple(r) for r in queries.op10_topk(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 6 * 20


def test_topk_beyond_64_bits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 3) * 10.0 ** rng.integers(-1, 12)]) for i in range(60)]
    rows += [(60, [1e308, -1.0, 2.0]), (61, [-1.7e308, 0.0, 1e300]), (62, [0.0, 0.0, 0.0]), (63, [1e200, 1e200, 1e200])]
    whole = {i: [math.floor(64 * c) if math.isfinite(64 * c) else 64 * int(c) for c in v] for i, v in rows}
    want = set()
    for q in range(0, 64, 4):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q)
        want |= {(q, k + 1, c, -s if -(2**63) <= -s < 2**63 else None) for k, (s, c) in enumerate(best)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.search(df, F.col("vec_id") % 4 == 0, k=63).collect()}
    assert got == want and any(r[3] is None for r in want)


def test_pii_candidates_whatever_else_is_in_the_text():
    for text, kind in (("call 5 5 5 1 2 3 4 5 6 7 now", "number"), ("(1 2 3) 4-5.6 7 8", "number"), ("joe at mail dotcom", "email_obfuscated"), ("JOE [AT] mail [DOT] com", "email_obfuscated")):
        alone = pii.candidates(text, [])
        assert [pii.MORE[c[1]] for c in alone] == [kind]
        far = text + " and" * 20 + " 12345678 and then ann at home dot net"
        assert [c[:3] for c in pii.candidates(far, []) if c[2] <= len(text)] == [c[:3] for c in alone]


def test_spotsigs_batches_are_single_texts():
    """Many texts at once have the signatures of each, whatever stands beside them."""
    r = np.random.default_rng(8)
    pick = lambda of, n: " ".join(r.choice(of, n))
    vocab = ["the", "of", "und", "la", "The", "fox", "hill", "x1", "naïve", "日本語の文章です長い長い", "y" * 17, "z" * 40, "--", "a-b", "house"]
    texts = [pick(vocab, int(r.integers(0, 60))) for _ in range(80)] + ["", " ", "!!", "the", "fox", "the of", "𝔘" * 30, "w" * 16]
    for t, h in zip(texts, spotsigs._signed(texts), strict=True):
        assert len(h) == len(spotsigs.signatures(t)) and (h == spotsigs._hashes(t)).all()
    for a in texts[::7]:
        for b in texts[::5]:
            p, q = spotsigs.signatures(a), spotsigs.signatures(b)
            assert abs(spotsigs._jaccard(spotsigs._hashes(a), spotsigs._hashes(b)) - (len(p & q) / len(p | q) if p | q else 1.0)) < 1e-12
    assert spotsigs.signatures("!!") != spotsigs.signatures("--") and spotsigs.likeness(spotsigs.fingerprint("!!"), spotsigs.fingerprint("--")) == 0


def test_spotsigs_of_edited_and_unrelated_texts(spark, sf):
    """Chains tell edited texts from other ones on the table itself."""
    got = spotsigs.against_next(queries.documents(spark, sf)).toPandas()
    long = got[got["n_chars"] > 300]
    assert long["near_edited"].median() > 0.35 and long["near_next"].median() < 0.02
    assert (long["near_edited"] > long["near_next"]).mean() > 0.9
