"""Repeated and null ids, words that fooled a weaker hash, languages that no one labelled, and the whole pipeline."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import language, line_dedup, ngram_join, topk, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_words_of_two_letters_in_turn(spark):
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    _, _, data, at = next(words.chunks(pa.array([x, y, x])))
    w = words.split(data, at)
    h = words.word_hashes(w)
    assert h[0] == h[2] != h[1]
    whole = words.run_hashes(words.mix(data.astype("u8")), at[:-1], at[1:])
    assert whole[0] == whole[2] != whole[1]
    docs = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.groups(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (None, b), (None, None), (2, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.groups(docs).collect()), key=str)
    assert got == sorted([(1, 36, 1), (1, 36, 1), (1, 36, 1), (None, 36, 1), (None, 0, None), (2, 0, 2)], key=str)
    out = line_dedup.dedup(docs).collect()
    assert len(out) == 6 and sum(r["n_lines_removed"] for r in out) == 1  # equal rows are one document; the null id comes last
    said = language.predict(docs, language.fit(docs.withColumn("lang", F.lit("en")))).collect()
    assert len(said) == 6 and {r["lang_pred"] for r in said} == {"en", "und"}


def test_topk_of_rows_with_one_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.25, 0.0]), (20, [1.0, 0.0]), (None, [9.0, 9.0]), (2, [])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    one = sorted((r["rank"], r["vec_id"], r["score"]) for r in got)
    assert one == sorted([(1, 20, 4096), (2, 20, 2048), (3, 1, 1024)] * 2 + [(1, 20, 2048), (2, 20, 2048), (3, 1, 512)])


def test_foreign_letters_go_and_known_languages_stay(spark):
    rows = [(i, ("the river and the house of stone " if i % 2 else "der Fluss und das Haus aus Stein ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    asked = spark.createDataFrame([(1, "the house and the river"), (2, "das Haus und der Fluss"), (3, "λόγος και ποταμός, οίκος"), (4, "123")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(asked, model).collect()}
    assert [got[i]["rejected"] for i in (1, 2, 3, 4)] == [False, False, True, True] and (got[1]["lang_pred"], got[2]["lang_pred"]) == ("en", "de")


def test_an_unlabelled_corpus_runs_through(spark, tmp_path):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a, None, "s", 1), (2, a + " more", None, None, 1), (3, "a line of some twenty letters\nanother one that stands alone", None, "t", 1), (4, "a line of some twenty letters\nand a third line here", None, "t", 1), (None, "no id but some words", None, "t", 1), (5, "123 !", None, "s", 1), (6, None, None, "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 3, 4, None} and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in got.values())


def test_mixing_and_its_sql_with_null_sources_and_ids(spark, tmp_path):
    import duckdb

    from tidewatch.llm import mixing, queries

    rows = [(None if i == 50 else i, f"w{i} " * (1 + i % 9), "en", [None, "big", "big", "big", "small"][i % 5], 1) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.sql(queries.OP4_SQL).fetchall(), key=str)
    got = sorted(map(tuple, queries.op4_mixing(spark, str(tmp_path)).collect()), key=str)
    assert len(got) == 150 and got == want
    assert mixing.realise(mixing.mix(df.limit(0))).collect() == []


def test_every_text_operator_on_repeated_rows_null_ids_and_a_long_text(spark):
    """Rows are told apart as rows: each gives its result, whatever ids and texts the others have; and a text longer
    than every chunk and leaf is taken whole."""
    from tokenizers import Tokenizer

    from tidewatch.llm import bpe, lexical, pii, queries, spotsigs, substring_dedup, token_counts

    long = " ".join(f"word{i % 977} x{i}" for i in range(260_000)) + " call +1 555 123 4567 end"
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, "a b"), (1, "a b"), (1, passage), (None, passage), (None, None), (None, "mail a@b.cc"), (2, ""), (3, long)]
    assert len(long) > words.CHUNK
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lib = Tokenizer.from_file(queries.vocabulary())
    n = sorted(len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert sorted(r["n_tokens"] for r in bpe.digests(df, queries.vocabulary()).collect()) == n
    lengths = token_counts.histogram(df, queries.vocabulary()).collect()
    assert sum(r[1] for r in lengths) == len(rows) and sum(r[0] * r[1] for r in lengths) == sum(n)
    out = substring_dedup.dedup(df).collect()
    assert sorted(r["n_removed"] for r in out) == [0] * 6 + [40, 40] and max(r["n_words"] for r in out) == len(long.split())
    said = pii.find(df, pii.train(df)).collect()
    assert len(said) == 8 and sum(r["n_email"] for r in said) == 1 and sum(r["n_phone"] for r in said) == 1
    prints = spotsigs.against_next(df).collect()
    assert sorted(r["n_chars"] for r in prints) == sorted(len(t or "") for _, t in rows) and max(len(r["fingerprint"]) for r in prints) > 10**6
    best = lexical.search(df, spark.createDataFrame([(9, "A b"), (9, "x259999 p39")], "item_id long, text string")).collect()
    want = [(1, 1), (2, 1), (3, None)] + [(1, 1), (2, None), (3, 3)]  # of "a b", "a b" and the address; of the passages and the long text
    assert sorted(((r["rank"], r["doc_id"]) for r in best), key=str) == sorted(want, key=str)
    groups = ngram_join.groups(df).collect()
    assert len(groups) == 8 and max(r["n_shingles"] for r in groups) == len(long.split()) - 4
