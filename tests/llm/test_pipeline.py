"""The pipeline's stages one by one on a small table, and the queries' SQL."""

import glob
import os

import corpus_pipeline as p
import duckdb

from tidewatch.llm import queries


def test_stages(spark, docs, sf):
    names = [n for n, _ in p.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "mixing", "bpe"]
    before = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        rows = after.collect()
        ids = {r["doc_id"] for r in rows}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()} and ids
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"]) for r in rows)
        if name == "near_duplicates":
            assert len(rows) == len(ids) <= before.count()
        if name == "mixing":
            assert ids == {r["doc_id"] for r in before.select("doc_id").collect()} and len(rows) >= len(ids)
        before = spark.createDataFrame(rows, docs.schema)
    last = p.STAGES[-1][1](spark, before, sf).collect()
    assert len(last) == before.count() and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in last)


def test_sql(spark, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda df: sorted(df[sorted(df.columns)].convert_dtypes().astype(str).itertuples(index=False, name=None))
        assert key(got) == key(want), name
