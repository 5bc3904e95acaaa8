"""Every query of the event tables beside its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from tidewatch.queries import oracle_sql, queries


def cells(df):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted([tuple(cell(x) for x in r) for r in df.itertuples(index=False)], key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal(spark, duck, sf, name):
    got, said = queries()[name](spark, sf).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(said.columns)
    assert cells(got) == cells(said)


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())
