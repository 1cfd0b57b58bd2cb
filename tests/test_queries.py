"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from packetloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    df = df.astype(object)[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


#: SQL cannot express these; they have tests of their own.
WITHOUT_SQL = {"flow_hashes"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - WITHOUT_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    answer = duck.execute(catalog.oracle_sql()[name])
    want = pd.DataFrame(answer.fetchall(), columns=[c[0] for c in answer.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalog.queries()) - WITHOUT_SQL == set(catalog.oracle_sql())
