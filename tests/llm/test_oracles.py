"""Training-data queries with oracle SQL give DuckDB's rows."""

import duckdb
import pytest

from boxloom.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents benchmark labels pages".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_parity(spark, name, sf="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted(result.fetchall(), key=str)
    df = QUERIES[name](spark, sf)
    assert set(df.columns) == set(columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert len(got) == len(want) and got == [tuple(w) for w in want]
