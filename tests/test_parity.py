"""Every query with oracle SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from boxloom.plans import load_registry

SF = os.environ.get("PARITY_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(load_registry()))
def test_parity(spark, duck, name):
    q = load_registry()[name]
    df = q.build(spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if q.oracle:
        result = duck.execute(q.oracle)
        want = rows([c[0] for c in result.description], result.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        for g, w in zip(got[1], want[1], strict=True):
            assert g == w
