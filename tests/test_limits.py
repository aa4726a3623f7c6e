"""Ratios that lie on a limit are judged by their value, not by the order in which their rows were added up."""

import itertools

import duckdb
import pytest

from boxloom.operators import tiers
from boxloom.plans import load_registry

#: Quantities of orders with a ratio of exactly 20 and exactly 10: neither above 2 nor below 1 after division by ten.
ON_TWO, ON_ONE = [40.0, 34.0, 42.0, 24.0], [22.0, 1.0, 31.0, 27.0, 31.0]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("limits"))
    rows = []
    for i, q in enumerate([*itertools.permutations(ON_TWO), *itertools.permutations(ON_ONE)]):
        rows += [(9 * i + 1, x, "N") for x in q]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_snr_gate_on_limits(spark, orders):
    bands = {r["band"]: r["n"] for r in load_registry()["snr_gate"].build(spark, orders).collect()}
    assert bands == {"marginal": 24 + 120}


def test_clean_filter_on_limits(spark, orders):
    assert tuple(load_registry()["clean_filter"].build(spark, orders).first()) == (144, 0)


def test_clean_filter_without_keys(spark, tmp_path):
    """Rows without a key are one more group, never clean, as in SQL."""
    rows = [(k, float(q), "N") for k in (None, 1, 9) for q in (40, 41)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    q = load_registry()["clean_filter"]
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert tuple(q.build(spark, str(tmp_path)).first()) == con.execute(q.oracle).fetchone() == (3, 1)


def test_spread_of_other_values(spark):
    rows = [(1, 0.5), (1, 1.0), (2, None), (3, 2e9), (3, 1e9), (4, float("nan")), (5, 3.0), (5, 3.0), (6, 7.0), (6, None)]
    got = {r["k"]: r for r in tiers.spread_of(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    assert got[1]["sd"] == 0.25 and got[1]["snr"] == 6.0 and got[3]["sd"] == 5e8
    assert got[2]["sd"] is None and got[2]["snr"] is None and got[2]["n"] == 1
    assert got[5]["sd"] == 0 and got[5]["snr"] == float("inf") and got[6]["sd"] == 0 and got[6]["n"] == 2
