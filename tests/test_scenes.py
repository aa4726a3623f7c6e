"""Depth queries give a row for every part."""

import pytest

from boxloom.plans import load_registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["depth_measurements", "depth_profile"])
def test_every_part(spark, name):
    parts = {str(r[0]) for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    rows = load_registry()[name].build(spark, SF).select("stem").collect()
    assert len(rows) == len(parts) and {r["stem"] for r in rows} == parts
