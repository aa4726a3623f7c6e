"""Scenes of many parts are made and measured in several tasks, with the same numbers as one by one."""

import io

import numpy as np

from boxloom.functions import kernels as K
from boxloom.plans import kernels as P
from boxloom.plans import load_registry


def test_parts_are_spread(spark, tmp_path):
    spark.range(2500).selectExpr("id p_partkey", "cast(id % 50 as int) p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("depth_measurements", "depth_profile"):
        assert load_registry()[name].build(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    rows = P._scenes(spark, str(tmp_path)).where("stem in ('0', '1203')").collect()
    got = {r["stem"]: r for r in K.measure_depths(spark.createDataFrame(rows)).collect()}
    for r in rows:
        outline = np.array([[p["x"], p["y"]] for p in r["points"]])
        depth = np.load(io.BytesIO(r["depth"]))
        want = K.measure(depth, K.fill_polygon(outline, *depth.shape))
        assert {k: got[r["stem"]][k] for k in want} == want


def test_masks_of_neighbouring_rows(spark):
    """An outline or a size that differs from the row before gives its own mask."""
    depth = np.arange(80.0 * 60).reshape(80, 60) + 300
    square = lambda a, b: [{"x": a, "y": a}, {"x": b, "y": a}, {"x": b, "y": b}, {"x": a, "y": b}]
    rows = []
    for stem, d, points in (("a", depth, square(0.2, 0.4)), ("b", depth, square(0.2, 0.6)), ("c", depth[:40], square(0.2, 0.6)), ("d", depth[:40], square(0.2, 0.6))):
        out = io.BytesIO()
        np.save(out, d)
        rows.append((stem, out.getvalue(), points))
    df = spark.createDataFrame(rows, "stem string, depth binary, points array<struct<x:double,y:double>>").coalesce(1)
    got = {r["stem"]: r["dbs_scalar"] for r in K.measure_depths(df, use_plane=False).collect()}
    for stem, data, points in rows:
        d = np.load(io.BytesIO(data))
        assert got[stem] == K.measure(d, K.fill_polygon(np.array([[p["x"], p["y"]] for p in points]), *d.shape), use_plane=False)["dbs_scalar"]
