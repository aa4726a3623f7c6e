"""Hand-computed cases and comparisons with naive code."""

import random
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.functions import kernels as K
from boxloom.operators import duplicates as D
from boxloom.operators import matching as M
from boxloom.operators import metrics as X
from boxloom.operators import splits as S
from boxloom.operators import tiers as T

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*xs):
    return [F.lit(float(x)) for x in xs]


def test_geometry(spark):
    assert value(spark, G.iou(*lits(0, 0, 10, 10, 5, 5, 15, 15))) == pytest.approx(25 / 175)
    assert value(spark, G.iou(*lits(0, 0, 10, 10, 0, 0, 10, 5))) == 0.5
    assert value(spark, G.iou(*lits(0, 0, 10, 10, 10, 0, 20, 10))) == 0.0
    areas = spark.createDataFrame([(a,) for a in (1023.9, 1024.0, 9216.0, 9216.1, None)], "a double")
    assert [r[0] for r in areas.select(G.size_bucket("a")).collect()] == ["small", "medium", "medium", "large", None]
    k = G.clipped_corners(*lits(-10, 20, 50, 120, 100, 100))
    assert [value(spark, k[x]) for x in ("x0", "y0", "x1", "y1", "clipped", "degenerate")] == [0, 20, 50, 100, True, False]
    assert [round(value(spark, v), 6) for v in G.to_yolo(*[k[x] for x in ("x0", "y0", "x1", "y1")], *lits(100, 100)).values()] == [0.25, 0.6, 0.5, 0.8]
    out = G.clipped_corners(*lits(120, 0, 150, 50, 100, 100))
    assert value(spark, out["clipped"]) and value(spark, out["degenerate"])
    assert [value(spark, v) for v in G.clip_unit(*lits(1.2, 0.5, 0.6, 0.2)).values()] == [1.0, 0.5, 0.6, 0.2]
    e = G.expand_clip(*[F.lit(x) for x in (10, 10, 30, 50)], F.lit(100), F.lit(100))
    assert [value(spark, v) for v in e.values()] == [7, 4, 33, 56]
    assert [value(spark, G.calibrated(F.lit(x))) for x in (0.1229, 0.123)] == [False, True]


def test_tiers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (float("nan"),)], "v double")
    assert [r["tier"] for r in T.with_tiers(df, "v", T.tertile_cuts(df, "v")).collect()] == ["low", "low", "medium", "high", "", ""]
    bands = [value(spark, T.snr_band(F.lit(x))) for x in (2.0, 1.0, 0.99, 2.01, float("inf"))]
    assert bands == ["marginal", "marginal", "noise", "clean", None]
    flag = lambda m, r, i, fit=True: value(spark, T.measurement_flag(F.lit(m), F.lit(r), F.lit(fit), F.lit(i)))
    assert [flag(19, 500, 1.0), flag(20, 199, 1.0), flag(20, 200, 0.49), flag(20, 200, 0.5), flag(20, 200, 0.5, False)] == ["mask_fail", "ring_fail", "low_inlier", "", "ransac_fail"]
    assert [value(spark, T.is_clean(F.lit(x))) for x in ("2.1", "2", "nan?", None)] == [True, False, False, False]


def test_undefined_metrics(spark):
    row = X.with_ratios(spark.createDataFrame([(0, 0, 3)], "tp long, fp long, n_gt long")).first()
    assert (row["precision"], row["recall"], row["f1"]) == (None, 0.0, None)
    ev = spark.createDataFrame([(1, 0, 0.9, True), (1, 1, 0.8, False), (1, 2, 0.7, True)], "image_id long, pred_idx long, conf double, is_tp boolean").withColumn("k", F.lit(1))
    n = spark.createDataFrame([(1, 2), (2, 0)], "k int, n_gt long")
    got = {r["k"]: r["ap"] for r in X.average_precision(ev, n, ["k"]).collect()}
    assert got[1] == pytest.approx((51 + 50 * 2 / 3) / 101) and got[2] is None


def naive_match(gt, det):
    """Greedy matching of lists of (image, idx, box[, conf])."""

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0

    used, out = set(), {}
    for image, p, box, conf in sorted(det, key=lambda x: (-x[3], x[1])):
        free = [(-iou(g[2], box), g[1]) for g in gt if g[0] == image and (image, g[1]) not in used and iou(g[2], box) >= 0.5]
        if any(g[0] == image for g in gt):
            out[image, p] = min(free)[1] if free else None
            if free:
                used.add((image, min(free)[1]))
    return out


@SLOW
@given(st.integers(0, 10**6))
def test_match_is_greedy(spark, seed):
    rng = random.Random(seed)
    box = lambda: (float(x := rng.randint(0, 6)), float(y := rng.randint(0, 6)), float(x + rng.randint(4, 9)), float(y + rng.randint(4, 9)))
    gt = [(i, k, box()) for i in range(6) for k in range(rng.randint(0, 6))]
    det = [(i, k, box(), rng.randint(1, 4) / 4) for i in range(7) for k in range(rng.randint(0, 8))]
    flat = "x1 double, y1 double, x2 double, y2 double"
    g = spark.createDataFrame([(i, k, *b) for i, k, b in gt], f"image_id long, box_index long, {flat}")
    d = spark.createDataFrame([(i, k, *b, c) for i, k, b, c in det], f"image_id long, pred_idx long, {flat}, conf double")
    got = {(r["image_id"], r["pred_idx"]): r["gt_idx"] for r in M.greedy_match(g, g, d).collect()}
    assert got == naive_match(gt, det)
    # Matches at a higher threshold are these events above it.
    high = {(r["image_id"], r["pred_idx"]): r["gt_idx"] for r in M.greedy_match(g, g, d.where("conf >= 0.5")).collect()}
    assert high == {k: v for k, v in got.items() if k in high}


def test_match_edge_cases(spark):
    flat = "x1 double, y1 double, x2 double, y2 double"
    g = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 0.0, 10.0, 10.0)], f"image_id long, box_index long, {flat}")
    d = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (2, 0, 0.0, 0.0, 9.0, 9.0, 0.5), (2, 1, 0.0, 0.0, 9.0, 9.0, 0.5), (3, 0, 0.0, 0.0, 9.0, 9.0, 0.5)], f"image_id long, pred_idx long, {flat}, conf double")
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    got = sorted((r["image_id"], r["gt_idx"]) for r in M.greedy_match(images, g, d).fillna(-1).collect())
    assert got == [(1, 0), (2, -1), (2, -1)]


@SLOW
@given(st.integers(0, 10**6))
def test_hamming_clusters(spark, seed):
    rng = random.Random(seed)
    centers = [rng.getrandbits(64) for _ in range(5)]
    hashes = [rng.choice(centers) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(40)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = D.checkpointed(spark.createDataFrame(list(enumerate(signed)), "id long, hash long"))
    pairs = D.checkpointed(D.hamming_pairs(df))
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if (hashes[i] ^ hashes[j]).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    label = list(range(40))
    for _ in range(40):
        for i, j in want:
            label[i] = label[j] = min(label[i], label[j])
    assert {r["id"]: r["component"] for r in D.single_linkage(df, pairs).collect()} == dict(enumerate(label))
    kept, seed_of = [], {}
    for i in range(40):
        near = [((hashes[i] ^ hashes[k]).bit_count(), k) for k in kept if (k, i) in want]
        seed_of[i] = min(near)[1] if near else i
        kept += [] if near else [i]
    assert {r["id"] for r in D.greedy_keep(df, pairs).where("kept").collect()} == set(kept)
    assert {r["id"]: r["seed"] for r in D.seed_clusters(df, pairs).collect()} == seed_of


def test_tolerant_boxes(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate((0.5, 0.5000005, 0.5000012))], "k int, i int, cx double")
    assert [r["i"] for r in D.tolerant_boxes(df, ["k"], ["i"], ["cx"]).orderBy("i").collect()] == [0, 2]


def test_water_fill(spark):
    groups = spark.createDataFrame([(i, 0, 1) for i in range(9)], "unit long, stratum int, size long")
    placed = {r["unit"]: r["bucket"] for r in S.water_fill(groups, {"train": 0.7, "val": 0.15, "test": 0.15}, 1).collect()}
    order = [r["unit"] for r in groups.orderBy(S.seeded(1, F.col("unit"))).collect()]
    assert [placed[str(u)] for u in order] == ["train", "val", "test", "train", "train", "train", "train", "val", "test"]
    assert [S.background_limit(n) for n in (10, 3743)] == [4, 1604]
    assert S.coverage(groups, "unit").first()["n_twice"] == 0
    assert S.water_fill(groups.limit(0), {"a": 1.0}, 1).count() == 0


def test_depth_without_plane_and_everywhere():
    depth = np.full((120, 120), 40.0)
    depth[45:75, 45:75] = np.arange(900).reshape(30, 30) + 5000
    mask = np.zeros((120, 120), bool)
    mask[45:75, 45:75] = True
    got = K.measure(depth, mask, use_plane=False)
    assert got["flag"] == "" and got["dbs_scalar"] == np.percentile(depth[mask], 90)
    whole = np.where(mask, 0, depth)
    assert K.measure(whole, mask, use_plane=False)["flag"] == "mask_fail"
    y, x = np.mgrid[:120, :120]
    plane = 900 + 0.3 * x - 0.2 * y
    plane[mask] += 25
    assert K.measure(plane, mask, everywhere=True)["dbs_scalar"] == pytest.approx(25, abs=1e-6)
    assert K.road_pixels(mask, mask | True, True).sum() > K.road_pixels(mask, mask | True).sum()


def test_resize_averages_what_a_pixel_covers():
    stripes = np.tile([0.0, 255.0], (640, 320))
    assert np.abs(K.resize_gray(stripes) - 127.5).max() <= 2
    assert (K.resize_gray(np.full((50, 700), 9.0)) == 9).all()
    up = K.resize_gray(np.arange(16.0).reshape(4, 4) * 10)
    assert up.shape == (32, 32) and up[0, 0] == 0 and up[-1, -1] == 150


def test_water_fill_of_many_groups_takes_time_in_proportion(spark):
    def took(n):
        start = time.time()
        rows = S.water_fill(spark.range(n).selectExpr("id unit", "id % 3 stratum", "1 + id % 5 size"), {"a": 0.7, "b": 0.3}, 1).collect()
        assert len(rows) == n and 0.66 < sum(r["bucket"] == "a" for r in rows) / n < 0.74
        return time.time() - start

    took(1000)
    # Four times the groups; the square would be sixteen times the work.
    assert took(40_000) < 12 * took(10_000)
