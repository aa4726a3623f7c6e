"""Images with many boxes: joined by tile and matched by cluster, as if they were joined by image and folded."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import matching as M

FLAT = "x1 double, y1 double, x2 double, y2 double"


def box(rng, span):
    x, y, w, h = rng.uniform(-5, span), rng.uniform(-5, span), 2 ** rng.uniform(-3, 7), 2 ** rng.uniform(-3, 7)
    return (x, y, x + w, y + h)


def tables(spark, rng, images=3, n=90):
    gt, det = [], []
    for image in range(images):
        boxes = [box(rng, 150) for _ in range(n)] + [(1.0, 1.0, 1.0, 9.0), (0.0, 0.0, 8.0, 8.0), (8.0, 8.0, 16.0, 16.0), (0.0, 0.0, 8.0, 8.0)]
        gt += [(image, i, *b) for i, b in enumerate(boxes)]
        near = [tuple(v + rng.uniform(-1, 1) * rng.choice([0, 0.2, 2]) for v in b) for b in boxes if rng.random() < 0.8]
        det += [(image, i, *b, round(rng.random(), 1)) for i, b in enumerate(near)]
    return spark.createDataFrame(gt, f"image_id long, box_index long, {FLAT}"), spark.createDataFrame(det, f"image_id long, pred_idx long, {FLAT}, conf double")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("threshold,strict", [(0.5, False), (0.1, False), (0.9, True), (0.0, True), (1.0, False)])
def test_tiles_find_the_pairs_of_the_image(spark, threshold, strict):
    gt, det = tables(spark, random.Random(4))
    plain = M.candidate_pairs(gt, det, threshold, strict)
    tiled = M.candidate_pairs(gt, det, threshold, strict, crowded=gt.select("image_id").where("image_id > 0").distinct())
    assert rows(tiled) == rows(plain) and plain.count() > 2


@pytest.mark.parametrize("seed", range(3))
def test_clusters_match_as_the_fold(spark, seed):
    gt, det = tables(spark, random.Random(seed), images=2, n=60)
    images = gt.select("image_id").distinct()
    plain = M.greedy_match(images, gt, det, crowd=10**6)
    assert rows(M.greedy_match(images, gt, det, crowd=5)) == rows(plain)
    # Only one of the images is crowded.
    some = gt.where("image_id = 0 or box_index < 20"), det.where("image_id = 0 or pred_idx < 20")
    assert rows(M.greedy_match(images, *some, crowd=30)) == rows(M.greedy_match(images, *some, crowd=10**6))


def test_an_image_of_many_boxes_takes_rows_in_proportion(spark):
    n = 50_000
    at = lambda c, to: [c.alias(f"{to}x1"), (F.col("id") % 250 * 7.0).alias(f"{to}y1"), (c + 9).alias(f"{to}x2"), (F.col("id") % 250 * 7.0 + 9).alias(f"{to}y2")]
    x = F.floor(F.col("id") / 250) * 7.0
    gt = spark.range(n).select(F.lit(1).alias("image_id"), F.col("id").alias("box_index"), *at(x, ""))
    det = spark.range(n).select(F.lit(1).alias("image_id"), F.col("id").alias("pred_idx"), *at(x + 1, ""), (F.col("id") % 97 / 97).alias("conf"))
    g, d = M._sides(gt, det)
    tiles = lambda rows, p: M._tiles(rows, p, 2, False).unionByName(M._tiles(rows, p, 0, True)).groupBy("level", "tx", "ty").agg(F.count("*").alias(p))
    met = tiles(g, "g_").join(tiles(d, "d_"), ["level", "tx", "ty"]).agg(F.sum(F.col("g_") * F.col("d_"))).first()[0]
    assert met < 800 * n
    events = M.greedy_match(gt, gt, det)
    assert events.count() == n and events.where("is_tp and gt_idx = pred_idx").count() == n
