"""A stream matches an image as a batch does, however its detections are split over batches."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from boxloom.operators import matching as M
from boxloom.streaming import matching as S

FLAT = "x1 double, y1 double, x2 double, y2 double"
SCHEMA = f"image_id long, pred_idx long, {FLAT}, conf double, ts timestamp, n_det long"


def tables(spark, rng, images=12):
    gt, det, start = [], [], datetime(2024, 1, 1, tzinfo=timezone.utc)
    for image in range(images):
        for i in range(rng.randrange(1, 7)):
            x, y = rng.uniform(0, 20), rng.uniform(0, 20)
            gt.append((image, i, x, y, x + 10, y + 10))
        mine = [b for b in gt if b[0] == image]
        found = [tuple(v + rng.uniform(-2, 2) for v in rng.choice(mine)[2:]) for _ in range(rng.randrange(1, 9))]
        det += [(image, i, *b, round(rng.random(), 1), start + timedelta(seconds=10 * image + i), len(found)) for i, b in enumerate(found)]
    return gt, det


def events(spark, folder, gt, tmp_path, per_trigger=1):
    stream = S.detection_stream(spark, str(folder), SCHEMA, per_trigger)
    out, at = str(tmp_path / "out"), str(tmp_path / "state")
    query = S.match_images(stream, gt).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).fillna(-1, ["gt_idx"]).select("image_id", "pred_idx", "conf", "is_tp", "gt_idx").collect())


def batch(spark, gt, det):
    d = spark.createDataFrame(det, SCHEMA).drop("ts", "n_det")
    return sorted(tuple(r) for r in M.greedy_match(gt, gt, d).fillna(-1, ["gt_idx"]).select("image_id", "pred_idx", "conf", "is_tp", "gt_idx").collect())


def test_one_image_at_a_time_matches_as_the_batch(spark):
    rows, det = tables(spark, random.Random(1), images=30)
    gt = spark.createDataFrame(rows, f"image_id long, box_index long, {FLAT}")
    got = []
    for image in range(30):
        won = M.match_image([r[1:] for r in rows if r[0] == image], [(d[1], d[6], *d[2:6]) for d in det if d[0] == image])
        got += [(image, d[1], d[6], d[1] in won, won.get(d[1], -1)) for d in det if d[0] == image]
    assert sorted(got) == batch(spark, gt, det)
    assert M.match_image([], [(0, 0.5, 0, 0, 1, 1)]) == {} and M.match_image([(0, 0, 0, 1, 1)], []) == {}


@pytest.mark.parametrize("seed", [2, 3])
def test_any_split_gives_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, det = tables(spark, rng)
    gt = spark.createDataFrame(rows, f"image_id long, box_index long, {FLAT}")
    parts = [[] for _ in range(3)]
    for d in det:
        parts[rng.randrange(3)].append(d)
    parts[2] += rng.sample(det, 4) + [(999, 0, 0.0, 0.0, 5.0, 5.0, 0.9, det[0][7], 1)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    got = events(spark, tmp_path / "in" / "*", gt, tmp_path)
    assert got == batch(spark, gt, det)


def test_a_late_image_is_released_with_what_came(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    gt = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0), (2, 0, 0.0, 0.0, 9.0, 9.0)], f"image_id long, box_index long, {FLAT}")
    early = [(1, 0, 0.0, 0.0, 9.0, 9.0, 0.5, start, 3), (1, 1, 0.0, 0.0, 9.0, 8.0, 0.7, start, None)]
    for i, part in enumerate([early, [(2, 0, 0.0, 0.0, 9.0, 9.0, 0.9, start + timedelta(hours=k), 1)] if (k := 2) else [], [(2, 0, 0.0, 0.0, 9.0, 9.0, 0.9, start + timedelta(hours=3), 1)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    got = events(spark, tmp_path / "in" / "*", gt, tmp_path)
    assert got == [(1, 0, 0.5, False, -1), (1, 1, 0.7, True, 0), (2, 0, 0.9, True, 0)]
