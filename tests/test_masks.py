"""Run-length masks and deep images, against arrays."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom import pipeline
from boxloom.functions import masks as K
from boxloom.functions import png
from boxloom.operators import metrics as X
from boxloom.sinks import writers as W
from boxloom.sources import images as I


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def as_png(array, filters, colour=None):
    """A PNG of ``array`` with the given filter for each row."""
    rows = array.reshape(*array.shape[:2], -1)
    height, width, channels = rows.shape
    step = channels * array.itemsize
    data = rows.astype(rows.dtype.newbyteorder(">")).tobytes()
    line, out, above = width * step, b"", bytes(width * step)
    for y in range(height):
        own, kind = data[y * line : (y + 1) * line], filters[y % len(filters)]
        left = bytes(step) + own[:-step]
        corner = bytes(step) + above[:-step]
        guess = {0: lambda a, b, c: 0, 1: lambda a, b, c: a, 2: lambda a, b, c: b, 3: lambda a, b, c: (a + b) // 2, 4: paeth}[kind]
        out += bytes([kind]) + bytes((v - guess(a, b, c)) & 255 for v, a, b, c in zip(own, left, above, corner))
        above = own
    packed = zlib.compress(out)
    head = struct.pack(">IIBBBBB", width, height, 8 * array.itemsize, {1: 0, 2: 4, 3: 2, 4: 6}[channels] if colour is None else colour, 0, 0, 0)
    return png.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"k\0v") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("dtype,channels", [(np.uint8, 1), (np.uint16, 1), (np.uint8, 3), (np.uint16, 4), (np.uint8, 2)])
def test_png_round_trip(dtype, channels):
    rng = np.random.default_rng(3)
    array = rng.integers(0, np.iinfo(dtype).max, (13, 9, channels), dtype)
    array = array[..., 0] if channels == 1 else array
    for filters in ([0], [1], [2], [3], [4], [0, 1, 2, 3, 4], [4, 3, 2, 1]):
        got = png.decode(as_png(array, filters))
        assert got.dtype == dtype and (got == array).all()


def test_png_refused():
    good = as_png(np.arange(12, dtype=np.uint16).reshape(3, 4), [0])
    broken = bytearray(good)
    broken[-20] ^= 1
    for bad in (b"", b"no image", good[:40], bytes(broken), as_png(np.zeros((2, 2), np.uint8), [9 % 5], colour=3)):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_depth_images_keep_16_bits_and_report_what_is_unreadable(spark, tmp_path):
    depth = (np.arange(600, dtype=np.uint16) * 101).reshape(20, 30)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.png").write_bytes(as_png(depth, [1, 4]))
    (tmp_path / "two.png").write_bytes(b"junk")
    (tmp_path / "three.png").write_bytes(as_png(np.zeros((2, 2, 3), np.uint8), [0]))
    got = {r["stem"]: r for r in I.depth_images(spark, str(tmp_path)).collect()}
    one = got["one"]
    assert (one["height"], one["width"], one["bits"], one["error"]) == (20, 30, 16, None)
    assert (I.depth_array(one["depth"], 20, 30, 16) == depth).all()
    assert got["two"]["depth"] is None and got["two"]["error"] and got["three"]["error"] == "more than one channel"


def test_mask_images_as_runs(spark, tmp_path):
    mask = (np.random.default_rng(1).random((17, 23)) < 0.4).astype(np.uint8) * 255
    (tmp_path / "m.png").write_bytes(as_png(mask, [2, 1]))
    (tmp_path / "none.png").write_bytes(as_png(np.zeros((4, 5), np.uint16), [0]))
    rows = I.mask_runs(spark, str(tmp_path)).withColumn("covered", K.coverage(F.col("runs"), F.col("height"), F.col("width")))
    got = {r["stem"]: r for r in rows.collect()}
    assert (K.decode(got["m"]["runs"], 17, 23) == (mask > 0)).all()
    assert got["m"]["covered"] == pytest.approx(100 * (mask > 0).mean()) and got["m"]["n_values"] == 2
    assert (got["none"]["covered"], got["none"]["runs"], got["none"]["n_values"]) == (0.0, [], 1)


def test_run_expressions(spark):
    rng = random.Random(7)
    boxes, want = [], []
    for i in range(60):
        two = [(x := rng.randrange(12), y := rng.randrange(9), x + rng.randrange(6), y + rng.randrange(5)) for _ in range(2)]
        arrays = []
        for x1, y1, x2, y2 in two:
            m = np.zeros((16, 20), bool)
            m[y1:y2, x1:x2] = True
            arrays.append(m)
        boxes.append((i, *two[0], *two[1]))
        both, either = (arrays[0] & arrays[1]).sum(), (arrays[0] | arrays[1]).sum()
        want.append((int(both), int(either), both / either if either else None, 100 * either / 320))
    df = spark.createDataFrame(boxes, "id int, " + ", ".join(f"{p}{c} int" for p in "ab" for c in ("x1", "y1", "x2", "y2")))
    a, b = (K.box_runs(*[F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")], 20) for p in "ab")
    df = df.select("id", a.alias("a"), b.alias("b"))
    rows = df.select("id", K.overlap(F.col("a"), F.col("b")), K.area(F.concat("a", "b")), K.mask_iou(F.col("a"), F.col("b")), K.coverage(F.concat("a", "b"), 16, 20)).collect()
    for r in rows:
        assert tuple(r)[1:3] == want[r["id"]][:2]
        assert tuple(r)[3:] == pytest.approx(want[r["id"]][2:])


def test_scores_of_labels_that_occur(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, g string")
    m = X.confusion(df, "t", "g", ["a", "b", "c"])
    assert {r["label"] for r in X.class_scores(X.present(m)).collect()} == {"a", "b"}
    assert X.class_scores(X.present(m.where("n < 0"))).count() == 0


def test_box_label(spark):
    df = spark.createDataFrame([("pothole", 0.456, "low", 0.9, True), ("pothole", 0.2, "high", 0.8, False)], "n string, c double, t string, k double, ok boolean")
    got = [r[0] for r in df.select(pipeline.box_label(*[F.col(x) for x in "nctk"], F.col("ok"))).collect()]
    assert got == ["pothole 0.46 | low 0.90", "pothole 0.20 | high* uncal"]


def test_curve_and_crop_sinks(spark, tmp_path):
    curves = spark.createDataFrame([("val", 2, 0.5, 0.5, 0.25), ("val", 1, 0.9, 1.0, 0.25), ("test", 1, 0.8, 0.0, 0.0)], "split string, n int, conf double, precision double, recall double")
    W.write_curves(curves, f"{tmp_path}/curves")
    back = spark.read.csv(f"{tmp_path}/curves", header=True, inferSchema=True)
    assert sorted(tuple(r) for r in back.select("split", "conf", "precision", "recall").collect()) == [("test", 0.8, 0.0, 0.0), ("val", 0.5, 0.5, 0.25), ("val", 0.9, 1.0, 0.25)]
    crops = spark.createDataFrame([("a", "train", "low", 1, 2, 9, 9, b"xy", True), ("b", "val", None, 1, 2, 9, 9, b"z", True), ("c", "val", "high", 1, 1, 1, 1, b"", False), ("d", "val", "high", 0, 0, 5, 5, b"dd", True)], "stem string, split string, tier string, bx0 int, by0 int, bx1 int, by1 int, bytes binary, crop boolean")
    W.write_crops(crops, f"{tmp_path}/crops", f"{tmp_path}/crops_csv", pixels="bytes")
    back = spark.read.parquet(f"{tmp_path}/crops")
    assert sorted((r["split"], r["tier"], r["stem"], bytes(r["bytes"])) for r in back.collect()) == [("train", "low", "a", b"xy"), ("val", "high", "d", b"dd")]
    assert [r["stem"] for r in spark.read.csv(f"{tmp_path}/crops_csv", header=True).orderBy("stem").collect()] == ["a", "d"]
    # A task that fails leaves nothing to read.
    fails = F.when(F.col("n") > 1, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("conf"))
    with pytest.raises(Exception, match="stop"):
        W.write_curves(curves.withColumn("conf", fails), f"{tmp_path}/failed")
    assert not list((tmp_path / "failed").glob("split=*")) if (tmp_path / "failed").exists() else True
