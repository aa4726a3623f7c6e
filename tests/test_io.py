"""Readers, writers, kernels, plug-ins and streaming on temporary folders."""

import io
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxloom import pipeline
from boxloom.functions import kernels as K
from boxloom.sinks import writers as W
from boxloom.sources import annotations as A
from boxloom.sources import images as I
from boxloom.streaming import matching as S

XML = """<annotation><size><width>100</width><height>100</height></size>
<object><name> D40 </name><bndbox><xmin>-10</xmin><ymin>20.5</ymin><xmax>50</xmax><ymax>120</ymax></bndbox></object>
<object><name></name><bndbox><xmin>x</xmin><ymin>1</ymin><xmax>2</xmax><ymax>3</ymax></bndbox></object></annotation>"""


def test_voc(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.xml").write_text(XML)
    (tmp_path / "two.xml").write_text("<annotation><size>")
    (tmp_path / "three.xml").write_text("<annotation><size><width>0</width><height>5</height></size></annotation>")
    (tmp_path / "four.xml").write_text(XML)
    a = A.voc_annotations(A.file_texts(spark, str(tmp_path), "*.xml"))
    status = A.annotation_status(a, spark.createDataFrame([("one",), ("three",), ("two",)], "stem string"))
    assert {r["stem"]: r["reason"] for r in status.collect()} == {"one": "kept", "two": "parse_error", "three": "skipped_size", "four": "xml_without_image"}
    b = A.voc_boxes(a.where("stem = 'one'")).orderBy("box_index").collect()
    assert [(r["name"], r["x0"], r["y0"]) for r in b] == [("D40", -10.0, 20.5), ("", None, 1.0)]


def test_labels_round_trip(spark, tmp_path):
    boxes = [("a", 0, 1, 0.1234565, 0.5, 5e-7, 0.25), ("a", 1, 0, 0.2, 0.3, 0.4, 0.5), ("b", 0, 2, 1.0, 1.0, 0.1, 0.1)]
    df = spark.createDataFrame(boxes, "stem string, box_index int, cls int, cx double, cy double, w double, h double")
    all_images = spark.createDataFrame([("a",), ("b",), ("empty",)], "stem string")
    assert W.write_label_files(W.label_text(df, all_images), str(tmp_path / "labels")) == 3
    assert (tmp_path / "labels" / "a.txt").read_text() == "1 0.123456 0.500000 0.000000 0.250000\n0 0.200000 0.300000 0.400000 0.500000"
    assert (tmp_path / "labels" / "empty.txt").read_text() == ""
    (tmp_path / "labels" / "odd.txt").write_text("\n1 2\n3.0 .1 .2 .3 .4 extra\n")
    got = A.label_boxes(A.file_texts(spark, str(tmp_path / "labels"), "*.txt")).orderBy("stem", "box_index").collect()
    assert [(r["stem"], r["box_index"], r["cls"], r["ok"]) for r in got] == [("a", 0, 1, True), ("a", 1, 0, True), ("b", 0, 2, True), ("odd", 0, 1, False), ("odd", 1, 3, True)]
    stems = {r["stem"] for r in A.listing(spark, str(tmp_path / "labels"), "*.txt").collect()}
    assert stems == {"a", "b", "empty", "odd"}


def test_polygons_and_sources(spark, tmp_path):
    for n, text in (("box", "0 .5 .5 .2 .2\n1 .1 .1 .1 .1"), ("seg", "0 .1 .1 .5 .1 .5 .3\n0 .1 .1")):
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.txt").write_text(text)
    registry = {n: {"path": str(tmp_path / n), "cls": 0, "kind": n} for n in ("box", "seg", "gone")}
    got = {r["source"]: (r["cx"], r["cy"], r["w"], r["h"]) for r in A.sources(spark, registry, lambda p: "gone" not in p).collect()}
    assert got["box"] == (0.5, 0.5, 0.2, 0.2) and got["seg"] == pytest.approx((0.3, 0.2, 0.4, 0.2))


def test_lists_maps_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("p/a.jpg", "s", "d", "val", 1, 0, 3), ("p/b.jpg", "s", None, "train", 0, 1, 4)], A.SPLIT)
    W.write_csv(df, str(tmp_path / "m"), ["filename"])
    assert [tuple(r) for r in A.manifest(spark, str(tmp_path / "m"), A.SPLIT).orderBy("filename").collect()] == [tuple(r) for r in df.orderBy("filename").collect()]
    W.write_lists(df, str(tmp_path / "lists"), value="filename")
    assert [tuple(r) for r in A.split_list(spark, str(tmp_path / "lists" / "split=val")).collect()] == [("p/a.jpg", "a")]
    W.map_json(df, "filename", "group_id").write.text(str(tmp_path / "map"))
    assert {r["key"]: r["value"] for r in A.id_map(spark, str(tmp_path / "map")).collect()} == {"p/a.jpg": 3, "p/b.jpg": 4}
    W.write_metadata(str(tmp_path / "meta.json"), seed=1337, cuts=[1.5, 2.5])
    assert A.metadata(spark, str(tmp_path / "meta.json"), "seed int, cuts array<double>").first()["cuts"] == [1.5, 2.5]
    assert W.read_names(W.data_yaml(["D00", "D40"], "/x")) == ["D00", "D40"] == W.read_names("nc: 2\nnames: ['D00', \"D40\"]")
    (tmp_path / "f.txt").write_text("x")
    W.write_zip(str(tmp_path / "z.zip"), {"pkg/a/f.txt": str(tmp_path / "f.txt")})
    assert W.zip_profile(str(tmp_path / "z.zip")) == {"pkg": 1} and W.unzip(str(tmp_path / "z.zip"), str(tmp_path / "u"), "pkg/") == ["a/f.txt"]
    assert W.markdown([{"a": 1, "b": 2}], ["a", "b"]).splitlines()[-1] == "| 1 | 2 |"


def test_tree_and_index(spark):
    files = spark.createDataFrame([("/r/x/1.PNG",), ("/r/x/1.jpg",), ("/r/y/2.bmp",), ("/r/n.txt",)], "path string").selectExpr("path")
    files = files.select("path", A.stem(F.col("path")).alias("stem"), A.suffix(F.col("path")).alias("ext"))
    assert {r["stem"]: r["ext"] for r in A.image_index(files).collect()} == {"1": ".jpg", "2": ".bmp"}
    assert {(r["dir"], r["ext"]): r["n"] for r in A.tree_counts(files, "/r").collect()} == {("x", ".png"): 1, ("x", ".jpg"): 1, ("y", ".bmp"): 1, ("", ".txt"): 1}
    assert files.select(A.class_of_directory(F.col("path")).alias("c")).orderBy("c").first()["c"] == "r"


def test_kernels(spark, tmp_path):
    square = K.fill_polygon(np.array([[0.2, 0.2], [0.6, 0.2], [0.6, 0.6], [0.2, 0.6]]), 100, 100)
    assert K.mask_box(square) == (20, 20, 61, 61) and square.sum() == 41 * 41 and K.mask_box(square & False) is None
    dot = np.zeros((41, 41), bool)
    dot[20, 20] = True
    disc = K.dilate(dot, 15)
    assert K.mask_box(disc) == (13, 13, 28, 28) and 140 <= disc.sum() <= 185
    y, x = np.mgrid[:200, :200]
    rng = np.random.default_rng(0)
    depth = 800 + 0.5 * x - 0.25 * y + rng.normal(0, 0.5, x.shape)
    mask = (x - 100) ** 2 + (y - 100) ** 2 < 400
    depth[mask] += 40
    m = K.measure(depth, mask)
    assert m["dbs_scalar"] == pytest.approx(40.5, abs=1.5) and m["road_std"] == pytest.approx(0.5, abs=0.2) and m["flag"] == ""
    (a, b, c), share = K.fit_plane(x.ravel(), y.ravel(), (2.0 * x + 3 * y + 5).ravel())
    assert (a, b, c, share) == (pytest.approx(2), pytest.approx(3), pytest.approx(5), 1.0)
    assert K.measure(depth, mask & (x < 81) & (y < 95))["flag"] == "mask_fail" and K.sign_of_change(depth, mask)[1] == "LARGER"
    assert K.clip_depth(np.array([0, 100, 500, 4000]))[1] == 2
    noise = rng.normal(0, 1, (32, 32))
    assert K.phash_bits(noise) == K.phash_bits(noise * 2) != K.phash_bits(noise[::-1]) and K.resize_gray(depth).shape == (32, 32)
    assert K.resize_gray(np.full((50, 70), 3.0)).max() == 3.0
    buffer = io.BytesIO()
    np.save(buffer, depth)
    (tmp_path / "d.npy").write_bytes(buffer.getvalue())
    d = I.depths(spark, str(tmp_path)).withColumn("points", F.expr("array(struct(0.4D as x, 0.4D as y), struct(0.6D as x, 0.4D as y), struct(0.6D as x, 0.6D as y), struct(0.4D as x, 0.6D as y))"))
    r = K.measure_depths(d).first()
    assert r["stem"] == "d" and r["dbs_scalar"] > 30
    assert K.depth_profile(d).first()["valid_pct"] == 100.0
    assert I.content_hashes(spark, str(tmp_path)).first()["stem"] == "d"


def test_plug_in_scorer(spark):
    images = spark.createDataFrame([("a",), ("b",)], "image string")

    def load():
        return lambda b: pd.DataFrame([(i, k, 0, 10.0, 10.0, 30.0 + k, 50.0, 0.1 + k / 5) for i in b["image"] for k in range(2)], columns=["image", "pred_idx", "cls", "x1", "y1", "x2", "y2", "conf"])

    found = pipeline.detect(images, load)
    assert found.count() == 2
    sizes = spark.createDataFrame([("a", 100, 100), ("b", 40, 60)], "image string, width int, height int")
    rows = {r["image"]: r for r in pipeline.crops(found, sizes).collect()}
    assert [rows["a"][k] for k in ("cx1", "cy1", "cx2", "cy2")] == [7, 4, 34, 56] and not rows["a"]["calibrated"] and rows["b"]["calibrated"]


def test_stream(spark, tmp_path):
    box = "image_id long, {0} long, x1 double, y1 double, x2 double, y2 double"
    gt = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 0.0, 10.0, 8.0), (2, 0, 0.0, 0.0, 5.0, 5.0)], box.format("box_index"))
    det = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 9.0, 0.9), (1, 1, 0.0, 0.0, 10.0, 10.0, 0.8), (1, 2, 0.0, 0.0, 10.0, 10.0, 0.7), (9, 0, 0.0, 0.0, 5.0, 5.0, 0.9)], box.format("pred_idx") + ", conf double")
    det.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.detection_stream(spark, str(tmp_path / "in"), det.schema.simpleString()[7:-1].replace(":", " "))
    S.match_stream(stream, gt, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("pred_idx").collect()
    assert [(r["image_id"], r["is_tp"], r["gt_idx"]) for r in got] == [(1, True, 0), (1, True, 1), (1, False, None)]
    assert json.dumps([r["conf"] for r in got]) == "[0.9, 0.8, 0.7]"
