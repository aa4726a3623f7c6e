"""Trees listed by executors, and packages that are published whole or not at all."""

import os

import pytest

from boxloom.sinks import package as P
from boxloom.sources import annotations as A
from boxloom.sources import trees as T


def test_listing(spark, tmp_path):
    want = {}
    for folder in ("", "a", "a/b", "a/b/c d", "e+f", "empty"):
        (tmp_path / folder).mkdir(exist_ok=True)
        for i in range(0 if folder == "empty" else 30):
            f = tmp_path / folder / f"x {i}+.{'TXT' if i % 3 else 'txt'}"
            f.write_text("0 .5 .5 .1 .1" if i % 2 else "")
            want[f"file://{f}"] = 13 * (i % 2)
    (tmp_path / "a" / ".x.txt.crc").write_text("sum")
    os.symlink(tmp_path / "a", tmp_path / "loop")
    os.symlink(tmp_path / "nothing", tmp_path / "gone.txt")
    got = T.listing(spark, str(tmp_path)).collect()
    assert {r["path"]: r["length"] for r in got} == want and len(got) == len(want)
    assert {r["ext"] for r in got} == {".txt"} and {r["stem"] for r in got} == {f"x {i}+" for i in range(30)}
    twice = T.listing(spark, [str(tmp_path / "a"), str(tmp_path / "a" / "b"), f"file://{tmp_path}/a"], "*.txt").collect()
    assert sorted(r["path"] for r in twice) == sorted(p for p in want if f"{tmp_path}/a/" in p and p.endswith(".txt"))
    assert T.listing(spark, str(tmp_path / "empty")).count() == 0 and T.listing(spark, []).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        T.listing(spark, str(tmp_path / "nowhere")).count()
    here = sorted(T.local_entries(f"file://{tmp_path}/a/b"))
    assert [(p.removeprefix("file://"), n, d) for p, n, d in here] == sorted((p.removeprefix("file://"), n, d) for p, n, d in T.arrow_entries(f"file://{tmp_path}/a/b"))


def test_label_texts(spark, tmp_path):
    """An empty label file is a background row, and names with spaces and plus signs keep their stems."""
    for name, text in (("a b.txt", "0 .5 .5 .1 .1\n"), ("c+d.txt", ""), ("e%20f.txt", "1 .1 .1 .1 .1"), ("g.txt", "")):
        (tmp_path / name).write_text(text)
    texts = A.label_texts(spark, str(tmp_path))
    assert {r["stem"]: r["text"] for r in texts.collect()} == {"a b": "0 .5 .5 .1 .1\n", "c+d": "", "e%20f": "1 .1 .1 .1 .1", "g": ""}
    n = texts.select("stem").join(A.label_boxes(texts), "stem", "left").groupBy("stem").agg({"cls": "count"})
    assert dict(map(tuple, n.collect())) == {"a b": 1, "c+d": 0, "e%20f": 1, "g": 0}


def inputs(spark, folder, n=40):
    (folder / "in").mkdir()
    rows, labels = [], []
    for i in range(n):
        f = folder / "in" / f"i{i}.jpg"
        f.write_bytes(bytes([i]))
        rows.append((f"i{i}", ("train", "val", "test")[i % 3], str(f), i % 4 == 0))
        labels.append((f"i{i}", "" if i % 4 == 0 else "0 0.5 0.5 0.1 0.1\n0 0.2 0.2 0.1 0.1"))
    return rows, labels


def write(spark, rows, labels, to, **more):
    listed = spark.createDataFrame(rows, "stem string, split string, path string, is_background boolean")
    return P.write_package(listed, spark.createDataFrame(labels, "stem string, text string"), str(to), ["pothole"], **more)


def test_package(spark, tmp_path):
    rows, labels = inputs(spark, tmp_path)
    counts = {"train": 14, "val": 13, "test": 13}
    assert write(spark, rows, labels, tmp_path / "pkg", expected=counts) == counts
    for stem, split, path, _ in rows:
        assert (tmp_path / "pkg" / "images" / split / f"{stem}.jpg").read_bytes() == open(path, "rb").read()
        assert (tmp_path / "pkg" / "labels" / split / f"{stem}.txt").read_text() == dict(labels)[stem]
    assert "nc: 1" in (tmp_path / "pkg" / "data.yaml").read_text()
    with pytest.raises(FileExistsError):
        write(spark, rows, labels, tmp_path / "pkg")
    assert sorted(os.listdir(tmp_path)) == ["in", "pkg"]


def test_package_with_faults(spark, tmp_path):
    """Each fault keeps the package back, and nothing of it is left."""
    rows, labels = inputs(spark, tmp_path)
    bad = dict(labels) | {"i1": "", "i2": "3 .5 .5 .1 .1", "i3": "0 .5"}
    del bad["i5"], bad["i8"]
    gone = [(s, p, f if s != "i6" else str(tmp_path / "gone.jpg"), b) for s, p, f, b in rows] + [("i7", "test", rows[7][2], False)]
    with pytest.raises(P.PackageError) as e:
        write(spark, gone, list(bad.items()), tmp_path / "pkg")
    assert e.value.faults == {"positive_but_empty": 2, "wrong_class": 2, "label_missing": 2, "image_missing": 1, "listed_twice": 1}
    with pytest.raises(P.PackageError) as e:
        write(spark, rows, labels, tmp_path / "pkg", expected={"train": 14, "val": 13, "test": 12})
    assert e.value.faults == {"image_count": 1}
    assert os.listdir(tmp_path) == ["in"]
    here = spark.createDataFrame([("a",)], "stem string")
    empty = here.limit(0)
    boxes = empty.selectExpr("stem", "0 as cls", "true as ok")
    assert P.package_status(empty.selectExpr("stem", "true as is_background"), here, empty, boxes).first()["faults"] == ["unlisted"]
