"""Annotations are made and parsed once, also those without boxes."""

from boxloom.plans import load_registry
from boxloom.sources.annotations import voc_annotations, voc_boxes


def test_texts_are_made_once(spark):
    plan = load_registry()["voc_parse"].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join [" not in plan


def test_outer_boxes(spark):
    box = "<object><name> a </name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object>"
    texts = [("two", f"<annotation>{box}{box}</annotation>"), ("none", "<annotation></annotation>"), ("broken", f"<annotation>{box}<object>")]
    a = voc_annotations(spark.createDataFrame(texts, "stem string, text string"))
    got = sorted((r["stem"], r["box_index"], r["x1"]) for r in voc_boxes(a, outer=True).where("box_index is not null").collect())
    assert got == [("two", 0, 3.0), ("two", 1, 3.0)]
    assert {r["stem"] for r in voc_boxes(a, outer=True).where("box_index is null").collect()} == {"none", "broken"}
