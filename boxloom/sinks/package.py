"""Self-contained packages of images and labels that are seen only when they are whole."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.operators.duplicates import checkpointed
from boxloom.sinks.writers import data_yaml
from boxloom.sources.annotations import label_boxes, label_texts
from boxloom.sources.trees import listing

COUNTS = ("n_listed", "n_positive", "n_images", "n_labels", "n_boxes", "n_wrong")
#: Faults that are named in an error.
EXAMPLES = 10


class PackageError(ValueError):
    """A package that was not published, with its faults by kind."""

    def __init__(self, faults: dict[str, int], examples: list[str]):
        super().__init__(f"not published: {faults}; {'; '.join(examples)}")
        self.faults = faults


def package_status(listed: DataFrame, images: DataFrame, labels: DataFrame, boxes: DataFrame, classes: int = 1) -> DataFrame:
    """``stem``, what was counted of it (``COUNTS``), and ``faults``, empty if it is as it should be.

    ``listed(stem, is_background)`` is what the package should hold; ``images(stem)`` and
    ``labels(stem)`` are its files, ``boxes(stem, cls, ok)`` its label lines. All four are added up
    in one shuffle. Faults: listed_twice, image_missing, label_missing, positive_but_empty, wrong_class (or
    a line that can't be read) and unlisted. A null background flag counts as none.
    """

    def part(df: DataFrame, **has: Column) -> DataFrame:
        return df.select("stem", *[has.get(k, F.lit(0)).cast("long").alias(k) for k in COUNTS])

    one = F.lit(1)
    wrong = F.when(F.col("ok") & F.col("cls").between(0, classes - 1), 0).otherwise(1)
    rows = part(listed, n_listed=one, n_positive=F.when(F.col("is_background"), 0).otherwise(1)).unionByName(part(images, n_images=one))
    rows = rows.unionByName(part(labels, n_labels=one)).unionByName(part(boxes, n_boxes=one, n_wrong=wrong))
    seen = rows.groupBy("stem").agg(*[F.sum(k).alias(k) for k in COUNTS])
    here = F.col("n_listed") > 0
    kinds = {
        "listed_twice": F.col("n_listed") > 1,
        "image_missing": here & (F.col("n_images") == 0),
        "label_missing": here & (F.col("n_labels") == 0),
        "positive_but_empty": (F.col("n_positive") > 0) & (F.col("n_boxes") == 0),
        "wrong_class": here & (F.col("n_wrong") > 0),
        "unlisted": ~here,
    }
    return seen.withColumn("faults", F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in kinds.items()])))


def package_totals(status: DataFrame) -> DataFrame:
    """One row: listed stems, their boxes, and those with each of the faults that keep a package back."""
    has = lambda kind: F.count_if(F.array_contains("faults", kind))
    here = F.col("n_listed") > 0
    return status.agg(
        F.count_if(here).alias("n_listed"),
        has("label_missing").alias("n_without_label"),
        has("positive_but_empty").alias("n_positive_but_empty"),
        F.coalesce(F.sum(F.when(here, F.col("n_boxes"))), F.lit(0)).alias("n_boxes"),
        has("unlisted").alias("n_unlisted"),
    )


def write_package(listed: DataFrame, labels: DataFrame, folder: str, names: list[str], expected: dict[str, int] | None = None) -> dict[str, int]:
    """Copy images and write labels by split into ``folder``, if all is as listed; images by split are returned.

    ``listed`` has stem, split, path of the image and is_background, ``labels`` has stem and text. Tasks write
    to a staging folder beside ``folder``; the files are then listed and read again, held against
    the list, and against ``expected`` images by split if given, and the whole is renamed once.
    With any fault a ``PackageError`` says which, and neither ``folder`` nor the staging folder is
    left. ``folder`` must not exist, and be seen by the driver and all tasks. A task that is
    run again writes the same files.
    """
    if os.path.exists(folder):
        raise FileExistsError(folder)
    spark = listed.sparkSession
    stage = os.path.join(os.path.dirname(os.path.abspath(folder)), f".{os.path.basename(folder)}-{uuid.uuid4().hex}")
    listed = checkpointed(listed.select("stem", "split", "path", "is_background"))
    texts = labels.select("stem", F.col("text").alias("label")).dropDuplicates(["stem", "label"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for stem, split, path, label in zip(b["stem"], b["split"], b["path"], b["label"], strict=True):
                image = re.sub("^file:/*", "/", path or "")
                for kind, name in (("images", os.path.basename(image)), ("labels", f"{stem}.txt")):
                    to = f"{stage}/{kind}/{split}"
                    os.makedirs(to, exist_ok=True)
                    half = f"{stage}/.{uuid.uuid4().hex}"
                    if kind == "images" and os.path.isfile(image):
                        shutil.copyfile(image, half)
                    elif kind == "labels" and label is not None:
                        Path(half).write_text(label)
                    else:
                        continue
                    os.replace(half, f"{to}/{name}")
            yield b[["stem"]]

    try:
        os.makedirs(f"{stage}/images")
        os.makedirs(f"{stage}/labels")
        listed.join(texts, "stem", "left").select("stem", "split", "path", "label").mapInPandas(run, "stem string").count()
        written, found = checkpointed(listing(spark, f"{stage}/images")), checkpointed(label_texts(spark, f"{stage}/labels", "*.txt"))
        status = package_status(listed, written, found, label_boxes(found), len(names)).where(F.size("faults") > 0)
        kinds = {r["kind"]: r["n"] for r in status.select(F.explode("faults").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).collect()}
        split = F.element_at(F.split("path", "/"), -2)
        counts = {r["split"]: r["n"] for r in written.groupBy(split.alias("split")).agg(F.count("*").alias("n")).collect()}
        if expected is not None and counts != expected:
            kinds["image_count"] = sum(abs(counts.get(k, 0) - expected.get(k, 0)) for k in {*counts, *expected})
        if kinds:
            raise PackageError(kinds, [f"{r['stem']}: {', '.join(r['faults'])}" for r in status.orderBy("stem").limit(EXAMPLES).collect()])
        Path(f"{stage}/data.yaml").write_text(data_yaml(names, ".", *(f"images/{x}" for x in ("train", "val", "test"))))
        os.rename(stage, folder)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return counts
