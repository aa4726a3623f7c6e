"""Inference as a batch job: plug-in scorers over images, crops, tiers, and the summary of an image set."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import CALIBRATED, area_share, calibrated, expand_clip

DETECTIONS = "image string, pred_idx int, cls int, x1 double, y1 double, x2 double, y2 double, conf double"
TIERS = ("low", "medium", "high")


def score_batches(df: DataFrame, load: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply a scorer to Arrow-backed batches; ``load`` runs once in each Python worker's task, not once a row."""

    def run(batches: Iterator) -> Iterator:
        scorer = load()
        for batch in batches:
            yield scorer(batch)

    return df.mapInPandas(run, schema)


def detect(images: DataFrame, load: Callable[[], Callable], conf: float = 0.20) -> DataFrame:
    """Detections of a plug-in detector at or above a confidence."""
    return score_batches(images, load, DETECTIONS).where(F.col("conf") >= conf)


def crops(detections: DataFrame, sizes: DataFrame, margin: float = 0.15) -> DataFrame:
    """Add crop corners ``cx1 .. cy2``, ``share`` of the image and ``calibrated``; ``sizes`` has image, width, height."""
    j = detections.join(sizes, "image")
    k = expand_clip(*[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")], F.col("width").cast("int"), F.col("height").cast("int"), margin)
    whole = [F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")]
    share = area_share(*whole, F.col("width"), F.col("height"))
    return j.select("*", *[v.alias(f"c{n}") for n, v in k.items()], share.alias("share")).withColumn("calibrated", calibrated("share", CALIBRATED)).withColumn("crop", (F.col("cx2") > F.col("cx1")) & (F.col("cy2") > F.col("cy1")))


def display_category(tier: Column, is_calibrated: Column) -> Column:
    """What a box is shown as: its tier, or uncalibrated."""
    return F.when(is_calibrated, tier).otherwise("uncalibrated")


def box_label(name: Column, conf: Column, tier: Column, tier_conf: Column, is_calibrated: Column) -> Column:
    """What is written beside a box: the tier's confidence only where the tier is calibrated."""
    sure = F.format_string("%s %.2f | %s %.2f", name, conf, tier, tier_conf)
    return F.when(is_calibrated, sure).otherwise(F.format_string("%s %.2f | %s* uncal", name, conf, tier))


def summary(rows: DataFrame, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """``part, name, calibrated, n`` of rows (cls, tier, calibrated, crop): classes, then tiers by calibration, zero-filled."""
    by_class = rows.groupBy(F.col("cls").cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit("class").alias("part"), "name", F.lit(None).cast("boolean").alias("calibrated"), "n")
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, tiers))).alias("name"), F.array(F.lit(True), F.lit(False)).alias("c")).select("name", F.explode("c").alias("calibrated"))
    counts = rows.where("crop").groupBy(F.col("tier").alias("name"), "calibrated").agg(F.count("*").alias("n"))
    by_tier = grid.join(counts, ["name", "calibrated"], "left").select(F.lit("tier").alias("part"), "name", "calibrated", F.coalesce("n", F.lit(0)).alias("n"))
    return by_class.unionByName(by_tier)
