"""Binary masks as run-length columns: sorted runs of set pixels, row by row, as ``array<struct<start, length>>``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = "array<struct<start:long,length:long>>"


def box_runs(x1: Column, y1: Column, x2: Column, y2: Column, width: Column | int) -> Column:
    """The pixels of a box with whole corners, right and lower ends exclusive; a run for each row, none without area."""
    w = width if isinstance(width, Column) else F.lit(width)
    x1, y1, x2, y2, w = (c.cast("long") for c in (x1, y1, x2, y2, w))
    rows = F.transform(F.sequence(y1, y2 - 1), lambda y: F.struct((y * w + x1).alias("start"), (x2 - x1).alias("length")))
    return F.when((x2 > x1) & (y2 > y1), rows).otherwise(F.array().cast(RUNS))


def area(runs: Column) -> Column:
    """Pixels set by at least one of the runs, which may overlap and be in any order."""
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, run: Column) -> Column:
        end = run["start"] + run["length"]
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], run["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.sort_array(runs), start, step)["n"]


def overlap(a: Column, b: Column) -> Column:
    """Pixels that two masks of one size have in common."""
    return area(a) + area(b) - area(F.concat(a, b))


def mask_iou(a: Column, b: Column) -> Column:
    """Common pixels over those of either mask; null if both are empty."""
    return F.try_divide(overlap(a, b), area(F.concat(a, b)))


def coverage(runs: Column, height: Column | int, width: Column | int) -> Column:
    """Percentage of an image's pixels that are set; null for an image without pixels."""
    h, w = (c if isinstance(c, Column) else F.lit(c) for c in (height, width))
    return F.try_divide(F.lit(100.0) * area(runs), (h.cast("long") * w.cast("long")))


def encode(mask: np.ndarray) -> list[tuple[int, int]]:
    """The runs of an array's pixels above 0."""
    flat = np.concatenate(([False], np.asarray(mask).reshape(-1) > 0, [False]))
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def decode(runs: list, height: int, width: int) -> np.ndarray:
    """The mask of runs."""
    out = np.zeros(height * width, bool)
    for start, length in runs:
        out[start : start + length] = True
    return out.reshape(height, width)
