"""Image and depth files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from boxloom.functions import png
from boxloom.functions.masks import RUNS, encode
from boxloom.functions.text import stem


def images(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Decoded 8-bit images. Deeper ones lose bits in this source: read depth with ``depths``."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)


def dimensions(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """``path, stem, width, height``."""
    i = images(spark, path, glob)
    return i.select(F.col("image.origin").alias("path"), stem(F.col("image.origin")).alias("stem"), "image.width", "image.height")


def masks(spark: SparkSession, path: str) -> DataFrame:
    """``path, n_set, n_values``: pixels above 0 in an image's first channel, and its distinct values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            planes = [np.frombuffer(d, np.uint8).reshape(h, w, c)[..., 0] for d, h, w, c in zip(b["data"], b["height"], b["width"], b["nChannels"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "n_set": [int((p > 0).sum()) for p in planes], "n_values": [len(np.unique(p)) for p in planes]})

    rows = images(spark, path).select(F.col("image.origin").alias("path"), *[f"image.{c}" for c in ("height", "width", "nChannels", "data")])
    return rows.mapInPandas(run, "path string, n_set long, n_values long")


def mask_runs(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """``path, stem, height, width, n_values, runs, error``: each mask image as runs of pixels above 0 in its first channel.

    8- and 16-bit PNG files, as saved. A file that can't be read keeps its row, with the reason
    in ``error`` and nulls for the rest.
    """

    def of(data: bytes) -> tuple:
        plane = png.decode(data)
        plane = plane if plane.ndim == 2 else plane[..., 0]
        return (*plane.shape, len(np.unique(plane)), encode(plane))

    return _decoded(spark, path, glob, of, f"height int, width int, n_values int, runs {RUNS}")


def depth_images(spark: SparkSession, path: str | list[str], glob: str = "*.png") -> DataFrame:
    """``path, stem, height, width, bits, depth, error``: unchanged depths of PNG files, little-endian, row by row.

    A file that can't be read keeps its row, with the reason in ``error`` and nulls for the rest.
    """

    def of(data: bytes) -> tuple:
        plane = png.decode(data)
        if plane.ndim != 2:
            raise ValueError("more than one channel")
        return (*plane.shape, 8 * plane.itemsize, plane.astype(plane.dtype.newbyteorder("<")).tobytes())

    return _decoded(spark, path, glob, of, "height int, width int, bits int, depth binary")


def depth_array(depth: bytes, height: int, width: int, bits: int) -> np.ndarray:
    """The depths of a row of ``depth_images``."""
    return np.frombuffer(depth, f"<u{bits // 8}").reshape(height, width)


def _decoded(spark: SparkSession, path: str | list[str], glob: str, of: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """Each file's row of what ``of`` makes of its bytes, decoded on the executors a file at a time."""
    paths = [path] if isinstance(path, str) else path
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths).select("path", "content")
    whole = f"path string, {schema}, error string"
    arrow = to_arrow_schema(StructType.fromDDL(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found = (*of(data.as_py()), None)
                except ValueError as e:
                    found = (*[None] * (len(arrow) - 2), str(e))
                values = [pa.array([v], f.type) for v, f in zip((name.as_py(), *found), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(values, schema=arrow)

    out = rows.mapInArrow(run, whole)
    return out.select("path", stem(F.col("path")).alias("stem"), *[c for c in out.columns if c != "path"])


def depths(spark: SparkSession, path: str | list[str], glob: str = "*.npy") -> DataFrame:
    """``stem, depth``: saved arrays as bytes, decoded where they are used."""
    paths = [path] if isinstance(path, str) else path
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    return rows.select(stem(F.col("path")).alias("stem"), F.col("content").alias("depth"))


def content_hashes(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """``path, stem, content``: md5 of each file's bytes."""
    paths = [path] if isinstance(path, str) else path
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    return rows.select("path", stem(F.col("path")).alias("stem"), F.md5("content").alias("content"))
