"""Label texts, manifests, lists, maps, metadata and reports."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Row = dict


def label_text(boxes: DataFrame, images: DataFrame, key: str = "stem") -> DataFrame:
    """``key, boxes``: an image's boxes in order; images without any have an empty list."""
    rows = boxes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("box_index", "cls", "cx", "cy", "w", "h"))).alias("boxes"))
    kind = rows.schema["boxes"].dataType.simpleString()
    return images.select(key).distinct().join(rows, key, "left").select(key, F.coalesce("boxes", F.array().cast(kind)).alias("boxes"))


def format_boxes(boxes: list) -> str:
    """Label lines; six decimals are rounded from the exact binary value, which Spark's format_string does not do."""
    return "\n".join(f"{b['cls']} {b['cx']:.6f} {b['cy']:.6f} {b['w']:.6f} {b['h']:.6f}" for b in boxes)


def write_label_files(texts: DataFrame, folder: str, key: str = "stem") -> int:
    """One file for each image, empty ones too, from the tasks that hold them; ``folder`` must be seen by all of them.

    Each file is written whole under another name first, so a task that is run again leaves the same.
    """
    import os

    def run(batches: Iterator) -> Iterator:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, boxes in zip(b[key], b["boxes"], strict=True):
                half = f"{folder}/.{name}.{os.getpid()}"
                with open(half, "w") as f:
                    f.write(format_boxes(boxes))
                os.replace(half, f"{folder}/{name}.txt")
            yield b[[key]]

    return texts.mapInPandas(run, f"{key} string").count()


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, null: str = "") -> None:
    """A manifest with header; ordered ones are sorted by range over as many files as Spark finds fit."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, nullValue=null, emptyValue="")


def write_lists(df: DataFrame, path: str, split: str = "split", value: str = "path") -> None:
    """One folder of paths for each split, in order."""
    df.select(split, F.col(value).alias("value")).repartitionByRange(split, "value").sortWithinPartitions(split, "value").write.mode("overwrite").partitionBy(split).text(path)


def write_curves(curves: DataFrame, path: str, split: str = "split") -> None:
    """A folder of CSV for each split: ``conf, precision, recall`` by falling confidence.

    ``curves`` also has ``n``, the rank. Files are committed when all tasks are done, so a failed write leaves nothing to read.
    """
    rows = curves.select(split, "n", "conf", "precision", "recall").repartitionByRange(split, "n").sortWithinPartitions(split, "n").drop("n")
    rows.write.mode("overwrite").partitionBy(split).csv(path, header=True)


def write_crops(crops: DataFrame, path: str, manifest: str, by: tuple[str, ...] = ("split", "tier"), pixels: str | None = None) -> None:
    """Crops in a folder for each split and tier, and their manifest as CSV.

    Rows of a crop without pixels inside the image (``crop`` false) or without a tier are left out. With
    ``pixels``, a binary column, each folder's files hold stem and bytes; else stem and corners.
    """
    rows = crops.where(F.col("crop") & F.col(by[-1]).isNotNull())
    corners = [c for c in ("bx0", "by0", "bx1", "by1") if c in rows.columns]
    rows.select(*by, "stem", *([F.col(pixels)] if pixels else corners)).write.mode("overwrite").partitionBy(*by).parquet(path)
    write_csv(rows.drop("crop", *([pixels] if pixels else [])), manifest, order=[by[0], "stem"])


def map_json(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a JSON object of a small table, such as groups to folds."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value)))))
    return df.agg(F.to_json(entries).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metadata(path: str, **values: object) -> None:
    """Counts, seeds and cuts as JSON on the driver; no clock time, so that reruns are equal."""
    Path(path).write_text(json.dumps(values, indent=2, sort_keys=True))


def fixed(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", value)


def data_yaml(names: list[str], root: str, train: str = "train.txt", val: str = "val.txt", test: str | None = "test.txt") -> str:
    lines = [f"path: {root}", f"train: {train}", f"val: {val}"] + ([f"test: {test}"] if test else []) + [f"nc: {len(names)}", "names:"]
    return "\n".join([*lines, *(f"  {i}: {n}" for i, n in enumerate(names))]) + "\n"


def read_names(yaml: str) -> list[str]:
    """Class names of such a file: a list in brackets, or numbered lines below ``names:``."""
    lines = yaml.splitlines()
    for i, line in enumerate(lines):
        if line.startswith("names:"):
            if "[" in line:
                return [x.strip().strip("'\"") for x in line.split("[", 1)[1].rstrip().rstrip("]").split(",") if x.strip()]
            own = []
            for x in lines[i + 1 :]:
                if not x.startswith((" ", "-")) or not x.strip():
                    break
                own.append(x.split(":", 1)[-1].strip().lstrip("- ").strip("'\""))
            return own
    return []


def write_zip(path: str, files: dict[str, str]) -> int:
    """An archive of ``{name inside: local file}``; deflate level 6."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for inside, file in sorted(files.items()):
            z.write(file, inside)
    return len(files)


def unzip(path: str, folder: str, prefix: str = "") -> list[str]:
    """Members below a prefix, without it; names that would leave the folder are refused."""
    done = []
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            inside = name.removeprefix(prefix)
            if name.endswith("/") or not name.startswith(prefix):
                continue
            out = (Path(folder) / inside).resolve()
            if Path(folder).resolve() not in out.parents:
                raise ValueError(f"{name} would be written outside the folder")
            out.parent.mkdir(parents=True, exist_ok=True)
            out.write_bytes(z.read(name))
            done.append(inside)
    return done


def zip_profile(path: str) -> dict[str, int]:
    """Files by first folder."""
    counts: dict[str, int] = {}
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            if not name.endswith("/"):
                top = name.split("/", 1)[0]
                counts[top] = counts.get(top, 0) + 1
    return counts


def markdown(rows: list[Row], columns: list[str]) -> str:
    """A table for a report of a few rows."""
    line = lambda xs: "| " + " | ".join(map(str, xs)) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line([r[c] for c in columns]) for r in rows)])
