"""Trees of files, listed by executors a folder at a time."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions.text import stem, suffix
from boxloom.operators.duplicates import checkpointed

#: Tasks of a level at most, and entries that are handed on at once.
TASKS, BATCH = 4096, 10_000
#: Schemes that executors list through Arrow's file systems; others but ``file`` are left to Spark's driver.
ARROW = ("hdfs", "s3", "gs", "abfs")

Entry = tuple[str, int, bool]


def local_entries(folder: str) -> Iterator[Entry]:
    """``path, length, is a folder`` of what a folder holds; links to folders and to nothing are left out."""
    with os.scandir(re.sub("^file:/*", "/", folder)) as found:
        for e in found:
            if e.is_dir(follow_symlinks=False):
                yield f"file://{e.path}", 0, True
            elif e.is_file():
                yield f"file://{e.path}", e.stat().st_size, False


def arrow_entries(folder: str) -> Iterator[Entry]:
    """The same through the file system that the address names."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(folder)
    before = folder.removesuffix(inside)
    for e in system.get_file_info(fs.FileSelector(inside)):
        yield before + e.path, e.size or 0, e.type == fs.FileType.Directory


def _walked(spark: SparkSession, root) -> list[tuple[str, int]]:
    """Files below a folder of any store that Spark reads, by the driver."""
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen()))
    return out


def listing(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """``path, stem, ext, length`` of files below the folders, empty ones too, which Spark's file sources leave out.

    Executors list a level of the trees at a time, a folder a row; the driver sees how many folders
    there are. Checksum files are left out. Folders inside one another are listed once, no folders
    give no rows, a missing one is an error. Stores that neither the operating system nor Arrow opens
    are listed by the driver. Contents are not read.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    roots, driven = [], []
    for p in [path] if isinstance(path, str) else path:
        root = hadoop.Path(p)
        root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root)
        scheme = root.toUri().getScheme()
        if scheme == "file" or scheme in ARROW:
            roots.append(re.sub("^file:/*", "file:///", root.toString()).rstrip("/"))
        else:
            driven += [x for x in _walked(spark, root) if fnmatchcase(x[0].rsplit("/", 1)[-1], glob)]
    roots = sorted({r for r in roots if not any(r.startswith(f"{o}/") for o in roots)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[Entry] = []
        for batch in batches:
            for folder in batch["path"]:
                for entry in (local_entries if folder.startswith("file:") else arrow_entries)(folder):
                    name = entry[0].rsplit("/", 1)[-1]
                    if entry[2] or (fnmatchcase(name, glob) and not (name.startswith(".") and name.endswith(".crc"))):
                        rows.append(entry)
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=["path", "length", "folder"])
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["path", "length", "folder"])

    found = spark.createDataFrame(sorted(set(driven)), "path string, length long")
    folders, n = spark.createDataFrame([(r,) for r in roots], "path string"), len(roots)
    while n:
        level = checkpointed(folders.repartition(min(n, TASKS)).mapInPandas(run, "path string, length long, folder boolean"))
        found = found.unionByName(level.where("not folder").drop("folder"))
        folders = level.where("folder").select("path")
        n = folders.count()
    return found.select("path", stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("ext"), "length")
