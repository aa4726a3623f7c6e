"""What the training-data operators share: reading tables, cutting lineage, ordering, test vocabulary."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Separators of white-space words, as a Java pattern.
GAP = r"[ \x09-\x0D]+"
#: White-space words, as a Java pattern.
WORD = r"[^ \x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage in the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; where none is configured, a temporary one
    on a single machine, and an error on a cluster. Checkpoint files survive the loss of executors, unlike local checkpoints, and
    Spark deletes them when the frame is no longer referenced and its cleaner is so configured.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="boxloom-"))
    return df.checkpoint()


#: Rows that Arrow carries to a Python worker at once, and the session's setting for that.
ROWS, ROWS_AT_ONCE = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def few_at_once(spark: SparkSession) -> Iterator[None]:
    """What is computed within sends whole texts to Python workers ``ROWS`` at a time.

    A batch is held by the executor and, twice, by its worker; the session's ten thousand rows of
    text are tens of megabytes in each. Batches only carry rows, so results do not depend on them.
    """
    was = spark.conf.get(ROWS_AT_ONCE)
    spark.conf.set(ROWS_AT_ONCE, min(ROWS, int(was)) if int(was) > 0 else ROWS)
    try:
        yield
    finally:
        spark.conf.set(ROWS_AT_ONCE, was)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that nothing refers to any more.

    It does so when the driver's JVM collects garbage, which a large heap may put off until long
    after a checkpoint has made the files useless. What Python and Spark's listeners let go
    reaches the collector a second or two later, so one collection is not enough.
    """
    for _ in range(4):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.6)


def pack(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the named columns: whatever else the input holds can't clash with the operator's own."""
    return df.select(*[c.alias(k) for k, c in columns.items()])


def ordered_rank(df: DataFrame, by: Column, to: str, parts: int = 32) -> DataFrame:
    """Add ``to``: the row's place from 0 in the order ``by``, without one task that sorts all rows.

    Rows are dealt by range, numbered within each range, and shifted by the sizes of the ranges
    before; the driver sees ``parts`` counts only. ``by`` must have no ties.
    """
    dealt = shared(df.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(sizes):
        before[part], at = at, at + sizes[part]
    offset = F.coalesce(*[F.when(F.col("_part") == p, F.lit(n)) for p, n in before.items()], F.lit(0)) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return dealt.withColumn(to, (place - 1 + offset).cast("long")).drop("_part")


