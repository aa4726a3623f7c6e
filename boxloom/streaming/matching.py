"""Detections as a stream: each image's detections are matched when the image is complete."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boxloom.operators.matching import CORNERS, greedy_match, match_image
from boxloom.operators.metrics import count_if


def detection_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """New Parquet files of detections; a file holds whole images."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def match_stream(stream: DataFrame, gt: DataFrame, out: str, checkpoint: str, threshold: float = 0.5) -> Callable:
    """Start a query that appends match events of each micro-batch to ``out``; a batch must hold whole images, see ``match_images``.

    A batch is written under its number, so one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = gt.join(batch.select("image_id").distinct(), "image_id", "left_semi")
        greedy_match(own, own, batch, threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_images(stream: DataFrame, gt: DataFrame, threshold: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """``image_id, pred_idx, conf, is_tp, gt_idx`` as a stream: an image's events when it is complete or late.

    ``stream`` has ``image_id, pred_idx, x1 .. y2, conf``, ``ts``, and ``n_det``, how many detections the image has
    (null: unknown). They may come in any batches and more than once: a state for each image holds them
    until all are there, or until the watermark has passed the last one by ``late``; then they are matched
    together, as a batch would. What comes again after that is ignored until then. Detections on unknown images are left out.
    """
    boxes = gt.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("box_index").cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in CORNERS]))).alias("b"))
    known = boxes.select("image_id", F.transform("b", lambda x: x["i"]).alias("gt_idx"), F.flatten(F.transform("b", lambda x: F.array(*[x[c] for c in CORNERS]))).alias("gt_at"))
    rows = stream.withWatermark("ts", late).join(known, "image_id")
    image = dict(stream.dtypes)["image_id"]
    wait = 1000 * int(stream.sparkSession.sql(f"select cast(timestamp'1970-01-01 00:00:00Z' + interval {late} as long)").first()[0])

    def released(key: tuple, seen: list, at: list, gt_idx: list, gt_at: list) -> pd.DataFrame:
        det = [(i, *at[5 * k : 5 * k + 5]) for k, i in enumerate(seen)]
        won = match_image([(i, *gt_at[4 * k : 4 * k + 4]) for k, i in enumerate(gt_idx)], det, threshold)
        events = [(key[0], d[0], d[1], d[0] in won, won.get(d[0])) for d in det]
        return pd.DataFrame(events, columns=["image_id", "pred_idx", "conf", "is_tp", "gt_idx"]).astype({"gt_idx": "Int64"})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen, at, gt_idx, gt_at, _, done, _ = state.get
            state.remove()
            if not done:
                yield released(key, seen, at, gt_idx, gt_at)
            return
        seen, at, gt_idx, gt_at, expected, done, last = state.get if state.exists else ([], [], [], [], None, False, 0)
        seen, at, gt_idx, gt_at = list(seen), list(at), list(gt_idx), list(gt_at)
        have = set(seen)
        for frame in frames:
            for r in frame.itertuples(index=False):
                gt_idx, gt_at = [int(v) for v in r.gt_idx], [float(v) for v in r.gt_at]
                expected = expected if pd.isna(r.n_det) else int(r.n_det)
                last = max(last, int(r.ts.timestamp() * 1000))
                if not done and r.pred_idx not in have:
                    have.add(r.pred_idx)
                    seen.append(int(r.pred_idx))
                    at += [float(r.conf), float(r.x1), float(r.y1), float(r.x2), float(r.y2)]
        if not done and expected is not None and len(seen) >= expected:
            yield released(key, seen, at, gt_idx, gt_at)
            # Only that it is done is kept, for as long as a row can still come.
            seen, at, gt_idx, gt_at, done = [], [], [], [], True
        state.update((seen, at, gt_idx, gt_at, expected, done, last))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    out = f"image_id {image}, pred_idx long, conf double, is_tp boolean, gt_idx long"
    held = "seen array<long>, at array<double>, gt_idx array<long>, gt_at array<double>, expected long, done boolean, last long"
    wanted = rows.select("image_id", "pred_idx", "conf", *CORNERS, "ts", "n_det", "gt_idx", "gt_at")
    return wanted.groupBy("image_id").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def confidence_windows(stream: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts of confident and other detections by window of event time, with a bound on lateness."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size)).agg(count_if(F.col("conf") >= 0.25).alias("n_confident"), F.count("*").alias("n"))
