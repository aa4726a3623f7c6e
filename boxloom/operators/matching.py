"""Matching detections to ground truth, one to one and independently."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import box_iou
from boxloom.operators.duplicates import checkpointed, single_linkage

CORNERS = ("x1", "y1", "x2", "y2")


#: Boxes of an image, of either side, above which it is crowded: its boxes meet by tiles, not by image.
CROWD = 64
#: Pairs that a task holds before it matches the clusters that are whole.
HELD = 1 << 16


def crowded_images(gt: DataFrame, det: DataFrame | None = None, crowd: int = CROWD) -> DataFrame:
    """``image_id`` of images with more than ``crowd`` boxes on a side; boxes are counted where they lie.

    Any images may be joined by tile, so ``gt`` alone, or rows that its boxes are only a part of, may
    stand for both if they are known to be as many and are cheaper to count.
    """
    both = gt.select("image_id", F.lit(1).alias("g"))
    both = both if det is None else both.unionByName(det.select("image_id", F.lit(0).alias("g")))
    n = both.groupBy("image_id").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
    return n.where(F.greatest(F.col("g"), F.col("n") - F.col("g")) > crowd).select("image_id")


def _sides(gt: DataFrame, det: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = gt.select("image_id", F.col("box_index").alias("gt_idx"), *[F.col(c).alias(f"g_{c}") for c in CORNERS])
    d = det.select("image_id", "pred_idx", "conf", *[F.col(c).alias(f"d_{c}") for c in CORNERS])
    return g, d


def _level(p: str) -> Column:
    """The power of two of the smallest tile at least as wide and as high as a box."""
    side = F.greatest(F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1"))
    return F.ceil(F.log2(side)).cast("int")


def _tiles(boxes: DataFrame, p: str, up: int | Column, own: bool) -> DataFrame:
    """``boxes`` once for each tile they touch: at their own level, or at the next ``up`` levels above it.

    A box is no larger than a tile of its level, so it touches four at most.
    """
    rows = boxes.withColumn("own", _level(p))
    levels = F.array("own") if own else F.when(F.lit(up) > 0, F.sequence(F.col("own") + 1, F.col("own") + up))
    rows = rows.withColumn("level", F.explode(levels)).withColumn("pitch", F.pow(F.lit(2.0), F.col("level")))
    at = lambda c: F.floor(F.col(f"{p}{c}") / F.col("pitch"))
    rows = rows.withColumn("tx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("ty", F.explode(F.sequence(at("y1"), at("y2"))))
    return rows.drop("own")


def tile_pairs(g: DataFrame, d: DataFrame, reach: float) -> DataFrame:
    """Boxes ``g_*`` and ``d_*`` of one image that overlap, each pair once, by an equi-join on image and tile.

    A pair meets on the tiles of the larger one's level: that one is there by its own size, the smaller
    one as it is put on the tiles of higher levels too. Overlap by a share of ``reach`` bounds how much
    smaller it can be, and so the levels; 0 takes those of the image. Of the tiles that both touch, the
    one with the upper left corner of what they have in common gives the pair.
    """
    some = lambda rows, p: rows.where((F.col(f"{p}x2") > F.col(f"{p}x1")) & (F.col(f"{p}y2") > F.col(f"{p}y1")))
    g, d = some(g, "g_"), some(d, "d_")
    if reach > 0:
        up: int | Column = math.ceil(-math.log2(reach)) if reach < 1 else 0
        # One more, as logarithms are rounded.
        up = up + 1
        gs, ds = g, d
    else:
        tops = g.select("image_id", _level("g_").alias("l")).unionByName(d.select("image_id", _level("d_").alias("l")))
        tops = tops.groupBy("image_id").agg(F.max("l").alias("top"))
        gs, ds = g.join(tops, "image_id"), d.join(tops, "image_id")
        up = F.col("top") - F.col("own")
    on = ["image_id", "level", "pitch", "tx", "ty"]
    # Both at the larger one's level: equal levels are in the first part only.
    same = _tiles(g, "g_", 0, True).join(_tiles(d, "d_", 0, True).unionByName(_tiles(ds, "d_", up, False).drop("top")), on)
    less = _tiles(gs, "g_", up, False).drop("top").join(_tiles(d, "d_", 0, True), on)
    both = same.unionByName(less.select(*same.columns))
    corner = (F.floor(F.greatest("g_x1", "d_x1") / F.col("pitch")) == F.col("tx")) & (F.floor(F.greatest("g_y1", "d_y1") / F.col("pitch")) == F.col("ty"))
    over = (F.least("g_x2", "d_x2") > F.greatest("g_x1", "d_x1")) & (F.least("g_y2", "d_y2") > F.greatest("g_y1", "d_y1"))
    return both.where(corner & over).drop("level", "pitch", "tx", "ty")


def candidate_pairs(gt: DataFrame, det: DataFrame, threshold: float = 0.5, strict: bool = False, crowded: DataFrame | None = None) -> DataFrame:
    """``image_id, gt_idx, pred_idx, conf, iou`` of boxes in one image that overlap enough.

    An equi-join on the image, where the overlap is tested inside the join. Images that ``crowded``
    names (``crowded_images``, checkpointed) are joined by tile instead, so that work follows the overlaps and
    an image's rows are spread over tasks. Boxes without area overlap nothing there.
    """
    g, d = _sides(gt, det)
    pairs = g.join(d, "image_id")
    if crowded is not None:
        if threshold < 0 or threshold == 0 and not strict:
            raise ValueError("tiles find boxes that overlap")
        apart = lambda rows, how: rows.join(crowded, "image_id", how)
        pairs = apart(g, "left_anti").join(apart(d, "left_anti"), "image_id")
        pairs = pairs.unionByName(tile_pairs(apart(g, "left_semi"), apart(d, "left_semi"), threshold).select(*pairs.columns))
    both = pairs.withColumn("iou", box_iou("g_", "d_"))
    test = F.col("iou") > threshold if strict else F.col("iou") >= threshold
    return both.where(test).select("image_id", "gt_idx", "pred_idx", "conf", "iou")


def _folded(pairs: DataFrame, gt_type: str, pred_type: str) -> DataFrame:
    """``image_id, pred_idx, gt_idx`` of the matches in images with few boxes: a fold inside the JVM."""
    # Sorted by falling IoU, then index: negated IoU puts the best first.
    choice = F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("low"), F.col("gt_idx"))))
    preds = pairs.groupBy("image_id", "pred_idx").agg(F.first("conf").alias("conf"), F.transform(choice, lambda x: x["gt_idx"]).alias("choice"))
    turn = F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("low"), F.col("pred_idx"), F.col("choice"))))
    start = F.struct(
        F.array().cast(f"array<{gt_type}>").alias("used"),
        F.array().cast(f"array<struct<pred_idx:{pred_type},gt_idx:{gt_type}>>").alias("out"),
    )

    def step(acc, x):
        got = F.get(F.filter(x["choice"], lambda g: ~F.array_contains(acc["used"], g)), F.lit(0))
        used = F.when(got.isNotNull(), F.array_append(acc["used"], got)).otherwise(acc["used"])
        out = F.array_append(acc["out"], F.struct(x["pred_idx"].alias("pred_idx"), got.alias("gt_idx")))
        return F.struct(used.alias("used"), out.alias("out"))

    folded = preds.groupBy("image_id").agg(turn.alias("turn"))
    return folded.select("image_id", F.explode(F.aggregate("turn", start, step)["out"]).alias("e")).select("image_id", "e.pred_idx", "e.gt_idx")


def _matched_by_cluster(pairs: DataFrame, gt_type: str, pred_type: str) -> DataFrame:
    """The matches of crowded images, cluster of overlapping boxes by cluster.

    Boxes that no chain of overlaps connects can't take each other's place, so each cluster is
    matched wherever it lies, many in one pass over their pairs with the used boxes in a bitmap.
    """
    node = lambda kind, at: F.xxhash64("image_id", F.lit(kind), F.col(at))
    pairs = checkpointed(pairs.withColumns({"a": node("gt", "gt_idx"), "b": node("pred", "pred_idx")}))
    nodes = pairs.select(F.col("a").alias("id")).distinct()
    clusters = single_linkage(nodes, pairs.select("a", "b"))
    rows = pairs.join(clusters, pairs.a == clusters.id).select("component", "image_id", "gt_idx", "pred_idx", "conf", "iou")

    def matched(part: pd.DataFrame) -> pd.DataFrame:
        """The matches of whole clusters; which clusters they are does not matter."""
        part = part.assign(low=-part["conf"], less=-part["iou"]).sort_values(["image_id", "low", "pred_idx", "less", "gt_idx"])
        box = part.groupby(["image_id", "gt_idx"], sort=False).ngroup().tolist()
        pred = part.groupby(["image_id", "pred_idx"], sort=False).ngroup().tolist()
        used, got = bytearray(len(part)), bytearray(len(part))
        won = []
        for at, (g, p) in enumerate(zip(box, pred, strict=True)):
            if not used[g] and not got[p]:
                used[g] = got[p] = 1
                won.append(at)
        return part.iloc[won][["image_id", "pred_idx", "gt_idx"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= HELD:
                rows = pd.concat(held, ignore_index=True)
                ended = rows["component"] != rows["component"].iloc[-1]
                if ended.any():
                    yield matched(rows[ended])
                    rows = rows[~ended]
                held = [rows]
        if held:
            yield matched(pd.concat(held, ignore_index=True))

    image = dict(pairs.dtypes)["image_id"]
    dealt = rows.repartition("component").sortWithinPartitions("component")
    return dealt.mapInPandas(run, f"image_id {image}, pred_idx {pred_type}, gt_idx {gt_type}")


def greedy_match(images: DataFrame | None, gt: DataFrame, det: DataFrame, threshold: float = 0.5, crowd: int = CROWD, crowded: DataFrame | None = None) -> DataFrame:
    """``image_id, pred_idx, conf, is_tp, gt_idx`` of every detection on a known image (None: all are).

    Per image, detections by falling confidence (ties: smaller index) each take the free box of
    highest IoU (ties: smaller index). The image's detections that overlap anything are folded in
    an array of tens of entries inside the JVM; the others are false at once. Images of more than
    ``crowd`` boxes, or those that ``crowded`` names, are joined by tile and matched by cluster instead. As confidence only
    falls, matches at any higher threshold are the same events filtered by it.
    """
    kinds = dict(gt.dtypes)["box_index"], dict(det.dtypes)["pred_idx"]
    crowded = checkpointed(crowded_images(gt, det, crowd) if crowded is None else crowded)
    if crowded.isEmpty():
        won = _folded(candidate_pairs(gt, det, threshold), *kinds)
    else:
        few, many = (lambda rows: rows.join(crowded, "image_id", "left_anti")), (lambda rows: rows.join(crowded, "image_id", "left_semi"))
        won = _folded(candidate_pairs(few(gt), few(det), threshold), *kinds)
        won = won.unionByName(_matched_by_cluster(candidate_pairs(many(gt), many(det), threshold, crowded=crowded), *kinds))
    known = det if images is None else det.join(images.select("image_id").distinct(), "image_id", "left_semi")
    known = known.select("image_id", "pred_idx", "conf")
    return known.join(won, ["image_id", "pred_idx"], "left").select("image_id", "pred_idx", "conf", F.col("gt_idx").isNotNull().alias("is_tp"), "gt_idx")


def match_image(gt: list[tuple], det: list[tuple], threshold: float = 0.5) -> dict:
    """``pred_idx -> box_index`` of one image's matches, by the rules of ``greedy_match``; for code that holds an image at a time.

    ``gt`` has ``(box_index, x1, y1, x2, y2)`` and ``det`` ``(pred_idx, conf, x1, y1, x2, y2)``.
    """
    boxes = sorted(gt)
    corners = np.array([b[1:] for b in boxes], float).reshape(-1, 4)
    free, won = np.ones(len(boxes), bool), {}
    for pred, _, x1, y1, x2, y2 in sorted(det, key=lambda d: (-d[1], d[0])):
        w = np.minimum(corners[:, 2], x2) - np.maximum(corners[:, 0], x1)
        h = np.minimum(corners[:, 3], y2) - np.maximum(corners[:, 1], y1)
        common = np.maximum(w, 0.0) * np.maximum(h, 0.0)
        union = (corners[:, 2] - corners[:, 0]) * (corners[:, 3] - corners[:, 1]) + (x2 - x1) * (y2 - y1) - common
        iou = np.divide(common, union, out=np.zeros(len(boxes)), where=(common > 0) & (union != 0))
        may = np.where(free & (common > 0) & (iou >= threshold), iou, -1.0)
        if len(may) and may.max() >= 0:
            at = int(may.argmax())
            free[at], won[pred] = False, boxes[at][0]
    return won


def best_per_box(gt: DataFrame, det: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``image_id, gt_idx, best_conf, overlap_conf``: the most confident detection on each box, matched or not.

    ``best_conf`` is over detections at or above the threshold, ``overlap_conf`` over any overlap.
    """
    crowded = checkpointed(crowded_images(gt, det))
    pairs = candidate_pairs(gt, det, 0.0, strict=True, crowded=None if crowded.isEmpty() else crowded)
    best = pairs.groupBy("image_id", "gt_idx").agg(F.max(F.when(F.col("iou") >= threshold, F.col("conf"))).alias("best_conf"), F.max("conf").alias("overlap_conf"))
    boxes = gt.select("image_id", F.col("box_index").alias("gt_idx"))
    return boxes.join(best, ["image_id", "gt_idx"], "left")


def miss_kind(best_conf, operating: float = 0.25):
    """Why a box is missed: nothing overlaps it enough, or what does is not confident enough."""
    return F.when(best_conf.isNull(), "localization").when(best_conf < operating, "confidence").otherwise("found")
