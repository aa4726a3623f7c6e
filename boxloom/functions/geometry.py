"""Box geometry as Column expressions; nothing here needs Python on an executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size bucket edges in the letterboxed input space, and domain edges of mean area shares.
SMALL, MEDIUM = 32.0 * 32.0, 96.0 * 96.0
FAR, MID = 0.02, 0.08
#: Share of an image from which a box's severity is calibrated.
CALIBRATED = 0.123
INPUT_SIZE = 640.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(value: Column | str, high: Column | float, low: float = 0.0) -> Column:
    return F.least(F.greatest(_col(value), F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def clipped_corners(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners inside the image, whether any moved, and whether the box has no area left."""
    c = {"x0": clip(x0, width), "y0": clip(y0, height), "x1": clip(x1, width), "y1": clip(y1, height)}
    moved = (c["x0"] != x0) | (c["y0"] != y0) | (c["x1"] != x1) | (c["y1"] != y1)
    return c | {"clipped": moved, "degenerate": (c["x1"] <= c["x0"]) | (c["y1"] <= c["y0"])}


def to_yolo(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    """Absolute corners to normalised centre and size."""
    return {"cx": (x0 + x1) / 2 / width, "cy": (y0 + y1) / 2 / height, "w": (x1 - x0) / width, "h": (y1 - y0) / height}


def clip_unit(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    """Each of centre and size clipped to [0, 1] by itself; corners may still leave the image."""
    return {k: clip(v, 1.0) for k, v in (("cx", cx), ("cy", cy), ("w", w), ("h", h))}


def to_corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Normalised centre and size to native corners."""
    return {"x1": (cx - w / 2) * width, "y1": (cy - h / 2) * height, "x2": (cx + w / 2) * width, "y2": (cy + h / 2) * height}


def polygon_box(points: Column) -> dict[str, Column]:
    """Bounds of an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def letterbox_area(w: Column, h: Column, width: Column, height: Column, size: float = INPUT_SIZE) -> Column:
    """Area of a normalised box after the image is scaled so that its longer side is ``size``."""
    r = F.lit(size) / F.greatest(width, height)
    return w * width * r * h * height * r


def size_bucket(area: Column | str) -> Column:
    """small below 32 squared, medium up to and including 96 squared, else large; null stays null."""
    a = _col(area)
    return F.when(a.isNull(), None).when(a < SMALL, "small").when(a <= MEDIUM, "medium").otherwise("large")


def side_bucket(area: Column | str) -> Column:
    side = F.sqrt(_col(area))
    return F.when(side < 16, "<16").when(side < 32, "16-32").otherwise(">=32")


def tertile(value: Column | str, low: Column, high: Column, names: tuple[str, str, str] = ("low", "medium", "high")) -> Column:
    """Both edges belong below; null and NaN give the empty string."""
    v = _col(value)
    return F.when(v.isNull() | F.isnan(v), "").when(v <= low, names[0]).when(v <= high, names[1]).otherwise(names[2])


def iou(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Intersection over union, 0 without a positive intersection."""
    w, h = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when(inter <= 0, F.lit(0.0)).otherwise(F.try_divide(inter, union))


def box_iou(a: str, b: str) -> Column:
    """IoU of two corner boxes whose columns carry these prefixes."""
    return iou(*[F.col(f"{p}{c}") for p in (a, b) for c in ("x1", "y1", "x2", "y2")])


def expand_clip(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float = 0.15) -> dict[str, Column]:
    """Grow each side by the whole-pixel part of ``margin`` of the box's size, inside the image."""
    dx, dy = (F.lit(margin) * (x2 - x1)).cast("int"), (F.lit(margin) * (y2 - y1)).cast("int")
    zero = F.lit(0)
    return {"x1": F.greatest(x1 - dx, zero), "y1": F.greatest(y1 - dy, zero), "x2": F.least(x2 + dx, width), "y2": F.least(y2 + dy, height)}


def area_share(x1: Column, y1: Column, x2: Column, y2: Column, width: Column | float, height: Column | float) -> Column:
    return (x2 - x1) * (y2 - y1) / (width * height)


def domain_label(mean_share: Column | str) -> Column:
    m = _col(mean_share)
    return F.when(m < FAR, "far/dashcam").when(m < MID, "mid").otherwise("close-up")


def calibrated(share: Column | str, threshold: float = CALIBRATED) -> Column:
    return _col(share) >= threshold


def near_equal(a: dict[str, Column], b: dict[str, Column], tolerance: float = 1e-6) -> Column:
    """All coordinates within the tolerance."""
    tests = [F.abs(a[k] - b[k]) <= tolerance for k in a]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
