"""NumPy kernels for what columns can't express: perceptual hashes, masks, morphology and plane fits."""

from __future__ import annotations

import contextlib
import functools
import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Depth limits in mm, pixel gates, structuring element sizes, plane fit settings.
NEAR, FAR = 200, 3000
LEAST_MASK, LEAST_RING, LEAST_FIT, MOST_FIT = 20, 200, 50, 6000
INNER, OUTER, GLOBAL = 15, 61, 21


def _shrink(n: int, size: int) -> np.ndarray:
    """Weights of ``n`` pixels in each of ``size``: a triangle over the pixels that one comes from, at least one to either side."""
    scale = n / size
    reach = max(scale, 1.0)
    weights = np.maximum(0.0, 1 - np.abs((np.arange(n) + 0.5)[None, :] - ((np.arange(size) + 0.5) * scale)[:, None]) / reach)
    return weights / weights.sum(axis=1, keepdims=True)


def resize_gray(pixels: np.ndarray, size: int = 32) -> np.ndarray:
    """Antialiased bilinear resize of a 2-D array, rows first; whole values from 0 to 255 after either direction."""
    pixels = np.asarray(pixels, float)
    whole = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    return whole(_shrink(pixels.shape[0], size) @ whole(pixels @ _shrink(pixels.shape[1], size).T))


def phash_bits(gray: np.ndarray) -> int:
    """64-bit hash of a square gray matrix as a signed integer, first bit highest.

    Cosines of half-integer frequency over both axes; the leading 8 x 8 block is compared with the
    median of its part without first row and column.
    """
    n = gray.shape[0]
    k = np.arange(n)
    basis = np.cos(np.pi * np.outer(2 * k + 1, k) / (2 * n))
    low = (basis @ gray @ basis.T)[:8, :8]
    word = np.packbits((low > np.median(low[1:, 1:])).ravel()).tobytes()
    return int.from_bytes(word, "big", signed=True)


#: Rows of a block of vectors compared at once, and pairs whose distances are worked out at once.
STRIPE, GATHER = 256, 1 << 15


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows to rows, squares added up in the order of the elements as a fold over columns does."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += (x - y) ** 2
    return np.sqrt(out)


def closest(a: np.ndarray, b: np.ndarray | None, ask_a: np.ndarray, ask_b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The nearest rows of ``b`` of rows of ``a`` and the other way round, of those that ask, as ``from a, row, row of the other, distance``.

    Without ``b`` rows of ``a`` are compared with each other. A matrix product screens a stripe of
    rows at a time; pairs that its rounding leaves as good as the least are worked out exactly.
    Some of the pairs that it gives are not the nearest yet: the caller takes the least.
    """
    same = b is None
    b, ask_b = (a, np.zeros(len(a), bool)) if same else (b, ask_b)
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    left = np.column_stack([-2 * a, na, np.ones(len(a))])
    right = np.column_stack([b, np.ones(len(b)), nb]).T.copy()
    slack = 8 * (a.shape[1] + 8) * 2.0**-53
    slack_a, slack_b = slack * (na + nb.max()), slack * (nb + na.max())
    best_b = np.full(len(b), np.inf)
    for at in range(0, len(a), STRIPE):
        rows = slice(at, at + STRIPE)
        d = left[rows] @ right
        if same:
            own = np.arange(len(d))
            d[own, at + own] = np.inf
        low = d.min(axis=1)
        low = np.where(ask_a[rows] & np.isfinite(low), low + slack_a[rows], -np.inf)
        found = [(True, *np.nonzero(d <= low[:, None]))]
        if ask_b.any():
            np.minimum(best_b, d.min(axis=0), out=best_b)
            found.append((False, *np.nonzero(d <= np.where(ask_b, best_b + slack_b, -np.inf))))
        for from_a, i, j in found:
            i = i + at
            for k in range(0, len(i), GATHER):
                x, y = i[k : k + GATHER], j[k : k + GATHER]
                exact = _distances(a[x], b[y])
                finite = np.isfinite(exact)
                x, y = (x, y) if from_a else (y, x)
                yield np.full(finite.sum(), from_a), x[finite], y[finite], exact[finite]


def with_phash(images: DataFrame) -> DataFrame:
    """``path, hash`` of rows of Spark's image source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = []
            for h, w, ch, data in zip(b["height"], b["width"], b["nChannels"], b["data"], strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h, w, ch).astype(float)
                gray = px[..., 0] if ch == 1 else np.floor(px[..., 0] * 0.114 + px[..., 1] * 0.587 + px[..., 2] * 0.299 + 0.5)
                hashes.append(phash_bits(resize_gray(gray)))
            yield pd.DataFrame({"path": b["path"], "hash": hashes})

    cols = images.select(F.col("image.origin").alias("path"), *[f"image.{c}" for c in ("height", "width", "nChannels", "data")])
    return cols.mapInPandas(run, "path string, hash long")


def fill_polygon(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Boolean mask of a polygon of normalised (x, y); vertices are cut to whole pixels, edges belong to it."""
    mask = np.zeros((height, width), bool)
    if len(points) < 3:
        return mask
    xy = np.trunc(np.asarray(points, float) * [width, height]).astype(int)
    a, b = xy, np.roll(xy, -1, axis=0)
    for y in range(max(0, xy[:, 1].min()), min(height - 1, xy[:, 1].max()) + 1):
        cross = (np.minimum(a[:, 1], b[:, 1]) <= y) & (y < np.maximum(a[:, 1], b[:, 1]))
        xs = np.sort(a[cross, 0] + (y - a[cross, 1]) * (b[cross, 0] - a[cross, 0]) / (b[cross, 1] - a[cross, 1]))
        for x0, x1 in zip(xs[::2], xs[1::2], strict=False):
            mask[y, max(0, int(np.ceil(x0))) : min(width, int(np.floor(x1)) + 1)] = True
    for (x0, y0), (x1, y1) in zip(a, b, strict=True):
        n = max(abs(x1 - x0), abs(y1 - y0)) + 1
        xs, ys = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
        inside = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        mask[ys[inside], xs[inside]] = True
    return mask


def mask_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """Tight half-open bounds x0, y0, x1, y1, or None of an empty mask."""
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(xs) else None


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    """Dilation by an ellipse of odd size: each of its rows is a run, so row maxima are running counts."""
    r = size // 2
    out = np.zeros_like(mask)
    own = np.flatnonzero(mask.any(axis=1))
    if not len(own):
        return out
    # Only rows that the mask has pixels in reach others.
    y0, y1 = int(own[0]), int(own[-1]) + 1
    counts = np.cumsum(np.pad(mask[y0:y1], ((0, 0), (r + 1, r))), axis=1, dtype=np.int32)
    hits: dict[int, np.ndarray] = {}
    for dy in range(-r, r + 1):
        half = int(round(r * math.sqrt(max(0.0, 1 - (dy / r) ** 2)))) if r else 0
        if half not in hits:
            left = counts[:, r - half : r - half + mask.shape[1]]
            right = counts[:, r + half + 1 : r + half + 1 + mask.shape[1]]
            hits[half] = right > left
        low, high = max(0, y0 + dy), min(mask.shape[0], y1 + dy)
        if low < high:
            out[low:high] |= hits[half][low - dy - y0 : high - dy - y0]
    return out


@functools.lru_cache(maxsize=64)
def _layout(head: bytes) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether columns come first, and type of a saved array with this header."""
    stream = io.BytesIO(head)
    np.lib.format.read_magic(stream)
    return np.lib.format.read_array_header_1_0(stream)


def load_array(data: bytes) -> np.ndarray:
    """A saved array, not to be written to; most have one of few headers, and reading these takes longer than the rest."""
    if data[:8] != np.lib.format.magic(1, 0):
        return np.load(io.BytesIO(data), allow_pickle=False)
    start = 10 + int.from_bytes(data[8:10], "little")
    shape, by_column, kind = _layout(bytes(data[:start]))
    if kind.hasobject or 0 in shape:
        return np.load(io.BytesIO(data), allow_pickle=False)
    return np.frombuffer(data, kind, math.prod(shape), start).reshape(shape, order="F" if by_column else "C")


def valid_depth(depth: np.ndarray) -> np.ndarray:
    """Finite and not 0 for floats, above 0 for integers."""
    return np.isfinite(depth) & (depth != 0) if depth.dtype.kind == "f" else depth > 0


def clip_depth(depth: np.ndarray, near: float = NEAR, far: float = FAR) -> tuple[np.ndarray, int]:
    """Depths outside the limits become 0; also how many."""
    out = (depth > 0) & ((depth < near) | (depth > far))
    return np.where(out, 0, depth), int(out.sum())


def _planes(points: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Coefficients of the planes through three points each, without those of points on a line."""
    try:
        return np.linalg.solve(points, z[..., None])[..., 0]
    except np.linalg.LinAlgError:
        out = []
        for p, v in zip(points, z, strict=True):
            with contextlib.suppress(np.linalg.LinAlgError):
                out.append(np.linalg.solve(p, v))
        return np.array(out).reshape(-1, 3)


@functools.lru_cache(maxsize=64)
def _tries(n: int, seed: int, tries: int) -> tuple[np.ndarray | None, np.ndarray]:
    """Those of ``n`` points that a fit takes, None for all, and three of these for each try; as many points give the same."""
    rng = np.random.default_rng(seed)
    take = rng.choice(n, MOST_FIT, replace=False) if n > MOST_FIT else None
    return take, np.array([rng.choice(min(n, MOST_FIT), 3, replace=False) for _ in range(tries)])


def fit_plane(x: np.ndarray, y: np.ndarray, z: np.ndarray, seed: int = 0, tries: int = 100) -> tuple[np.ndarray, float] | None:
    """Coefficients of z = a x + b y + c that most points agree with, and their share; None for too few points."""
    if len(z) < LEAST_FIT:
        return None
    take, threes = _tries(len(z), seed, tries)
    if take is not None:
        x, y, z = x[take], y[take], z[take]
    columns = np.stack([x, y, np.ones(len(x))]).astype(float, copy=False)
    design = columns.T
    limit = max(float(np.median(np.abs(z - np.median(z)))), 1e-9)
    planes = _planes(design[threes], z[threes])
    if not len(planes):
        return None
    # Some tries at once, in memory that is small enough to stay near; of those that as many agree with, the first.
    agree: list[int] = []
    for at in range(0, len(planes), 8):
        off = planes[at : at + 8] @ columns
        off -= z
        agree += np.count_nonzero(np.abs(off, out=off) <= limit, axis=1).tolist()
        if max(agree) == len(z):  # no later try can agree with more
            break
    best = np.abs(planes[int(np.argmax(agree))] @ columns - z) <= limit
    if best.sum() < 3:
        return None
    if not best.all():
        design, z = design[best], z[best]
    return np.linalg.lstsq(design, z, rcond=None)[0], float(best.mean())


def road_area(mask: np.ndarray, everywhere: bool = False) -> np.ndarray:
    """The road that a plane is fitted to: a ring around the mask, or all but the mask and its rim."""
    return ~dilate(mask, GLOBAL) if everywhere else dilate(mask, OUTER) & ~dilate(mask, INNER)


def road_pixels(mask: np.ndarray, ok: np.ndarray, everywhere: bool = False) -> np.ndarray:
    """Valid pixels of the road."""
    return road_area(mask, everywhere) & ok


def measure(depth: np.ndarray, mask: np.ndarray, use_plane: bool = True, everywhere: bool = False, road: Callable[[], np.ndarray] | None = None) -> dict:
    """Depth below the road around a mask: 90th percentile, spread of the road, agreement, and a flag.

    Without a plane depths count as measured from the surface already: the percentile of the mask's
    own valid depths, of any size, and no road is needed. ``road`` may give the mask's road, if known.
    """
    out = {"dbs_scalar": None, "road_std": None, "inlier_frac": None, "flag": ""}
    if use_plane:
        depth, _ = clip_depth(depth)
    ok = valid_depth(depth)
    inside = mask & ok
    if inside.sum() < LEAST_MASK:
        return out | {"flag": "mask_fail"}
    if not use_plane:
        return out | {"dbs_scalar": float(np.percentile(depth[inside].astype(float), 90))}
    ring = (road() if road else road_area(mask, everywhere)) & ok
    if ring.sum() < LEAST_RING:
        return out | {"flag": "ring_fail"}
    # Whole numbers as floats: exact, and read where the masks are, without lists of places.
    ys, xs = np.broadcast_arrays(np.arange(float(depth.shape[0]))[:, None], np.arange(float(depth.shape[1])))
    yr, xr, yi, xi = ys[ring], xs[ring], ys[inside], xs[inside]
    fit = fit_plane(xr, yr, depth[ring].astype(float))
    if fit is None:
        return out | {"flag": "ransac_fail"}
    (a, b, c), share = fit
    below = depth[inside] - (a * xi + b * yi + c)
    spread = depth[ring] - (a * xr + b * yr + c)
    return {"dbs_scalar": float(np.percentile(below, 90)), "road_std": float(np.std(spread)), "inlier_frac": round(share, 3), "flag": "low_inlier" if share < 0.5 else ""}


def measured(batches: Iterator[pd.DataFrame], use_plane: bool = True, everywhere: bool = False) -> Iterator[pd.DataFrame]:
    """Measurements of batches of rows ``(stem, depth, points)``, as ``MEASURED``."""
    last, mask, road = None, None, None
    for b in batches:
        out = []
        for stem, data, points in zip(b["stem"], b["depth"], b["points"], strict=True):
            depth = load_array(data)
            polygon = [(p["x"], p["y"]) for p in points], depth.shape
            # Neighbouring rows often have one outline.
            if polygon != last:
                last, mask = polygon, fill_polygon(np.array(polygon[0]), *depth.shape)
                road = functools.cache(functools.partial(road_area, mask, everywhere))
            out.append({"stem": stem} | measure(depth, mask, use_plane, everywhere, road))
        yield pd.DataFrame(out, columns=["stem", "dbs_scalar", "road_std", "inlier_frac", "flag"])


MEASURED = "stem string, dbs_scalar double, road_std double, inlier_frac double, flag string"


def measure_depths(rows: DataFrame, use_plane: bool = True, everywhere: bool = False) -> DataFrame:
    """Measurements of rows ``(stem, depth, points)``: ``depth`` holds a saved array, ``points`` a normalised polygon."""
    return rows.select("stem", "depth", "points").mapInPandas(lambda batches: measured(batches, use_plane, everywhere), MEASURED)


def depth_profile(rows: DataFrame) -> DataFrame:
    """``stem, least, most, n_zero, n_nan, valid_pct, p1, p50, p99`` of rows ``(stem, depth)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for stem, data in zip(b["stem"], b["depth"], strict=True):
                d = load_array(data)
                v = d[valid_depth(d)].astype(float, copy=False)
                p = np.percentile(v, [1, 50, 99], overwrite_input=True) if len(v) else [np.nan] * 3
                nan = int(np.isnan(d).sum()) if d.dtype.kind == "f" else 0
                out.append((stem, float(np.nanmin(d)), float(np.nanmax(d)), int((d == 0).sum()), nan, 100 * len(v) / d.size, *map(float, p)))
            yield pd.DataFrame(out, columns=["stem", "least", "most", "n_zero", "n_nan", "valid_pct", "p1", "p50", "p99"])

    return rows.select("stem", "depth").mapInPandas(run, "stem string, least double, most double, n_zero long, n_nan long, valid_pct double, p1 double, p50 double, p99 double")


def sign_of_change(depth: np.ndarray, mask: np.ndarray) -> tuple[float, str]:
    """Median inside less median outside, and LARGER if positive, else SMALLER."""
    ok = valid_depth(depth)
    delta = float(np.median(depth[mask & ok]) - np.median(depth[~mask & ok]))
    return delta, "LARGER" if delta > 0 else "SMALLER"
