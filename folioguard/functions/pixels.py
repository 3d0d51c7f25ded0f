"""Numbers from image rasters: vectorised helpers over binary columns.

A raster is a binary column of ``channels`` bytes a pixel, row by row; only
numbers leave the helpers, so pixels are never shuffled.  Rasters with missing or
too few bytes give the stated result for broken images.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCAN, FRAME = (0.299, 0.587, 0.114), (0.2126, 0.7152, 0.0722)


def _plane(raw: bytes | None, width: int | None, height: int | None, channels: int, bgr: bool = False) -> np.ndarray | None:
    """(height, width, 3) in red, green, blue; None for a broken raster.  ``bgr``:
    the raster has blue first."""
    if raw is None or not width or not height or width < 1 or height < 1 or len(raw) < width * height * channels:
        return None
    a = np.frombuffer(raw, np.uint8, width * height * channels).reshape(height, width, channels)
    if channels < 3:
        return np.repeat(a[:, :, :1], 3, axis=2)
    return a[:, :, 2::-1] if bgr else a[:, :, :3]


def _grey(plane: np.ndarray, weights: tuple) -> np.ndarray:
    return sum(plane[:, :, i].astype(np.float64) * w for i, w in enumerate(weights))


def laplacian(grey: np.ndarray) -> np.ndarray:
    """Absolute responses of the inner pixels."""
    c = grey[1:-1, 1:-1]
    return np.abs(4 * c - grey[1:-1, :-2] - grey[1:-1, 2:] - grey[:-2, 1:-1] - grey[2:, 1:-1]).ravel()


def top_mean(values: np.ndarray, count: int) -> float:
    """The mean of the ``count`` largest."""
    return float(np.partition(values, len(values) - count)[len(values) - count :].mean())


def scan_statistics(plane: np.ndarray) -> tuple[float, float, float, float]:
    """(mean, deviation, edge strength, share of detailed pixels) on a grid of
    about 420 steps along the shorter side."""
    h, w = plane.shape[:2]
    step = max(1, int(np.floor(min(w, h) / 420 + 0.5)))
    grey = _grey(plane[::step, ::step], SCAN).astype(np.float32).astype(np.float64)
    full = _grey(plane[::step, ::step], SCAN)
    mean = full.mean()
    deviation = np.sqrt(max(0.0, (full**2).mean() - mean**2))
    found = laplacian(grey) if min(grey.shape) > 2 else np.empty(0)
    if not len(found):
        return float(mean), float(deviation), 0.0, 0.0
    return float(mean), float(deviation), top_mean(found, max(1, int(np.ceil(len(found) * 0.1)))), float((found >= 12).mean())


def sharpness(plane: np.ndarray) -> float:
    """Mean of the strongest 12 % of edges; 0 for images under 3 by 3."""
    if min(plane.shape[:2]) < 3:
        return 0.0
    found = laplacian(_grey(plane, FRAME).astype(np.float32).astype(np.float64))
    return top_mean(found, max(1, int(np.floor(len(found) * 0.12 + 0.5))))


def movement(before: np.ndarray, now: np.ndarray) -> float:
    """Mean absolute change of luminance beyond the change of brightness."""
    change = _grey(now, FRAME) - _grey(before, FRAME)
    return float(np.abs(change - change.mean()).mean())


def paper_bounds(plane: np.ndarray) -> tuple[int, int, int, int]:
    """(left, top, width, height) of the bright, little coloured part; the whole
    image where that is too small."""
    h, w = plane.shape[:2]
    whole = (0, 0, w, h)
    small = min(w, h)
    step, corner = max(2, int(np.floor(small / 420 + 0.5))), max(1, int(np.floor(small * 0.06 + 0.5)))
    ys, xs = np.mgrid[0:h:step, 0:w:step]
    part = plane[::step, ::step].astype(np.int64)
    grey = _grey(part, SCAN)
    in_corner = ((xs < corner) | (xs >= w - corner)) & ((ys < corner) | (ys >= h - corner))
    edge = grey[in_corner].mean() if in_corner.any() else 110.0
    hit = (grey >= min(225.0, max(135.0, edge + 28))) & (part.max(axis=2) - part.min(axis=2) < 85)
    x, y = np.sort(xs[hit]), np.sort(ys[hit])
    if len(x) < max(40, int(np.floor(w * h / (step * step) * 0.04 + 0.5))):
        return whole
    low, high, pad = int(len(x) * 0.008), min(len(x) - 1, int(np.ceil(len(x) * 0.992))), int(np.floor(small * 0.012 + 0.5))
    left, top = max(0, int(x[low]) - pad), max(0, int(y[low]) - pad)
    width, height = min(w, int(x[high]) + pad) - left, min(h, int(y[high]) + pad) - top
    if width < w * 0.5 or height < h * 0.5 or width * height < w * h * 0.32:
        return whole
    return left, top, width, height


def burn(plane: np.ndarray, rects: list[tuple[float, float, float, float]]) -> np.ndarray:
    """Black rectangles (left, top, width, height); a pixel goes black if its
    centre is inside."""
    out = plane.copy()
    for left, top, width, height in rects:
        a, b = max(0, int(np.ceil(left - 0.5))), max(0, int(np.ceil(top - 0.5)))
        out[b : max(b, int(np.ceil(top + height - 0.5))), a : max(a, int(np.ceil(left + width - 0.5)))] = 0
    return out


def _numbers(kind: str, fields: list[str], use: Callable[[np.ndarray], tuple], broken: tuple, channels: int, bgr: bool = False):
    arrow = {"double": pa.float64(), "int": pa.int32()}[kind]

    @F.arrow_udf("struct<" + ", ".join(f"{f}: {kind}" for f in fields) + ">")
    def run(raw: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        rows = []
        for r, w, h in zip(raw.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True):
            plane = _plane(r, w, h, channels, bgr)
            rows.append(broken if plane is None else use(plane))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, arrow) for c in columns], fields)

    return run


def scan_statistics_column(raw: Column, width: Column, height: Column, channels: int = 4) -> Column:
    """struct(mean, deviation, strength, coverage); nulls for a broken raster."""
    return _numbers("double", ["mean", "deviation", "strength", "coverage"], scan_statistics, (None,) * 4, channels)(raw, width, height)


def sharpness_column(raw: Column, width: Column, height: Column, channels: int = 4) -> Column:
    """Frame sharpness; 0 for a broken raster."""
    return _numbers("double", ["value"], lambda p: (sharpness(p),), (0.0,), channels)(raw, width, height)["value"]


def paper_bounds_column(raw: Column, width: Column, height: Column, channels: int = 4, bgr: bool = False) -> Column:
    """struct(left, top, width, height) of the paper; nulls for a broken raster."""
    return _numbers("int", ["left", "top", "width", "height"], paper_bounds, (None,) * 4, channels, bgr)(raw, width, height)


def movement_column(before: Column, now: Column, width: Column, height: Column, channels: int = 4) -> Column:
    """Movement between two rasters of one size; infinity for broken ones."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        out = []
        for x, y, w, h in zip(a.to_pylist(), b.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True):
            p, q = _plane(x, w, h, channels), _plane(y, w, h, channels)
            out.append(float("inf") if p is None or q is None else movement(p, q))
        return pa.array(out, pa.float64())

    return run(before, now, width, height)


def burn_column(raw: Column, width: Column, height: Column, rects: Column, channels: int = 4) -> Column:
    """The raster with black rectangles (array of left, top, width, height); a
    broken raster stays as it is."""

    @F.arrow_udf("binary")
    def run(raw: pa.Array, width: pa.Array, height: pa.Array, rects: pa.Array) -> pa.Array:
        out = []
        for r, w, h, boxes in zip(raw.to_pylist(), width.to_pylist(), height.to_pylist(), rects.to_pylist(), strict=True):
            if not boxes or _plane(r, w, h, channels) is None:
                out.append(r)
                continue
            a = np.frombuffer(r, np.uint8, w * h * channels).reshape(h, w, channels)
            done = burn(a, [(b["left"], b["top"], b["width"], b["height"]) for b in boxes or ()])
            if channels == 4:
                done[:, :, 3] = a[:, :, 3]
            out.append(done.tobytes() + r[w * h * channels :])
        return pa.array(out, pa.binary())

    return run(raw, width, height, rects)
