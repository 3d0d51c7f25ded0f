"""Boxes, crops and corners, as column expressions.

Boxes are structs (left, top, width, height), points (x, y), sizes (width,
height), corners (top_left, top_right, bottom_right, bottom_left) of points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_up


def box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.cast("double").alias("left"), top.cast("double").alias("top"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def clamp(x: Column, low, high) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(as_column(high), F.greatest(as_column(low), x))


def padding(height: Column) -> Column:
    return F.greatest(F.lit(3.0), half_up(height * 0.12).cast("double"))


def redaction_rectangle(b: Column, page_top: Column, page_width: Column, page_height: Column, mode: str = "folder") -> Column:
    """The rectangle to black out on a page.  ``folder`` (and images) keeps it on
    the page from its clipped corner; ``single`` only caps its size."""
    pad = padding(b["height"])
    left, top = F.greatest(F.lit(0.0), b["left"] - pad), F.greatest(F.lit(0.0), b["top"] - page_top - pad)
    most = (page_width - left, page_height - top) if mode == "folder" else (page_width, page_height)
    return box(left, top, F.least(most[0], b["width"] + pad * 2), F.least(most[1], b["height"] + pad * 2))


def scale_box(b: Column, source: Column, target: Column) -> Column:
    """A box moved from one size to another and clamped; unchanged if a size is
    not positive."""
    sx, sy = target["width"] / source["width"], target["height"] / source["height"]
    left, top = clamp(b["left"] * sx, 0, target["width"]), clamp(b["top"] * sy, 0, target["height"])
    right = F.greatest(left, F.least(target["width"], (b["left"] + b["width"]) * sx))
    bottom = F.greatest(top, F.least(target["height"], (b["top"] + b["height"]) * sy))
    ok = (source["width"] > 0) & (source["height"] > 0) & (target["width"] > 0) & (target["height"] > 0)
    return F.when(ok, box(left, top, right - left, bottom - top)).otherwise(box(b["left"], b["top"], b["width"], b["height"]))


def manual_box(start: Column, end: Column, least: float = 8.0) -> Column:
    """The box between two points; null if a side is shorter than ``least``."""
    width, height = F.abs(end["x"] - start["x"]), F.abs(end["y"] - start["y"])
    return F.when((width >= least) & (height >= least), box(F.least(start["x"], end["x"]), F.least(start["y"], end["y"]), width, height))


def document_point(client: Column, rect: Column, size: Column) -> Column:
    """A pointer position as a point of the document, clamped to it."""
    x, y = clamp(client["x"] - rect["left"], 0, rect["width"]), clamp(client["y"] - rect["top"], 0, rect["height"])
    return F.struct((x / rect["width"] * size["width"]).alias("x"), (y / rect["height"] * size["height"]).alias("y"))


def camera_crop(source: Column, display: Column, guide: Column, mirrored: Column) -> Column:
    """struct(x, y, width, height): what of a cover-fitted camera picture lies in
    the guide; null for sizes that are not positive."""
    scale = F.greatest(display["width"] / source["width"], display["height"] / source["height"])
    sx, sy = (source["width"] - display["width"] / scale) / 2, (source["height"] - display["height"] / scale) / 2
    left, top = clamp(guide["left"] - display["left"], 0, display["width"]), clamp(guide["top"] - display["top"], 0, display["height"])
    right = clamp(guide["left"] + guide["width"] - display["left"], left, display["width"])
    bottom = clamp(guide["top"] + guide["height"] - display["top"], top, display["height"])
    width, height = (right - left) / scale, (bottom - top) / scale
    plain = sx + left / scale
    x = F.when(mirrored, source["width"] - (plain + width)).otherwise(plain)
    ok = (source["width"] > 0) & (source["height"] > 0) & (display["width"] > 0) & (display["height"] > 0)
    made = F.struct(
        clamp(x, 0, source["width"] - width).alias("x"), clamp(sy + top / scale, 0, source["height"] - height).alias("y"), width.alias("width"), height.alias("height")
    )
    return F.when(ok, made)


def capture_size(width: Column, height: Column, most: int = 4096) -> Column:
    scale = F.least(F.lit(1.0), F.lit(float(max(1, most))) / F.greatest(width, height))
    side = lambda c: F.greatest(F.lit(1), half_up(c * scale)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def preview_size(width: Column, height: Column, room_width: Column, room_height: Column) -> Column:
    """The size that fits a stage; 1 by 1 where a number is missing, not finite
    or not positive."""
    values = (width, height, room_width, room_height)
    ok = reduce(lambda a, b: a & b, [F.coalesce((x > 0) & (x < float("inf")), F.lit(False)) for x in values])
    scale = F.least(room_width / width, room_height / height)
    side = lambda c: F.when(ok, F.greatest(F.lit(1), F.floor(c * scale))).otherwise(1).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


NAMES = ("top_left", "top_right", "bottom_right", "bottom_left")


def _ring(corners: Column) -> list[Column]:
    return [corners[n] for n in NAMES]


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def area(corners: Column) -> Column:
    p = _ring(corners)
    return F.abs(reduce(lambda a, b: a + b, [p[i]["x"] * p[(i + 1) % 4]["y"] - p[(i + 1) % 4]["x"] * p[i]["y"] for i in range(4)]) / 2)


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def valid_corners(corners: Column) -> Column:
    """Inside the picture, convex, not too small.  False for missing numbers."""
    p = _ring(corners)
    inside = _all([(x >= 0) & (x <= 1) for q in p for x in (q["x"], q["y"])])
    turn = []
    for i in range(4):
        a, b, c = p[i], p[(i + 1) % 4], p[(i + 2) % 4]
        turn.append((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))
    convex = _all([t > 0.0005 for t in turn]) | _all([t < -0.0005 for t in turn])
    edges = _all([distance(p[i], p[(i + 1) % 4]) >= 0.06 for i in range(4)])
    return F.coalesce(inside & convex & (area(corners) >= 0.02) & edges, F.lit(False))


def _sides(c: Column) -> tuple[Column, Column, Column, Column]:
    return distance(c["top_left"], c["top_right"]), distance(c["bottom_left"], c["bottom_right"]), distance(c["top_left"], c["bottom_left"]), distance(c["top_right"], c["bottom_right"])


def safe_full_frame(c: Column) -> Column:
    """Corners close to the frame on all sides."""
    top, bottom, left, right = _sides(c)
    edges = (
        (F.greatest(c["top_left"]["x"], c["bottom_left"]["x"]) <= 0.06) & (F.least(c["top_right"]["x"], c["bottom_right"]["x"]) >= 0.94)
        & (F.greatest(c["top_left"]["y"], c["top_right"]["y"]) <= 0.06) & (F.least(c["bottom_left"]["y"], c["bottom_right"]["y"]) >= 0.94)
    )
    return valid_corners(c) & edges & (area(c) >= 0.84) & (F.least(top, bottom) >= 0.88) & (F.least(left, right) >= 0.88)


def safe_detected_paper(c: Column) -> Column:
    """Corners that look like a sheet of paper inside the picture."""
    top, bottom, left, right = _sides(c)
    alike = (F.least(top, bottom) / F.greatest(top, bottom) >= 0.62) & (F.least(left, right) / F.greatest(left, right) >= 0.62)
    at_top, at_bottom = F.greatest(c["top_left"]["y"], c["top_right"]["y"]) <= 0.04, F.least(c["bottom_left"]["y"], c["bottom_right"]["y"]) >= 0.96
    at_left, at_right = F.greatest(c["top_left"]["x"], c["bottom_left"]["x"]) <= 0.04, F.least(c["top_right"]["x"], c["bottom_right"]["x"]) >= 0.96
    size = (area(c) >= 0.16) & (area(c) <= 0.93) & (F.least(top, bottom) >= 0.34) & (F.least(left, right) >= 0.38)
    return valid_corners(c) & size & alike & (at_top == at_bottom) & (at_left == at_right)


def plausible_live_paper(c: Column) -> Column:
    top, bottom, left, right = _sides(c)
    width, height = F.greatest(top, bottom), F.greatest(left, right)
    return valid_corners(c) & (area(c) >= 0.16) & (width >= 0.38) & (height >= 0.38) & (F.least(top, bottom) / width >= 0.48) & (F.least(left, right) / height >= 0.48)


def crop_short_edge(c: Column, width: Column, height: Column) -> Column:
    """The shorter side, in pixels, of what corners cut from an image."""
    size = _crop_sides(c, width, height)
    return F.least(*size)


def _crop_sides(c: Column, width: Column, height: Column) -> tuple[Column, Column]:
    far = lambda a, b: F.hypot((c[a]["x"] - c[b]["x"]) * width, (c[a]["y"] - c[b]["y"]) * height)
    return F.greatest(far("top_left", "top_right"), far("bottom_left", "bottom_right")), F.greatest(far("top_left", "bottom_left"), far("top_right", "bottom_right"))


def crop_size(c: Column, width: Column, height: Column, most: int = 2400) -> Column:
    """The size of the straightened crop, its longer side at most ``most``."""
    return capture_size(*_crop_sides(c, width, height), most)


def code_box(points: Column, width: Column, height: Column) -> Column:
    """The padded extent of a code's result points, or a corner without any."""
    small = F.least(width, height)
    fallback, pad = F.greatest(F.lit(40.0), small * 0.18), F.greatest(F.lit(8.0), small * 0.012)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    some = F.size(points) > 0
    left = F.when(some, F.greatest(F.lit(0.0), F.array_min(xs) - pad)).otherwise(0.0)
    top = F.when(some, F.greatest(F.lit(0.0), F.array_min(ys) - pad)).otherwise(0.0)
    right = F.when(some, F.least(width, F.array_max(xs) + pad)).otherwise(fallback)
    bottom = F.when(some, F.least(height, F.array_max(ys) + pad)).otherwise(fallback)
    return box(left, top, F.greatest(fallback * 0.4, right - left), F.greatest(fallback * 0.4, bottom - top))
