"""Boxes as structs of fractions of the page, and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    """Into 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box from two corners in any order: clamped first, then sorted."""
    a, b, c, d = (clamp(v) for v in (x0, y0, x1, y1))
    left, top = F.least(a, c), F.least(b, d)
    return F.struct(left.alias("x"), top.alias("y"), (F.greatest(a, c) - left).alias("w"), (F.greatest(b, d) - top).alias("h"))


def from_pixels(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box from corners in pixels of a page."""
    return from_corners(x0 / width, y0 / height, x1 / width, y1 / height)


def from_points(points: Column, width: Column, height: Column) -> Column:
    """The box around an array of (x, y) structs in pixels."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return from_pixels(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), width, height)


def flipped(box: Column) -> Column:
    """A box measured from the bottom of the page, measured from its top."""
    return F.struct(box["x"].alias("x"), (F.lit(1.0) - (box["y"] + box["h"])).alias("y"), box["w"].alias("w"), box["h"].alias("h"))


def char_box(box: Column, first: Column, last: Column, count: Column) -> Column:
    """The slice of a box that characters ``first`` to ``last`` (exclusive) of ``count`` equal ones take."""
    step = box["w"] / count
    return F.struct((box["x"] + first * step).alias("x"), box["y"].alias("y"), ((last - first) * step).alias("w"), box["h"].alias("h"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length two intervals have in common, 0 where they have none."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, 0 where the union is empty."""
    inter = overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def same_line(a: Column, b: Column) -> Column:
    """Whether two boxes overlap by more than half of the lower one's height."""
    return F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]) > 0.5 * F.least(a["h"], b["h"])


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.octet_length(F.encode(c, "UTF-16LE")) / 2
