"""Boxes (left, top, right, bottom) and points as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def width(b: Column) -> Column:
    return b["right"] - b["left"]


def height(b: Column) -> Column:
    return b["bottom"] - b["top"]


def pad(b: Column, x: Column, y: Column) -> Column:
    return box(b["left"] - x, b["top"] - y, b["right"] + x, b["bottom"] + y)


def clip(b: Column, w: float, h: float) -> Column:
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
    return box(inside(b["left"], w), inside(b["top"], h), inside(b["right"], w), inside(b["bottom"], h))


def rounded(b: Column) -> Column:
    """Halves go to the even number."""
    return box(*(F.bround(b[c], 0) for c in ("left", "top", "right", "bottom")))


def centre_scale(b: Column) -> Column:
    """The middle, and the longer side in units of 200 pixels."""
    return F.struct(((b["left"] + b["right"]) / 2).alias("cx"), ((b["top"] + b["bottom"]) / 2).alias("cy"), (F.greatest(width(b), height(b)) / 200).alias("scale"))


def box_feature(b: Column, focal: Column, w: Column, h: Column) -> Column:
    """Where a box lies and how large it is, for a model that sees its crop alone."""
    c = centre_scale(b)
    side = c["scale"] * 200
    return F.array((c["cx"] - w / 2) / focal * 2.8, (c["cy"] - h / 2) / focal * 2.8, (side - 0.24 * focal) / (0.06 * focal))


def around_points(points: Column, share: float, w: float, h: float) -> Column:
    """The box around points (x, y), wider by a share on each side, within the image."""
    x, y = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    b = box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))
    return clip(pad(b, width(b) * share, height(b) * share), w, h)


def confident_rectangle(points: Column, least: float) -> Column:
    """Width, height and area around the points (x, y, confidence) over least; zeros without any."""
    good = F.filter(points, lambda p: F.get(p, F.lit(2)) > least)
    side = lambda k: F.array_max(F.transform(good, lambda p: F.get(p, F.lit(k)))) - F.array_min(F.transform(good, lambda p: F.get(p, F.lit(k))))
    w, h = F.coalesce(side(0), F.lit(0.0)), F.coalesce(side(1), F.lit(0.0))
    return F.struct(w.alias("w"), h.alias("h"), (w * h).alias("area"))


def in_image(points: Column, w: float, h: float) -> Column:
    """How many points lie in the image, its right and bottom edge excluded."""
    x, y = (lambda p: F.get(p, F.lit(0))), (lambda p: F.get(p, F.lit(1)))
    return F.size(F.filter(points, lambda p: (x(p) >= 0) & (x(p) < w) & (y(p) >= 0) & (y(p) < h)))


def project(p: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """A camera-space point in pixels; null unless it is before the camera."""
    x, y, z = (F.get(p, F.lit(i)) for i in range(3))
    return F.when(z > 1e-6, F.array(F.try_divide(fx * x, z) + cx, F.try_divide(fy * y, z) + cy))


def working_size(w: Column, h: Column, area: int = 384 * 512, step: int = 8) -> Column:
    """The size of about that area in the same shape, whole steps."""
    k = F.sqrt(F.lit(float(area)) / (w * h))
    whole = lambda v: v.cast("int") - v.cast("int") % step
    return F.struct(whole(w * k).alias("w"), whole(h * k).alias("h"))


def crop_point(x: Column, y: Column, cx: Column, cy: Column, scale: Column, size: float) -> Column:
    """A pixel, counted from 1, in the crop around a centre: whole pixels, counted from 1 again."""
    h = 200 * scale
    to = lambda v, c: (size * (v - 1 - c) / h + size * 0.5).cast("int") + 1
    return F.struct(to(x, cx).alias("x"), to(y, cy).alias("y"))


def flipped(points: Column, order: list[int], w: float) -> Column:
    """Points mirrored in an image of width w, with left and right ones exchanged by an order."""
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(F.transform(F.array(F.get(points, i)), lambda p: F.concat(F.array(w - 1 - F.get(p, F.lit(0))), F.slice(p, 2, F.size(p) - 1))), F.lit(0)))
