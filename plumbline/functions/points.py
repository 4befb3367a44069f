"""Points, cameras and interpolation between anchors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import rotation as R
from plumbline.functions.boxes import box


def any_nonzero(x: Column) -> Column:
    return F.exists(x, lambda v: v != 0)


def lerp_between(i: Column, n: Column, a: Column, b: Column, middle: Column | None = None, at: Column | None = None) -> Column:
    """Value i of n from a to b in equal steps, by way of middle at place at if given; a where n is 1."""
    if middle is None:
        return a + (b - a) * F.coalesce(F.try_divide(i.cast("double"), n - 1), F.lit(0.0))
    left = a + (middle - a) * F.coalesce(F.try_divide(i.cast("double"), at), F.lit(0.0))
    right = middle + (b - middle) * F.coalesce(F.try_divide((i - at).cast("double"), n - 1 - at), F.lit(0.0))
    return F.when(i < at, left).otherwise(right)


def slerp_short(a: Column, b: Column, t: Column) -> Column:
    """Between unit quaternions the shorter way; where they are within 0.01 of each other along a line, made unit again."""

    def between(ab: Column) -> Column:
        p, turn = ab["a"], R.dot(ab["a"], ab["b"], 4)
        q, cosine = R.scale(ab["b"], F.when(turn < 0, -1.0).otherwise(1.0), 4), F.least(F.abs(turn), F.lit(1.0))
        angle = F.acos(cosine)
        near = 1 - cosine < 0.01
        u = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
        v = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle))
        return R.unit(R.plus(R.scale(p, u, 4), R.scale(q, v, 4), 4), 4)

    return R.bind(F.struct(a.alias("a"), b.alias("b")), between)


def anchored(value: Column, anchor: Column, rest: float = 0.1) -> Column:
    """The value where a frame is an anchor, else a constant."""
    return F.when(anchor, value).otherwise(F.lit(rest))


def camera_to_world(r: Column, t: Column, root: Column, trans: Column) -> Column:
    """Where a body with its root joint at root and moved by trans stands in the world: R root + t + (trans - root)."""
    return R.plus(R.plus(R.mat_vec(r, root), t), R.minus(trans, root))


def scaled_box(points: Column, share: float, w: int, h: int) -> Column:
    """The box around points, grown by a share about its middle, inside the image, in whole pixels; sides of at least 1."""
    x, y = F.transform(points, lambda p: F.get(p, 0)), F.transform(points, lambda p: F.get(p, 1))

    def side(values: Column, most: int) -> tuple[Column, Column]:
        lo, hi = F.array_min(values), F.array_max(values)
        half, middle = (hi - lo) / 2 * (1 + share), (lo + hi) / 2
        low = F.least(F.greatest(middle - half, F.lit(0.0)), F.lit(float(most - 1))).cast("int")
        return low, F.greatest(F.least(F.greatest(middle + half, F.lit(0.0)), F.lit(float(most))).cast("int"), low + 1)

    (left, right), (top, bottom) = side(x, w), side(y, h)
    return box(left, top, right, bottom)


def guessed_camera(w: Column, h: Column, diagonal: bool = False) -> Column:
    """A focal length of the longer side, or of the diagonal, and the image's middle."""
    focal = F.sqrt(w * w + h * h) if diagonal else F.greatest(w, h).cast("double")
    return F.struct(focal.alias("focal"), (w / 2).alias("cx"), (h / 2).alias("cy"))


def remapped(points: Column, order: list[int]) -> Column:
    """The points in another order of joints."""
    return F.array(*(F.get(points, i) for i in order))


def lower_keys(m: Column) -> Column:
    return F.transform_keys(m, lambda k, _: F.lower(k))
