"""Tracks: slices, bounded samples, thresholds that widen, fits of a shift, packing of two hands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.segments import islands_of, numbered


def index_slice(df: DataFrame, by: list[str], order: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows from place start up to, not including, end of each key; either bound may be missing."""
    rows = numbered(df, by, order, "__i")
    return rows.where((F.col("__i") >= (start or 0)) & (F.lit(end is None) | (F.col("__i") < (end or 0)))).drop("__i")


def at_most(df: DataFrame, n: int, key: str) -> DataFrame:
    """All rows, or n of them that are spread evenly: those of the least hashes of key. Each task hands on n at most."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def ragged(df: DataFrame, by: list[str], value: str, visible: Column, order: str) -> DataFrame:
    """Each frame's list of what is visible, in order; empty where nothing is."""
    item = F.when(visible, F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"]).alias(value))


def islands_with(df: DataFrame, by: list[str], frame: str, carried: str) -> DataFrame:
    """islands() with what each run's first frame has."""
    return islands_of(df, by, frame).groupBy(*by, "chunk_id").agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("n"), F.min_by(carried, frame).alias(carried))


def windows_in_islands(df: DataFrame, by: list[str], frame: str, length: int) -> DataFrame:
    """df with chunk_id and window_id: windows are counted anew in each run."""
    rows = numbered(islands_of(df, by, frame), [*by, "chunk_id"], [frame], "__i")
    return rows.withColumn("window_id", F.floor(F.col("__i") / length)).drop("__i")


def padded(df: DataFrame, by: list[str], frame: str, length: int) -> DataFrame:
    """by, frame from 0 to length - 1, and valid, whether df has it."""
    keys = df.select(*by).distinct().withColumn(frame, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    return keys.join(df.select(*by, F.col(frame).cast("long")).distinct().withColumn("__valid", F.lit(True)), [*by, frame], "left").withColumn("valid", F.coalesce("__valid", F.lit(False))).drop("__valid")


def first_sight(df: DataFrame, by: list[str], frame: str) -> DataFrame:
    """df with sent: true on the first frame of each run, so what was out of sight is sent once more."""
    w = Window.partitionBy(*by).orderBy(frame)
    return df.withColumn("sent", F.coalesce(F.col(frame) - F.lag(frame).over(w) != 1, F.lit(True)))


def median_offset(df: DataFrame, by: list[str], top: Column, bottom: Column, near: float, far: float) -> DataFrame:
    """Each key's median of top - bottom where bottom lies between near and far."""
    return df.groupBy(*by).agg(F.median(F.when(bottom.between(near, far), top - bottom)).alias("offset"))


def scale_and_shift(df: DataFrame, by: list[str], x: Column, y: Column, rounds: int = 3, sigma: float = 1.0, scaled: bool = True) -> DataFrame:
    """by, scale, shift of y = scale x + shift, in rounds of sums with weights (sigma^2 / (sigma^2 + error^2))^2.

    A round sums before it shuffles, and joins one row a key; without scaled the scale is 1.
    """
    data = df.select(*by, x.cast("double").alias("__x"), y.cast("double").alias("__y"))
    weight, found = F.lit(1.0), None
    for _ in range(rounds):
        rows = data if found is None else data.join(found, by)
        if found is not None:
            error = F.col("__y") - F.col("scale") * F.col("__x") - F.col("shift")
            weight = F.pow(sigma * sigma / (sigma * sigma + error * error), F.lit(2.0))
        rows = rows.withColumn("__w", weight)
        w, a, b = F.col("__w"), F.col("__x"), F.col("__y")
        sums = rows.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * a).alias("sx"), F.sum(w * b).alias("sy"), F.sum(w * a * a).alias("xx"), F.sum(w * a * b).alias("xy"))
        slope = F.coalesce(F.try_divide(F.col("n") * F.col("xy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("xx") - F.col("sx") * F.col("sx")), F.lit(1.0)) if scaled else F.lit(1.0)
        found = sums.withColumn("scale", slope).select(*by, "scale", F.try_divide(F.col("sy") - F.col("scale") * F.col("sx"), F.col("n")).alias("shift"))
    return found


def widened(df: DataFrame, by: list[str], keyframe: str, value: Column, near: float, far: float, step: float = 0.1, most: int = 100) -> DataFrame:
    """by, keyframe, near, far: the band that was used at each keyframe.

    A keyframe without a value in its band widens it by a step on both sides until it has one, at most so often,
    and later ones go on from there. So a keyframe's band is that of the most steps any one up to it needed.
    """
    away = F.greatest(near - value, value - far, F.lit(0.0))
    needed = df.groupBy(*by, keyframe).agg(F.least(F.coalesce(F.min(F.ceil(F.round(away / step, 9))), F.lit(most)), F.lit(most)).alias("__n"))
    w = Window.partitionBy(*by).orderBy(keyframe).rowsBetween(Window.unboundedPreceding, 0)
    steps = F.max("__n").over(w)
    return needed.select(*by, keyframe, (near - step * steps).alias("near"), (far + step * steps).alias("far"))


def nearest_rotation(matrix: Column, flip: bool = True) -> Column:
    """The orthogonal matrix nearest to nine numbers in rows; with flip always a rotation."""

    @F.pandas_udf("array<double>")
    def project(m: pd.Series) -> pd.Series:
        u, _, v = np.linalg.svd(np.array(m.tolist(), float).reshape(-1, 3, 3))
        if flip:
            u[:, :, 2] *= np.sign(np.linalg.det(u @ v))[:, None]
        return pd.Series(list((u @ v).reshape(-1, 9)))

    return project(matrix)


def mean_rotation(df: DataFrame, by: list[str], matrix: str) -> DataFrame:
    """Each key's mean of matrices, made orthogonal; sums are of nine numbers, before anything is shuffled."""
    return df.groupBy(*by).agg(F.array(*(F.avg(F.get(matrix, i)) for i in range(9))).alias("__m")).select(*by, nearest_rotation(F.col("__m"), flip=False).alias(matrix))


def camera_translation(df: DataFrame, by: list[str], point: Column, ray: Column, weight: Column) -> DataFrame:
    """Each key's translation t for which points + t lie on their rays (slopes x / z, y / z), by weighted least squares.

    The normal equations are sums; the 3 x 3 system is solved by Cramer's rule.
    """
    x, y, z = (F.get(point, i) for i in range(3))
    u, v = F.get(ray, 0), F.get(ray, 1)
    w = weight * weight
    # rows (1, 0, -u) t = u z - x and (0, 1, -v) t = v z - y
    b, c = u * z - x, v * z - y
    terms = {"n": w, "u": w * u, "v": w * v, "q": w * (u * u + v * v), "b": w * b, "c": w * c, "d": -w * (u * b + v * c)}
    s = df.groupBy(*by).agg(*(F.sum(e).alias(k) for k, e in terms.items()))
    n, u, v, q, b, c, d = (F.col(k) for k in terms)
    # n t0 - u t2 = b, n t1 - v t2 = c, -u t0 - v t1 + q t2 = d
    t2 = F.try_divide(n * d + u * b + v * c, n * q - u * u - v * v)
    return s.select(*by, F.try_divide(b + u * t2, n).alias("tx"), F.try_divide(c + v * t2, n).alias("ty"), t2.alias("tz"))


def side_by_side(df: DataFrame, keys: list[str], right: Column, value: str, n: int, *more: Column) -> DataFrame:
    """keys and one list of 2 n numbers: the left hand's first, then the right's; zeros for a hand that is missing.

    Of several rows of a hand the least counts. more: further aggregates.
    """
    none = F.array_repeat(F.lit(0.0), n)
    hand = lambda is_right: F.coalesce(F.min(F.when(right == is_right, F.col(value))), none)
    return df.groupBy(*keys).agg(F.concat(hand(False), hand(True)).alias(value), *more)


def one_by_one(df: DataFrame, value: str, n: int) -> DataFrame:
    """The inverse of side_by_side: a row a hand, with is_right."""
    hands = F.array(*(F.struct(F.lit(bool(k)).alias("is_right"), F.slice(value, 1 + k * n, n).alias(value)) for k in range(2)))
    keys = [c for c in df.columns if c != value]
    return df.select(*keys, F.inline(hands))


def any_mask(df: DataFrame, by: list[str], bits: Column, name: str = "mask") -> DataFrame:
    """Masks of a key laid over each other, bit by bit."""
    return df.groupBy(*by).agg(F.bit_or(bits).alias(name))


def gathered(camera: DataFrame, chunks: DataFrame, frame: str = "frame", by: list[str] | None = None) -> DataFrame:
    """Each chunk's frames with what the camera table has for them; frames without are left out."""
    return chunks.join(camera, [*(by or []), frame])


def associated(truth: DataFrame, found: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """by, ts, truth, found at the times that both trajectories have; of several values at one time the least."""
    one = lambda df, name: df.groupBy(*by, ts).agg(F.min(value).alias(name))
    return one(truth, "truth").join(one(found, "found"), [*by, ts])
