"""Errors of points over frames: per-joint, aligned, acceleration, jitter, contact, paths.

Points are arrays of (x, y, z); a sequence's frames are ordered by a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(p, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def length(p: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(p, lambda a: a * a), F.lit(0.0), lambda s, x: s + x))


def mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values).cast("double"))


def joint_error(truth: Column, found: Column) -> Column:
    """Mean distance of joints that belong together."""
    return mean(F.zip_with(truth, found, distance))


def centred(points: Column, roots: list[int]) -> Column:
    """Points less the mean of the root joints."""
    root = F.array(*(sum((F.get(F.get(points, F.lit(r)), F.lit(k)) for r in roots), F.lit(0.0)) / len(roots) for k in range(3)))
    bound = F.array(F.struct(points.alias("p"), root.alias("r")))
    return F.get(F.transform(bound, lambda b: F.transform(b["p"], lambda p: F.zip_with(p, b["r"], lambda a, c: a - c))), F.lit(0))


def _combined(points: list[tuple[float, Column]]) -> Column:
    """A sum of point sets with factors, point by point."""
    (k, out), *rest = points
    out = F.transform(out, lambda p: F.transform(p, lambda x: x * k))
    for factor, other in rest:
        out = F.zip_with(out, other, _adding(factor))
    return out


def _adding(factor: float):
    return lambda p, q: F.zip_with(p, q, lambda a, b: a + b * factor)


def _ordered(by: list[str], at: str) -> Window:
    return Window.partitionBy(*by).orderBy(at)


def velocity(df: DataFrame, by: list[str], at: str, points: str, name: str = "velocity") -> DataFrame:
    """Mean length of the first difference; null at a sequence's first frame."""
    back = F.lag(points).over(_ordered(by, at))
    return df.withColumn(name, mean(F.transform(_combined([(1.0, F.col(points)), (-1.0, back)]), length)))


def acceleration(points: str, by: list[str], at: str) -> Column:
    w = _ordered(by, at)
    return _combined([(1.0, F.lag(points).over(w)), (-2.0, F.col(points)), (1.0, F.lead(points).over(w))])


def acceleration_error(df: DataFrame, by: list[str], at: str, truth: str, found: str, visible: str | None = None, name: str = "accel_error", factor: float = 1.0) -> DataFrame:
    """Mean difference of second differences; null at the two ends and next to a frame that is not visible."""
    w = _ordered(by, at)
    out = df.withColumn("__t", acceleration(truth, by, at)).withColumn("__f", acceleration(found, by, at))
    value = joint_error(F.col("__t"), F.col("__f")) * factor
    if visible:
        value = F.when(F.lag(visible).over(w) & F.col(visible) & F.lead(visible).over(w), value)
    return out.withColumn(name, value).drop("__t", "__f")


def jitter(df: DataFrame, by: list[str], at: str, points: str, fps: float = 30.0, joints: int = 24, name: str = "jitter") -> DataFrame:
    """Mean length of the third difference by the cube of the frame rate, of the first joints, in tenths."""
    w = _ordered(by, at)
    third = _combined([(1.0, F.col(points)), (-3.0, F.lag(points, 1).over(w)), (3.0, F.lag(points, 2).over(w)), (-1.0, F.lag(points, 3).over(w))])
    return df.withColumn(name, mean(F.transform(F.slice(third, 1, joints), length)) * fps**3 / 10)


def sliding(df: DataFrame, by: list[str], at: str, truth: str, found: str, threshold: float, name: str = "sliding") -> DataFrame:
    """Mean displacement of the points that stand still in truth; null without one."""
    w = _ordered(by, at)
    out = df.withColumn("__t", F.lag(truth).over(w)).withColumn("__f", F.lag(found).over(w))
    moves = F.arrays_zip(F.zip_with(truth, "__t", distance).alias("t"), F.zip_with(found, "__f", distance).alias("f"))
    still = F.transform(F.filter(moves, lambda m: m["t"] < threshold), lambda m: m["f"])
    return out.withColumn(name, mean(still)).drop("__t", "__f")


def path_length(df: DataFrame, by: list[str], at: str, point: str, name: str = "path_length") -> DataFrame:
    """The way that a point goes in each sequence."""
    back = F.lag(point).over(_ordered(by, at))
    return df.withColumn("__d", distance(F.col(point), back)).groupBy(*by).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias(name))


def report(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means of each sequence and, under a null key, of all frames together, not of the means."""
    return df.rollup(*by).agg(F.count("*").alias("frames"), *(F.avg(v).alias(v) for v in values))


def report_lines(df: DataFrame, sequence: str, values: list[str], title: str) -> DataFrame:
    """sequence, line: a line for each sequence with its means, and one with the title, the names and all frames' means (sequence is null)."""
    sets = df.groupingSets([[sequence], []], sequence).agg(F.grouping(sequence).alias("__all"), *(F.avg(v).alias(v) for v in values))
    own = F.concat_ws(" ", F.col(sequence).cast("string"), *(F.format_string("%.4f", v) for v in values))
    names = " ".join(f"{v.upper()}," for v in values)
    total = F.concat_ws(" ", F.lit(title), F.lit(names), *(F.format_string("%.2f", v) for v in values))
    return sets.select(sequence, F.when(F.col("__all") == 1, total).otherwise(own).alias("line"))
