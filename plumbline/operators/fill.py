"""Gap filling between the nearest valid rows, by lines and by rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import rotation


def _around(df: DataFrame, by: list[str], at: str, value: Column) -> DataFrame:
    """df with the valid (place, value) pairs at or before and at or after each row, and a key's number of valid rows."""
    w = Window.partitionBy(*by).orderBy(at)
    pair = F.when(value.isNotNull(), F.struct(F.col(at).cast("double").alias("x"), value.alias("y")))
    return (
        df.withColumn("__p", pair)
        .withColumn("__l", F.last("__p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__r", F.first("__p", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__n", F.count("__p").over(Window.partitionBy(*by)))
    )


def _weight(at: str) -> Column:
    return F.try_divide(F.col(at).cast("double") - F.col("__l.x"), F.col("__r.x") - F.col("__l.x"))


def fill_linear(df: DataFrame, by: list[str], at: str, value: str, name: str | None = None) -> DataFrame:
    """Nulls of a number between two valid rows on the line between them, at the ends as the nearest.

    A key with fewer than two valid rows keeps its nulls.
    """
    found = _around(df, by, at, F.col(value))
    line = F.col("__l.y") + (F.col("__r.y") - F.col("__l.y")) * _weight(at)
    made = F.when(F.col("__n") < 2, F.col(value)).otherwise(F.coalesce(F.col(value), line, F.col("__l.y"), F.col("__r.y")))
    return found.withColumn(name or value, made).drop("__p", "__l", "__r", "__n")


def fill_vectors(df: DataFrame, by: list[str], at: str, value: str, name: str | None = None) -> DataFrame:
    """The same for an array of numbers, each component on its own line."""
    found = _around(df, by, at, F.col(value))
    w = _weight(at)
    line = F.zip_with("__l.y", "__r.y", lambda a, b: a + (b - a) * w)
    made = F.when(F.col("__n") < 2, F.col(value)).otherwise(F.coalesce(F.col(value), F.when(w.isNotNull(), line), F.col("__l.y"), F.col("__r.y")))
    return found.withColumn(name or value, made).drop("__p", "__l", "__r", "__n")


def fill_rotations(df: DataFrame, by: list[str], at: str, value: str, name: str | None = None) -> DataFrame:
    """The same for quaternions (wxyz), along the shortest arc."""
    found = _around(df, by, at, F.col(value))
    w = _weight(at)
    arc = F.when(w.isNotNull(), rotation.slerp(F.col("__l.y"), F.col("__r.y"), w))
    made = F.when(F.col("__n") < 2, F.col(value)).otherwise(F.coalesce(F.col(value), arc, F.col("__l.y"), F.col("__r.y")))
    return found.withColumn(name or value, made).drop("__p", "__l", "__r", "__n")


def fill_boxes(df: DataFrame, by: list[str], at: str, box: str) -> DataFrame:
    """Boxes whose numbers are all 0 from those around them: on the line between two, and at the ends on the line through the nearest two.

    A key with fewer than two boxes is left as it is.
    """
    there = F.exists(box, lambda v: v != 0)
    w = Window.partitionBy(*by, "__there").orderBy(at)
    pair = F.struct(F.col(at).cast("double").alias("x"), F.col(box).alias("y"))
    rows = df.withColumn("__there", F.coalesce(there, F.lit(False)))
    rows = rows.withColumn("__near", F.when(F.col("__there"), F.struct(pair.alias("own"), F.lag(pair).over(w).alias("before"), F.lead(pair).over(w).alias("behind"))))
    order = Window.partitionBy(*by).orderBy(at)
    rows = rows.withColumn("__l", F.last("__near", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__r", F.first("__near", True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    # two boxes that a line goes through
    a = F.when(F.col("__l").isNull(), F.col("__r.own")).when(F.col("__r").isNull(), F.col("__l.before")).otherwise(F.col("__l.own"))
    b = F.when(F.col("__l").isNull(), F.col("__r.behind")).when(F.col("__r").isNull(), F.col("__l.own")).otherwise(F.col("__r.own"))
    rows = rows.withColumn("__a", a).withColumn("__b", b)
    t = F.try_divide(F.col(at) - F.col("__a.x"), F.col("__b.x") - F.col("__a.x"))
    line = F.zip_with("__a.y", "__b.y", lambda p, q: p + (q - p) * t)
    made = F.when(F.col("__there") | F.col("__a").isNull() | F.col("__b").isNull(), F.col(box)).otherwise(line)
    return rows.withColumn(box, made).drop("__there", "__near", "__l", "__r", "__a", "__b")
