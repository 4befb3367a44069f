"""Gather, scatter and reduce by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.scale import written


def upsert(base: DataFrame, new: DataFrame, keys: list[str], value: str, only_missing: Column | None = None) -> DataFrame:
    """base with the values of new where there are any; only_missing: and where base fulfils it."""
    held = base.join(new.select(*keys, F.col(value).alias("__new")), keys, "left")
    made = F.coalesce("__new", value)
    if only_missing is not None:
        made = F.when(only_missing, made).otherwise(F.col(value))
    return held.withColumn(value, made).drop("__new")


def reduce_to(data: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """For each different key the sum of data's values under it, 0 without any."""
    sums = data.groupBy(key).agg(F.sum(value).alias(value))
    return keys.select(key).distinct().join(sums, key, "left").select(key, F.coalesce(value, F.lit(0.0)).alias(value))


def neighbours(df: DataFrame, key: str, offsets: list[int]) -> DataFrame:
    """Pairs (key, other) of rows whose keys are so far apart, by an equality join."""
    wanted = df.select(key, F.explode(F.array(*map(F.lit, offsets))).alias("__o")).select(key, (F.col(key) + F.col("__o")).alias("other"))
    return wanted.join(df.select(F.col(key).alias("other")), "other", "left_semi").select(key, "other")


def placed(df: DataFrame, order: str | Column, name: str = "place") -> DataFrame:
    """df with each row's place in an order, from 1; rows are sorted by ranges, and a range begins where those before it end.

    Rows that are equal in the order have places in any order. Rows are written once, as ranges are drawn from a sample.
    """
    rows = written(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    # a row a range
    before = rows.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__n", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return rows.withColumn("__r", inside).join(F.broadcast(before), "__p").withColumn(name, F.col("__r") + F.col("__n")).drop("__p", "__r", "__n")


def by_position(left: DataFrame, right: DataFrame, order_left: str | Column, order_right: str | Column) -> DataFrame:
    """Rows of two tables that have the same place in order."""
    return placed(left, order_left, "__i").join(placed(right, order_right, "__i"), "__i").drop("__i")


def nearest_track(df: DataFrame, by: list[str], track: str, depth: Column, total: Column, share: float = 0.8) -> DataFrame:
    """Of the tracks that cover a share of a sequence's frames the one of least mean depth."""
    tracks = df.groupBy(*by, track).agg(F.avg(depth).alias("__d"), F.count("*").alias("__n"), F.max(total).alias("__t"))
    return tracks.where(F.col("__n") >= share * F.col("__t")).groupBy(*by).agg(F.min_by(track, F.struct("__d", track)).alias(track), F.count("*").alias("candidates"))


def frame_distance(df: DataFrame, by: list[str], flow: Column, weight: Column, valid: Column, least: float = 0.75) -> DataFrame:
    """Weighted mean flow of the valid points; 1000 where too few are valid."""
    mean = F.try_divide(F.sum(F.when(valid, flow * weight)), F.sum(F.when(valid, weight)))
    return df.groupBy(*by).agg(F.when(F.avg(valid.cast("double")) < least, 1000.0).otherwise(mean).alias("distance"))


def vertex_normals(faces: DataFrame, mesh: str = "mesh", last: str | None = None) -> DataFrame:
    """mesh, vertex, normal from faces (mesh, i, j, k and points a, b, c): the unit sum of unit face normals.

    last: the faces' order. Then, of the faces that have a vertex at one corner (first, second or third), only the
    last counts, as when sums are assigned by index.
    """
    from plumbline.functions import rotation as R

    normal = R.unit(R.cross(R.minus(F.col("b"), F.col("a")), R.minus(F.col("c"), F.col("a"))), least=1e-5)
    rows = faces.select(mesh, *([last] if last else []), normal.alias("n"), F.posexplode(F.array("i", "j", "k")).alias("corner", "vertex"))
    if last:
        rows = rows.groupBy(mesh, "vertex", "corner").agg(F.max_by("n", last).alias("n"))
    sums = rows.groupBy(mesh, "vertex").agg(F.array(*(F.sum(R.at(F.col("n"), d)) for d in range(3))).alias("s"))
    return sums.select(mesh, "vertex", R.unit(F.col("s"), least=1e-5).alias("normal"))
