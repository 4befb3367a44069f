"""Tracks and frames: islands, windows, trims, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], frame: str = "frame", order: list[str] | None = None, min_len: int = 1) -> DataFrame:
    """Runs of frames that step by one: keys, chunk_id from 0, start, end, n.

    A repeated frame splits a run too; runs under min_len are left out, and the rest keep
    their numbers.
    """
    return islands_of(df, by, frame, order).groupBy(*by, "chunk_id").agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("n")).where(F.col("n") >= min_len)


def islands_of(df: DataFrame, by: list[str], frame: str = "frame", order: list[str] | None = None) -> DataFrame:
    """df with the chunk_id of each row's run."""
    w = Window.partitionBy(*by).orderBy(frame, *(order or []))
    step = F.col(frame) - F.lag(frame).over(w)
    return df.withColumn("__new", F.when(step != 1, 1).otherwise(0)).withColumn("chunk_id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """df with each row's place in its key, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def trim(df: DataFrame, by: list[str], order: str, valid: Column) -> DataFrame:
    """Rows from a key's first valid to its last; none of a key without."""
    w = Window.partitionBy(*by)
    at = F.when(valid, F.col(order))
    return df.withColumn("__lo", F.min(at).over(w)).withColumn("__hi", F.max(at).over(w)).where(F.col(order).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def previous_valid(df: DataFrame, by: list[str], order: str, valid: Column, name: str = "previous") -> DataFrame:
    """df with the nearest order value strictly before each row that is valid, or 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.last(F.when(valid, F.col(order)), True).over(w), F.lit(0)))


def fill_windows(df: DataFrame, by: list[str], frame: str, valid: Column, length: int = 120) -> DataFrame:
    """Windows to fill missing frames in: start at the valid frame before a gap, at most length long; the last frame is never inside."""
    w = Window.partitionBy(*by)
    gaps = previous_valid(df, by, frame, valid, "start").withColumn("__last", F.max(frame).over(w)).where(~valid)
    return gaps.groupBy(*by, "start").agg(F.least(F.max("__last"), F.col("start") + length).alias("end"), F.count("*").alias("missing"))


def vote(df: DataFrame, by: list[str], is_right: Column, counted: Column) -> DataFrame:
    """hand of each key: 1 (right) unless under half of the counted rows say so; a tie is right."""
    return df.where(counted).groupBy(*by).agg(F.when(F.avg(is_right.cast("int")) < 0.5, 0).otherwise(1).alias("hand"), F.count("*").alias("n"))


def groups_of(df: DataFrame, by: list[str], order: list[str], size: int, first: int, second: int, value: str) -> DataFrame:
    """Every size rows one row: start and end from two of them; an incomplete tail is left out."""
    rows = numbered(df, by, order).withColumn("group_id", F.floor(F.col("rn") / size)).withColumn("__k", F.col("rn") % size)
    pick = lambda k: F.max(F.when(F.col("__k") == k, F.col(value)))
    return rows.groupBy(*by, "group_id").agg(pick(first).alias("start"), pick(second).alias("end"), F.count("*").alias("__n")).where(F.col("__n") == size).drop("__n")


def changes(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows at which a value begins to differ from the one before; a key's first row is one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.where("true").withColumn("__same", F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)).where("not __same").drop("__same")


def fade(frame: Column, start: Column, end: Column, length: int = 10) -> Column:
    """Weight of a clip at a frame: rising over its first frames, falling over its last; rising first where both hold."""
    into, left = frame - start, end - frame
    return F.when(into < length, into / length).when(left <= length, left / length).otherwise(1.0)


def default_track(track: Column, hand: Column) -> Column:
    """The tracker's id, or 10000 for a right and 5000 for a left hand."""
    return F.coalesce(track, F.when(hand > 0, 10_000).otherwise(5_000))


def dense(keys: DataFrame, by: list[str], end: str, frame: str = "frame") -> DataFrame:
    """All frames from 0 up to a key's end, exclusive."""
    return keys.where(F.col(end) > 0).select(*by, F.explode(F.sequence(F.lit(0), F.col(end) - 1)).alias(frame))
