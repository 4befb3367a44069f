"""Time lookup: before, after and closest joins with tolerance, and brackets for interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("before", "after", "closest")


def last_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key: the last in the given order, as a dict keeps what was set last."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key: the first in the given order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def _neighbours(q: DataFrame, t: DataFrame, by: list[str], q_ts: str, t_ts: str, bucket: int | None, strict_left: bool) -> DataFrame:
    """q with the structs __left and __right: the rows of t around each query, an exact match in both.

    One shuffle by the keys and one sort. With bucket, a key's time is cut
    into spans that are sorted apart, so a key with most of the rows is spread
    over tasks; what a span has to know of those before and after it is one row a span.
    """
    value = F.struct(F.col(t_ts).alias("ts"), *(F.col(c) for c in t.columns if c not in by and c != t_ts))
    rows = q.select(*by, F.struct(*q.columns).alias("__q"), F.col(q_ts).cast("long").alias("__ts")).withColumn("__t", F.lit(None).cast(t.select(value.alias("v")).schema["v"].dataType))
    facts = t.select(*by, F.lit(None).cast(rows.schema["__q"].dataType).alias("__q"), F.col(t_ts).cast("long").alias("__ts"), value.alias("__t"))
    both = rows.unionByName(facts)
    keys = list(by)
    if bucket:
        both = both.withColumn("__span", F.floor(F.col("__ts") / bucket))
        keys.append("__span")
    fact_first = F.when(F.col("__t").isNull(), 1).otherwise(0)
    # an exact match lies on both sides, unless the left has to be strictly before
    back = Window.partitionBy(*keys).orderBy("__ts", fact_first.desc() if strict_left else fact_first).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("__ts", fact_first.desc()).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("__left", F.last("__t", True).over(back)).withColumn("__right", F.first("__t", True).over(ahead))
    if bucket:
        spans = both.where(F.col("__t").isNotNull()).groupBy(*keys).agg(F.max_by("__t", "__ts").alias("__end"), F.min_by("__t", "__ts").alias("__begin"))
        spans = both.where(F.col("__t").isNull()).select(*keys).distinct().join(spans, keys, "full")
        order = Window.partitionBy(*by).orderBy("__span")
        spans = spans.select(
            *keys,
            F.last("__end", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
            F.first("__begin", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
        )
        found = found.join(spans, keys, "left").withColumn("__left", F.coalesce("__left", "__before")).withColumn("__right", F.coalesce("__right", "__after"))
    return found.where(F.col("__q").isNotNull()).select("__q.*", "__ts", "__left", "__right")


def asof_join(q: DataFrame, t: DataFrame, by: list[str], q_ts: str = "ts", t_ts: str = "ts", mode: str = "closest", tolerance: int | None = None, bucket: int | None = None) -> DataFrame:
    """Each row of q with match (a struct of t's columns) and delta, its time less the match's.

    Times are whole numbers; rows of t are unique by key and time (see last_wins). An exact
    match wins in every mode; of two equally close the earlier. Beyond the
    tolerance, itself included, or without a candidate both are null. A tolerance of zero
    is an equality join.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if tolerance == 0:
        value = F.struct(F.col(t_ts).alias("ts"), *(F.col(c) for c in t.columns if c not in by and c != t_ts))
        right = t.select(*(F.col(c).alias(f"__{c}") for c in by), F.col(t_ts).cast("long").alias("__t"), value.alias("match"))
        on = [F.col(c) == F.col(f"__{c}") for c in by] + [F.col(q_ts).cast("long") == F.col("__t")]
        return q.join(right, on, "left").select(*q.columns, "match", F.when(F.col("match").isNotNull(), 0).cast("long").alias("delta"))
    found = _neighbours(q, t, by, q_ts, t_ts, bucket, strict_left=False)
    left, right = F.col("__ts") - F.col("__left.ts"), F.col("__right.ts") - F.col("__ts")
    if mode == "before":
        match = F.col("__left")
    elif mode == "after":
        match = F.col("__right")
    else:
        match = F.when(left.isNull() | (left > right), F.col("__right")).otherwise(F.col("__left"))
        match = F.coalesce(match, "__left")
    found = found.withColumn("match", match).withColumn("delta", (F.col("__ts") - F.col("match.ts")).cast("long"))
    if tolerance is not None:
        near = F.abs("delta") <= tolerance
        found = found.withColumn("match", F.when(near, F.col("match"))).withColumn("delta", F.when(near, F.col("delta")))
    return found.select(*q.columns, "match", "delta")


def bracket(q: DataFrame, t: DataFrame, by: list[str], q_ts: str = "ts", t_ts: str = "ts", bucket: int | None = None) -> DataFrame:
    """Each row of q with lower (strictly before), upper (at or after) and alpha between them.

    At an exact match alpha is 1; beyond either end it is null.
    """
    found = _neighbours(q, t, by, q_ts, t_ts, bucket, strict_left=True)
    alpha = F.try_divide((F.col("__ts") - F.col("__left.ts")).cast("double"), (F.col("__right.ts") - F.col("__left.ts")).cast("double"))
    return found.select(*q.columns, F.col("__left").alias("lower"), F.col("__right").alias("upper"), alpha.alias("alpha"))


def interval_join(q: DataFrame, clips: DataFrame, at: str, start: str, end: str, order: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Each row of q with clip, the first in order of those with start <= at < end, or null.

    Both sides are dealt by spans of time, so the join is an equality join however
    many clips there are; a clip enters each span that it touches. A width near the usual
    length of clips keeps that to a few rows. A clip depends on key and time alone, so it is found once for each
    different pair of them and joined back; rows of q are taken as they are, repeated or not.
    """
    by = by or []
    value = F.struct(*(F.col(c) for c in clips.columns if c not in by))
    right = clips.where(F.col(end) > F.col(start)).select(*(F.col(c).alias(f"__{c}") for c in by), value.alias("clip"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))).alias("__span"))
    times = q.select(*by, at).where(F.col(at).isNotNull()).distinct()
    on = [F.floor(F.col(at) / width) == F.col("__span"), F.col(at) >= F.col(f"clip.{start}"), F.col(at) < F.col(f"clip.{end}")] + [F.col(c) == F.col(f"__{c}") for c in by]
    found = times.join(right, on).groupBy(*by, at).agg(F.min_by("clip", f"clip.{order}").alias("clip"))
    return q.join(found, [*by, at], "left").select(*q.columns, "clip")
