"""Algebra of boolean series that share their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(masks: list[DataFrame], keys: list[str], how: str = "and", mask: str = "mask") -> DataFrame:
    """One mask by key: all ("and") or any ("or"). Every key has to be in every mask, else the query raises."""
    if how not in ("and", "or") or not masks:
        raise ValueError("at least one mask, combined by 'and' or 'or'")
    whole = reduce(DataFrame.unionByName, (m.select(*keys, mask, F.lit(i).alias("__mask")) for i, m in enumerate(masks)))
    f = F.bool_and if how == "and" else F.bool_or
    made = whole.groupBy(*keys).agg(f(mask).alias(mask), F.count_distinct("__mask").alias("__n"), F.count("*").alias("__rows"))
    fits = (F.col("__n") == len(masks)) & (F.col("__rows") == len(masks))
    return made.select(*keys, F.when(fits, F.col(mask)).otherwise(F.raise_error(F.lit("masks differ in their keys")).cast("boolean")).alias(mask))


def stats(masks: DataFrame, by: list[str], mask: str = "mask", of: DataFrame | None = None) -> DataFrame:
    """length, num_true and num_false of each series; of the series named in of, if it is given, zeros for those without rows."""
    counts = masks.groupBy(*by).agg(F.count("*").alias("length"), F.count_if(F.col(mask)).alias("num_true"), F.count_if(~F.col(mask)).alias("num_false"))
    return counts if of is None else of.select(*by).distinct().join(counts, by, "left").na.fill(0, ["length", "num_true", "num_false"])


def missing(df: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Of all frames those that df lacks."""
    return frames.join(df.select(*keys).distinct(), keys, "left_anti")
