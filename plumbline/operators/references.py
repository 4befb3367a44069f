"""Keys that have to be known: checks inside a plan, and lookups with a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import asof


def known_only(df: DataFrame, known: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df unchanged, if all its keys are in known; otherwise what reads it fails, with the key's name.

    Nothing runs until the result is read, and then in one pass: the check is part of the plan. A null key is unknown.
    """
    found = df.join(known.select(*keys).distinct().withColumn("__known", F.lit(True)), keys, "left")
    wrong = F.raise_error(F.concat(F.lit(f"{what}: no "), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})))
    return found.where(F.when(F.col("__known"), True).otherwise(wrong)).select(*df.columns)


def strict_asof(q: DataFrame, t: DataFrame, by: list[str], streams: DataFrame | None = None, what: str = "stream is not available", **options) -> DataFrame:
    """asof_join that refuses a query for a key that has no facts at all, or is not in streams."""
    return asof.asof_join(known_only(q, t if streams is None else streams, by, what), t, by, **options)


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], **defaults: Column) -> DataFrame:
    """df with columns of a table whose keys are unique, and with their defaults where it has no such key.

    A row of the table that is there keeps its nulls.
    """
    held = df.join(table.select(*keys, F.struct(*defaults).alias("__v")), keys, "left")
    return held.select(*df.columns, *(F.when(F.col("__v").isNotNull(), F.col(f"__v.{c}")).otherwise(d).alias(c) for c, d in defaults.items()))
