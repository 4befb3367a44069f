"""Masks of any size as run lengths: an array of runs of zeros and ones in turn, zeros first, column by column.

Masks are laid over each other by the places where their runs end, without their pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rotation import bind

def by_columns(rows: Column) -> Column:
    """The pixels of an array of rows, column by column."""

    def made(rows: Column) -> Column:
        width = F.size(F.get(rows, F.lit(0)))
        columns = F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.transform(rows, lambda r: F.get(r, c)))
        return F.when((F.size(rows) > 0) & (width > 0), F.flatten(columns)).otherwise(F.flatten(rows))

    return bind(rows, made)


def by_rows(pixels: Column, height: int) -> Column:
    """The inverse: an array of rows."""

    def made(pixels: Column) -> Column:
        width = (F.size(pixels) / height).cast("int")
        row = lambda r: F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.get(pixels, c * height + r))).otherwise(F.slice(pixels, 1, 0))
        return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), row)

    return bind(pixels, made)


def encode(pixels: Column) -> Column:
    """Run lengths of an array of booleans; a null pixel is unset."""

    def made(pixels: Column) -> Column:
        on = lambda i: F.coalesce(F.get(pixels, i), F.lit(False))
        n = F.size(pixels)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (on(i) != on(i - 1)))
        lengths = bind(starts, lambda starts: F.transform(starts, lambda s, k: F.coalesce(F.get(starts, k + 1), n) - s))
        return F.when(on(F.lit(0)), F.concat(F.array(F.lit(0)), lengths)).otherwise(lengths)

    return bind(pixels, made)


def decode(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 1, n)))


def size(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, n: a + n)


def area(runs: Column) -> Column:
    """Pixels that are set."""
    return size(F.filter(runs, lambda n, i: i % 2 == 1))


def combined(df: DataFrame, by: list[str], runs: str, least: int | None = None) -> DataFrame:
    """by, runs, n: where at least so many of a key's masks are set; 1 is the union, None (all of the n) the intersection.

    A run of ones is a step up and a step down; steps are added up by place before the shuffle, so a key has at most as many
    rows as a mask has pixels, however many masks. Masks of a key have to be of one size. Null masks don't count.
    """
    df = df.where(F.col(runs).isNotNull()).select(*by, F.col(runs).alias("__r"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at: bigint, step: int>>").alias("ends"))

    def walk(done: Column, n: Column) -> Column:
        at = done["at"] + n
        step = F.when(F.size(done["ends"]) % 2 == 1, -1).otherwise(1)
        return F.struct(at.alias("at"), F.concat(done["ends"], F.array(F.struct(at.alias("at"), step.alias("step")))).alias("ends"))

    ends = F.aggregate(bind(F.col("__r"), lambda r: r), start, walk, lambda done: done["ends"])
    # a run of zeros ends where one of ones begins, if there is one
    steps = df.select(*by, F.inline(bind(ends, lambda ends: F.filter(ends, lambda e, i: (e["step"] < 0) | (i < F.size(ends) - 1)))))
    whole = df.groupBy(*by).agg(F.count("*").alias("n"), F.max(size(F.col("__r"))).alias("__size"), F.min(size(F.col("__r"))).alias("__other"))
    whole = whole.where(F.when(F.col("__size") == F.col("__other"), True).otherwise(F.raise_error(F.concat(F.lit("masks of different sizes under the key "), F.to_json(F.struct(*by))))))
    depth = steps.groupBy(*by, "at").agg(F.sum("step").alias("step")).join(whole.select(*by, "n"), by)
    w = Window.partitionBy(*by).orderBy("at")
    depth = depth.withColumn("in", F.sum("step").over(w) >= (F.col("n") if least is None else F.lit(least)))
    turns = depth.withColumn("was", F.lag("in", 1, False).over(w)).where("in <> was").groupBy(*by).agg(F.array_sort(F.collect_list("at")).alias("__t"))
    cuts = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("__t", F.array().cast("array<long>")), F.array("__size"))
    lengths = F.transform(F.slice(cuts, 2, F.size(cuts) - 1), lambda c, i: (c - F.get(cuts, i)).cast("int"))
    lengths = F.when((F.size(cuts) > 2) & (F.element_at(lengths, -1) == 0), F.slice(lengths, 1, F.size(lengths) - 1)).otherwise(lengths)
    return whole.join(turns, by, "left").select(*by, F.when(F.col("__size") > 0, lengths).otherwise(F.array().cast("array<int>")).alias("runs"), "n")
