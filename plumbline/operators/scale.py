"""Scales between two measures of depth, by medians and by descent, for keys of any size.

No key's rows meet in one task: each pass sums up before the shuffle and leaves one row a key, which the next
pass joins back. Rows are written once; the passes read them. Rows with a null key are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import shared_folder

#: A key's values that are sorted together.
FEW = 4096
BUCKETS = 64


def written(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def depths(df: DataFrame, by: list[str], top: Column, bottom: Column, near: float = 0.0, far: float = math.inf, mask: Column | None = None) -> DataFrame:
    """by, top, bottom where top lies in (near, far) and mask doesn't hold."""
    keep = F.lit(True) if mask is None else ~F.coalesce(mask, F.lit(False))
    rows = df.where(keep).select(*by, top.cast("double").alias("top"), bottom.cast("double").alias("bottom"))
    return rows.where((F.col("top") > near) & (F.col("top") < far) & F.col("bottom").isNotNull() & ~F.isnan("bottom"))


def medians(df: DataFrame, by: list[str], value: str, few: int = FEW) -> DataFrame:
    """by, median, n: exact. Keys with more than few values are narrowed down first.

    A pass counts a key's values in buckets between its bounds. Where the middle lies in one bucket, the next pass
    takes that; between two, the median is between their values. Nulls and not-a-numbers don't count.
    """
    df = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, value)
    v, lo, hi = F.col(value), F.col("lo"), F.col("hi")
    state = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    state = written(state.select("*", F.lit(0).cast("long").alias("below"), F.col("n").alias("left"), F.when(lo == hi, lo).alias("median")))
    inside = lambda which: df.join(state.where(which).drop("median", "left"), by).where((v >= lo) & (v <= hi))
    ranks = (F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    many = F.col("median").isNull() & (F.col("left") > few)
    while state.where(many).limit(1).count():
        # by halves, as the difference of two numbers may be none; bounds too far or too near for that part only the highest value
        share = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
        share = F.when(share.isNull() | F.isnan(share), F.lit(0.0)).otherwise(share)
        bucket = F.when(v == hi, F.lit(BUCKETS - 1)).otherwise(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 2)))
        counts = inside(many).groupBy(*by, "n", "below", bucket.alias("b")).agg(F.count("*").alias("c"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        held = counts.groupBy(*by, "n", "below").agg(F.array_sort(F.collect_list(F.struct("b", "c", "lo", "hi"))).alias("bs"))  # BUCKETS rows at most
        before = F.transform("bs", lambda x, i: F.struct((F.col("below") + F.aggregate(F.slice("bs", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["c"])).alias("from"), x["c"].alias("c"), x["lo"].alias("lo"), x["hi"].alias("hi")))
        hit = held.select(*by, "n", F.filter(before, lambda x: (x["from"] <= ranks[1]) & (x["from"] + x["c"] > ranks[0])).alias("h"))
        one, two = F.get("h", F.lit(0)), F.get("h", F.lit(1))
        median = F.when(two.isNotNull(), (one["hi"] + two["lo"]) / 2).when(one["lo"] == one["hi"], one["lo"])
        narrow = hit.select(*by, one["lo"].alias("lo"), one["hi"].alias("hi"), "n", one["from"].alias("below"), one["c"].alias("left"), median.alias("median"))
        state = written(state.where(~many).unionByName(narrow))
    found = inside("median is null").groupBy(*by, "n", "below").agg(F.array_sort(F.collect_list(value)).alias("vs"))  # few values
    at = lambda r: F.get("vs", (r - F.col("below")).cast("int"))
    return found.select(*by, ((at(ranks[0]) + at(ranks[1])) / 2).alias("median"), "n").unionByName(state.where("median is not null").select(*by, "median", "n"))


def trimmed_ratio(df: DataFrame, by: list[str], top: Column, bottom: Column, near: float, far: float, rounds: int = 10, mask: Column | None = None, few: int = FEW) -> DataFrame:
    """by, scale: the median of top / bottom where top lies in (near, far), then again where bottom by the scale is in (0, far) too.

    Ends before rounds when no key's scale has changed, as none would any more.
    """
    rows = depths(df, by, top, bottom, near, far, mask).select(*by, "bottom", F.try_divide("top", "bottom").alias("ratio"))
    rows = written(rows.where("ratio is not null"))
    state = written(medians(rows, by, "ratio", few).select(*by, F.col("median").alias("scale")))
    for _ in range(rounds):
        scaled = F.col("bottom") * F.col("scale")
        new = medians(rows.join(state, by).where((scaled > 0) & (scaled < far)), by, "ratio", few)
        new = written(state.join(new, by, "left").select(*by, F.col("median").alias("scale"), (~F.col("median").eqNullSafe(F.col("scale"))).alias("moved")))
        state = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    return state


def reweighted(df: DataFrame, by: list[str], top: Column, bottom: Column, start: Column, sigma: float = 1.0, rounds: int = 8) -> DataFrame:
    """by, scale, n: the scale of least Geman-McClure loss of top - scale bottom, by reweighted least squares from a start."""
    rows = written(df.select(*by, top.cast("double").alias("top"), bottom.cast("double").alias("bottom")))
    state = written(rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn("scale", start.cast("double")))
    for _ in range(rounds):
        error = F.col("top") - F.col("scale") * F.col("bottom")
        weight = F.pow(sigma**2 / (sigma**2 + error * error), F.lit(2.0))
        sums = rows.join(state, by).groupBy(*by, "n", "scale").agg(F.sum(weight * F.col("top") * F.col("bottom")).alias("a"), F.sum(weight * F.col("bottom") * F.col("bottom")).alias("b"))
        state = written(sums.select(*by, "n", F.coalesce(F.try_divide("a", "b"), F.col("scale")).alias("scale")))
    return state.select(*by, "scale", "n")


def descended(df: DataFrame, by: list[str], top: Column, bottom: Column, start: Column | DataFrame, sigma: float = 0.5, near: float = 0.0, far: float = math.inf, mask: Column | None = None, width: float = 0.5, tolerance: float = 1e-8, points: int = 16, passes: int = 60) -> DataFrame:
    """by, scale, n: the scale s to which s bottom - top descends from a start, under the Geman-McClure loss.

    A pass sums up each key's slope of the loss at points on either side of its scale, as far as its width. The
    scale moves downhill, to the point where the slope first changes its sign, and the width becomes the distance of two points;
    without a change it moves to the end, and the width doubles. It stops when no key's width exceeds the tolerance, relative to its scale.
    start: a number, or rows (by, scale).
    """
    rows = written(depths(df, by, top, bottom, near, far, mask))
    first = rows.groupBy(*by).agg(F.count("*").alias("n"))
    first = first.join(start.select(*by, F.col("scale").cast("double").alias("scale")), by) if isinstance(start, DataFrame) else first.withColumn("scale", start.cast("double"))
    state = written(first.where("scale is not null").select(*by, "n", "scale", F.greatest(F.abs("scale"), F.lit(1.0)).alias("unit")).select("*", (F.col("unit") * width).alias("width")))
    steps = range(-points, points + 1)
    for _ in range(passes):
        open_ = F.col("width") > F.col("unit") * tolerance
        if not state.where(open_).limit(1).count():
            break

        def slope(k: int) -> Column:
            error = (F.col("scale") + F.col("width") * (k / points)) * F.col("bottom") - F.col("top")
            return F.sum(F.col("bottom") * error / F.pow(sigma**2 + error * error, F.lit(2.0)))

        sums = rows.join(state.where(open_), by).groupBy(*by, "n", "scale", "unit", "width").agg(F.array(*(slope(k) for k in steps)).alias("g"))
        here, gap = F.get("g", F.lit(points)), F.col("width") / points
        place = lambda i: F.col("scale") + (i - points) * gap
        down = F.when(here > 0, F.lit(-1)).otherwise(F.lit(1))
        # the number of gaps to the first point with a slope of the other sign, or none
        turn = F.get(F.filter(F.sequence(F.lit(1), F.lit(points)), lambda k: F.get("g", points + down * k) * down >= 0), F.lit(0))
        cut = sums.select("*", turn.alias("turn"), down.alias("down")).select("*", F.get("g", points + F.col("down") * (F.col("turn") - 1)).alias("a"), F.get("g", points + F.col("down") * F.col("turn")).alias("b"))
        inside = place(points + F.col("down") * (F.col("turn") - 1)) + F.col("down") * gap * F.col("a") / (F.col("a") - F.col("b"))
        moved = cut.select(
            *by, "n", F.when(here == 0, F.col("scale")).when(F.col("turn").isNull(), F.col("scale") + F.col("down") * F.col("width")).otherwise(inside).alias("scale"), "unit",
            F.when(here == 0, F.lit(0.0)).when(F.col("turn").isNull(), F.col("width") * 2).otherwise(gap).alias("width"),
        )
        state = written(state.where(~open_).unionByName(moved))
    return state.select(*by, "scale", "n")
