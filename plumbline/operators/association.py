"""Times of two series matched one to one: nearest first, within a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scale import written


def matched(truth: DataFrame, found: DataFrame, by: list[str], ts: str, bound: int, offset: int = 0) -> DataFrame:
    """by, truth, found: pairs of times at most bound apart, each time in one pair at most. offset is added to found's times.

    The nearest pair is matched first, of equally near ones that of the earlier truth, then of the earlier found, and so on
    with what is left. It is done in rounds: all pairs whose two times are each other's nearest are settled together, which gives the
    same, as none of them can lose a time to another. Times are whole numbers; a repeated time counts once, rows without a key or time not at all.

    Both sides are dealt by spans of the bound's length, so candidates come from an equality join.
    """
    one = lambda df, name, c: df.select(*by, c.cast("long").alias(name)).dropna().distinct()
    t, f = one(truth, "truth", F.col(ts)), one(found, "found", F.col(ts) + offset)
    span = lambda c: F.floor(F.col(c) / max(bound, 1))
    near = t.withColumn("__s", F.explode(F.array(span("truth") - 1, span("truth"), span("truth") + 1)))
    gap = F.abs(F.col("truth") - F.col("found"))
    left = written(near.join(f.withColumn("__s", span("found")), [*by, "__s"]).where(gap <= bound).select(*by, "truth", "found", gap.alias("gap")))
    settled = None
    order = F.struct("gap", "truth", "found")
    while left.limit(1).count():
        best = [left.groupBy(*by, side).agg(F.min(order).alias("o")).select(*by, "o.truth", "o.found") for side in ("truth", "found")]
        new = written(best[0].join(best[1], [*by, "truth", "found"]))
        settled = new if settled is None else settled.unionByName(new)
        left = written(left.join(new.select(*by, "truth"), [*by, "truth"], "left_anti").join(new.select(*by, "found"), [*by, "found"], "left_anti"))
    settled = left.select(*by, "truth", "found") if settled is None else settled
    return settled.select(*by, "truth", (F.col("found") - offset).alias("found"))
