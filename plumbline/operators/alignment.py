"""Alignment of point sets, and robust scale: sums in Spark, a 3 x 3 decomposition a group.

A group's points are never gathered: weighted sums of products hold all that a fit needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIT = "scale double, r array<array<double>>, t array<double>"


def sums(df: DataFrame, by: list[str], x: str, y: str, weight: Column | None = None) -> DataFrame:
    """Sums over the pairs (x, y) of each group: weights, points, products, squares."""
    w = F.lit(1.0) if weight is None else weight
    a, b = ([F.get(F.col(c), F.lit(i)) for i in range(3)] for c in (x, y))
    total = lambda v: F.sum(w * v)
    return df.groupBy(*by).agg(
        F.sum(w).alias("w"), F.array(*map(total, a)).alias("x"), F.array(*map(total, b)).alias("y"),
        F.array(*(total(q * p) for q in b for p in a)).alias("yx"), total(a[0] * a[0] + a[1] * a[1] + a[2] * a[2]).alias("xx"),
    )


def fit(moments: DataFrame, by: list[str], scaled: bool = True) -> DataFrame:
    """The similarity y = scale r x + t nearest to each group's pairs; scale is 1 if not scaled.

    Groups without weight or spread have the turn of their decomposition and scale 1.
    """
    columns = [moments.schema[c] for c in by]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns), FIT])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            w, x, y, yx, xx = (np.array(batch.column(c).to_pylist(), float).reshape(len(batch), -1) for c in ("w", "x", "y", "yx", "xx"))
            w = np.where(w > 0, w, 1.0)
            mx, my = x / w, y / w
            cov = (yx / w).reshape(-1, 3, 3) - my[:, :, None] * mx[:, None, :]
            u, d, vt = np.linalg.svd(np.nan_to_num(cov))
            turn = np.ones((len(w), 3))
            turn[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
            r = (u * turn[:, None, :]) @ vt
            spread = (xx / w)[:, 0] - (mx * mx).sum(axis=1)
            s = np.where(spread > 1e-12, (d * turn).sum(axis=1) / np.maximum(spread, 1e-12), 1.0) if scaled else np.ones(len(w))
            t = my - s[:, None] * (r @ mx[:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(s), pa.array(r.tolist(), pa.list_(pa.list_(pa.float64()))), pa.array(t.tolist(), pa.list_(pa.float64()))], [*by, "scale", "r", "t"])

    return moments.select(*by, "w", "x", "y", "yx", "xx").mapInArrow(run, schema)


def applied(x: Column) -> Column:
    """scale r x + t of a point, by the columns of a fit."""
    row = lambda i: sum((F.get(F.get(F.col("r"), F.lit(i)), F.lit(j)) * F.get(x, F.lit(j)) for j in range(3)), F.lit(0.0))
    return F.array(*(F.col("scale") * row(i) + F.get(F.col("t"), F.lit(i)) for i in range(3)))


def align(df: DataFrame, by: list[str], x: str, y: str, scaled: bool = True, weight: Column | None = None, fit_on: Column | None = None, name: str = "aligned") -> DataFrame:
    """df with x moved onto y by its group's fit, which may rest on some of the rows alone (fit_on)."""
    base = df if fit_on is None else df.where(fit_on)
    made = fit(sums(base, by, x, y, weight), by, scaled)
    return df.join(made, by, "left").withColumn(name, applied(F.col(x))).drop("scale", "r", "t")


def trimmed_median_ratio(df: DataFrame, by: list[str], top: Column, bottom: Column, near: float, far: float, rounds: int = 10) -> DataFrame:
    """The median of top / bottom where top lies in (near, far), then again and again where bottom by the scale is in (0, far).

    One shuffle: all rounds are windows over the same groups, so a key has to fit a task. scale.trimmed_ratio takes keys of any size.
    """
    w = Window.partitionBy(*by)
    rows = df.select(*by, F.try_divide(top, bottom).alias("ratio"), top.cast("double").alias("top"), bottom.cast("double").alias("bottom")).where(~F.isnan("ratio") & F.col("ratio").isNotNull())
    rows = rows.withColumn("scale", F.median(F.when((F.col("top") > near) & (F.col("top") < far), F.col("ratio"))).over(w))
    for _ in range(rounds):
        scaled = F.col("bottom") * F.col("scale")
        rows = rows.withColumn("scale", F.median(F.when((scaled > 0) & (scaled < far) & (F.col("top") > near) & (F.col("top") < far), F.col("ratio"))).over(w))
    return rows.groupBy(*by).agg(F.first("scale").alias("scale"), F.count("*").alias("n"))


def robust_scale(df: DataFrame, by: list[str], top: Column, bottom: Column, start: Column, sigma: float = 1.0, rounds: int = 8) -> DataFrame:
    """The scale s with the least Geman-McClure loss of top - s bottom, from a start, by reweighted least squares.

    For keys that fit a task; scale.reweighted and scale.descended take keys of any size.
    """
    w = Window.partitionBy(*by)
    rows = df.select(*by, top.cast("double").alias("top"), bottom.cast("double").alias("bottom"), start.cast("double").alias("scale"))
    for _ in range(rounds):
        error = F.col("top") - F.col("scale") * F.col("bottom")
        weight = F.pow(sigma**2 / (sigma**2 + error * error), F.lit(2.0))
        rows = rows.withColumn("scale", F.coalesce(F.try_divide(F.sum(weight * F.col("top") * F.col("bottom")).over(w), F.sum(weight * F.col("bottom") * F.col("bottom")).over(w)), F.col("scale")))
    return rows.groupBy(*by).agg(F.first("scale").alias("scale"), F.count("*").alias("n"))


def geman_mcclure(x: Column, sigma: float) -> Column:
    return sigma**2 * x * x / (sigma**2 + x * x)


def gaussian_sums(df: DataFrame, by: str, vector: str, dimension: int) -> DataFrame:
    """Number, sum and products of each group's vectors; a task hands on one row a group."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in it:
            keys = np.array(batch.column("k").to_pylist(), object)
            x = np.array(batch.column("v").to_pylist(), float).reshape(-1, dimension)
            for k in set(keys.tolist()):
                mine = x[keys == k]
                n, s, p = held.get(k, (0, 0.0, 0.0))
                held[k] = (n + len(mine), s + mine.sum(axis=0), p + mine.T @ mine)
        for k, (n, s, p) in held.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64()), "m": pa.array([np.concatenate([s, p.ravel()]).tolist()], pa.list_(pa.float64()))})

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        m = np.array(table.column("m").to_pylist()).sum(axis=0)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "m": pa.array([m.tolist()], pa.list_(pa.float64()))})

    rows = df.where(F.col(vector).isNotNull() & F.col(by).isNotNull()).select(F.col(by).cast("long").alias("k"), F.col(vector).alias("v"))
    return rows.mapInArrow(part, "k long, n long, m array<double>").groupBy("k").applyInArrow(whole, "k long, n long, m array<double>")


def frechet(a: tuple[int, list[float]], b: tuple[int, list[float]], dimension: int) -> float:
    """The distance of two normal distributions, from (n, sums)."""
    out = []
    for n, m in (a, b):
        m = np.array(m)
        mean, products = m[:dimension] / n, m[dimension:].reshape(dimension, dimension)
        out.append((mean, (products - n * np.outer(mean, mean)) / max(1, n - 1)))
    (ma, ca), (mb, cb) = out
    values, vectors = np.linalg.eigh(ca)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ cb @ root), 0)).sum()
    return float((ma - mb) @ (ma - mb) + np.trace(ca) + np.trace(cb) - 2 * cross)
