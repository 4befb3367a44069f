"""Connected components over a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links (u, v)."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        for end in (u, v):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v) other than roots; root is the least node it reaches.

    Alternates large and small stars: each node's larger, then smaller neighbours are hung
    on the least one it knows, until no link changes. Links stay in the shared folder
    between rounds. A node with very many neighbours is met by a join, which
    adaptive execution splits, never by a window or list.
    """
    spark = links.sparkSession
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = written(links)
    seen = _digest(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = _digest(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")) if seen[0] else spark.createDataFrame([], "node long, root long")


def _digest(links: DataFrame) -> tuple:
    """A count and a sum that tell whether two sets of links differ."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
