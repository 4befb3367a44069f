"""A table of which data groups are done, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = "data_group string, done boolean"


def write_status(spark: SparkSession, path: str, status: dict[str, bool]) -> None:
    """Writes the next version beside the others; readers take none that has not its end mark, so they see the old one or the new one."""
    versions = [v for v, _ in _versions(spark, path)]
    rows = spark.createDataFrame(sorted(status.items()), STATUS)
    rows.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/version={max(versions, default=0) + 1:09d}")


def read_status(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """data_group, done of the latest whole version, if it has all expected groups; else all expected ones, not done."""
    done = [v for v, whole in _versions(spark, path) if whole]
    new = spark.createDataFrame([(g, False) for g in sorted(set(expected))], STATUS)
    if not done:
        return new
    found = spark.read.schema(STATUS).json(f"{path.rstrip('/')}/version={max(done):09d}")
    lacking = new.join(found, "data_group", "left_anti").agg(F.count("*").alias("__n"))  # one row
    both = found.withColumn("__read", F.lit(True)).unionByName(new.withColumn("__read", F.lit(False))).join(F.broadcast(lacking))
    return both.where(F.col("__read") == (F.col("__n") == 0)).select("data_group", "done")


def set_done(spark: SparkSession, path: str, expected: list[str], group: str, done: bool = True) -> None:
    """Changes one group's state; one that isn't expected is an error."""
    if group not in expected:
        raise ValueError(f"data group {group} is not supported")
    # one row a group, of which there are a few
    write_status(spark, path, dict(map(tuple, read_status(spark, path, expected).collect())) | {group: done})


def sequences_to_fetch(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """The manifest's files whose data group isn't done."""
    return manifest.join(status.where("done").select(F.col("data_group").alias("data_type")), "data_type", "left_anti")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """The versions below path and whether each has been written to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(p)] if system.exists(p) else []
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return [(v, system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, f"version={v:09d}/_SUCCESS"))) for v in found]
