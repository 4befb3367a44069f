"""Record files written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import rigid
from plumbline.plans.geometry import vectors
from plumbline.plans.registry import query
from plumbline.session import shared_folder
from plumbline.sources import records

#: Vectors, of any label, from which a chunk's frames come.
PER_CHUNK = 50


def _grouped(spark, sf_dir, value):
    """label, chunk and the values of its vectors in their order; a chunk has PER_CHUNK at most."""
    d = vectors(spark, sf_dir).select("label", F.floor(F.col("vec_id") / PER_CHUNK).alias("chunk"), "vec_id", value.alias("v"))
    return d.groupBy("label", "chunk").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("rows")).withColumn("rows", F.transform("rows", lambda r: r["v"]))


FRAMES = f"SELECT label, vec_id // {PER_CHUNK} AS chunk, e, row_number() OVER (PARTITION BY label, vec_id // {PER_CHUNK} ORDER BY vec_id) - 1 AS i FROM (SELECT v.label, v.vec_id, list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings v)"


@query(f"""
SELECT CAST(label AS VARCHAR) AS track, 1000 * chunk + i AS frame, e[6] AS root_23, e[7] AS pose_33, e[3] AS z, CASE WHEN chunk % 2 = 0 THEN first_value(e[20]) OVER (PARTITION BY label, chunk ORDER BY i) ELSE e[20] END AS beta
FROM ({FRAMES})
""")
def chunk_prediction_scan(spark, sf_dir):
    """Chunks with nested arrays; every second one has one row of shapes for all of its frames."""
    records.register(spark)
    rows = _grouped(spark, sf_dir, F.col("e"))
    block = lambda e, start: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.get(e, (start + 3 * i + j) % 64)))
    shapes = F.transform("rows", lambda e: F.slice(e, 11, 10))
    chunks = rows.select(
        F.col("label").cast("string").alias("track"), (1000 * F.col("chunk")).alias("start"), (1000 * F.col("chunk") + F.size("rows")).alias("end"),
        F.transform("rows", lambda e: block(e, F.lit(0))).alias("root_orient"),
        F.transform("rows", lambda e: F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: block(e, 9 * k))).alias("hand_pose"),
        F.transform("rows", lambda e: F.slice(e, 1, 3)).alias("trans"),
        F.when(F.col("chunk") % 2 == 0, F.slice(shapes, 1, 1)).otherwise(shapes).alias("betas"),
    )
    folder = shared_folder(spark)
    chunks.write.format("hand_chunks").mode("append").save(folder)
    read = spark.read.format("hand_chunks").load(folder)
    last = F.lit(2)
    return read.select("track", "frame", F.get(F.get("root_orient", F.lit(1)), last).alias("root_23"), F.get(F.get(F.get("hand_pose", F.lit(14)), last), last).alias("pose_33"), F.get("trans", last).alias("z"), F.get("betas", F.lit(9)).alias("beta"))


@query(f"""
SELECT label || '_' || chunk AS name, i AS row, round(s * e[1], 6) + 0.0 AS x, round(s * e[2], 6) + 0.0 AS y, round(s * e[3], 6) + 0.0 AS z,
  round(-s * ((1 - 2 * (qy * qy + qz * qz)) * e[1] + 2 * (qx * qy + qw * qz) * e[2] + 2 * (qx * qz - qw * qy) * e[3]), 6) + 0.0 AS back_x,
  round(-s * (2 * (qx * qz + qw * qy) * e[1] + 2 * (qy * qz - qw * qx) * e[2] + (1 - 2 * (qx * qx + qy * qy)) * e[3]), 6) + 0.0 AS back_z
FROM (SELECT *, chunk + 0.5::DOUBLE AS s, e[4] / n AS qx, e[5] / n AS qy, e[6] / n AS qz, e[7] / n AS qw FROM (SELECT *, sqrt(e[4]**2 + e[5]**2 + e[6]**2 + e[7]**2) AS n FROM ({FRAMES})))
""")
def trajectory_record_scan(spark, sf_dir):
    """Trajectories as poses of the camera in the world, and of the world in the camera."""
    records.register(spark)
    rows = _grouped(spark, sf_dir, F.slice("e", 1, 7)).select(F.concat_ws("_", "label", "chunk").alias("name"), F.col("rows").alias("traj"), (F.col("chunk") + 0.5).cast("double").alias("scale"))
    folder = shared_folder(spark)
    rows.write.format("trajectory_records").mode("append").save(folder)
    there = rigid.from_trajectory(F.col("pose"), F.col("scale"))
    read = spark.read.format("trajectory_records").load(folder).select("name", "row", there.alias("p"), rigid.inverse(there).alias("b"))
    return read.select("name", "row", *((F.round(F.get(f"{c}.t", F.lit(i)), 6) + 0.0).alias(n) for c, i, n in (("p", 0, "x"), ("p", 1, "y"), ("p", 2, "z"), ("b", 0, "back_x"), ("b", 2, "back_z"))))
