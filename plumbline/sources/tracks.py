"""Readers of recordings' files as DataFrames, and writers of results.

Timestamps are whole nanoseconds and stay so. Of rows with one key the last of the
file wins, so readers of one file keep its line order in a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.asof import last_wins
from plumbline.operators.records import float_or_null, one_uid

# The columns that each file has.
POSE_COLUMNS = ["object_uid", "timestamp[ns]", "t_wo_x[m]", "t_wo_y[m]", "t_wo_z[m]", "q_wo_w", "q_wo_x", "q_wo_y", "q_wo_z"]
OBJECT_BOX_COLUMNS = ["stream_id", "object_uid", "timestamp[ns]", "x_min[pixel]", "x_max[pixel]", "y_min[pixel]", "y_max[pixel]", "visibility_ratio[%]"]
HAND_BOX_COLUMNS = ["stream_id", "hand_index", "timestamp[ns]", "x_min[pixel]", "x_max[pixel]", "y_min[pixel]", "y_max[pixel]", "visibility_ratio[%]"]
MASK_COLUMNS = ["timestamp[ns]", "stream_id", "mask"]

HAND_POSES = "timestamp_ns long, hand_poses map<string, struct<wrist_xform: struct<q_wxyz: array<double>, t_xyz: array<double>>, pose: array<double>, betas: array<double>>>"
CAMERAS = "label string, serialNumber string, imageWidth int, imageHeight int, projectionParams array<double>, T_Device_Camera struct<quaternion_wxyz: array<double>, translation_xyz: array<double>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads has the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def check_columns(df: DataFrame, expected: list[str], strict: bool = False) -> DataFrame:
    """df, unless it has a column that is not expected; strict: or lacks one that is."""
    odd = [c for c in df.columns if c not in expected and c != "line"]
    lacking = [c for c in expected if c not in df.columns] if strict else []
    if odd or lacking:
        raise ValueError(f"columns not expected: {odd}; lacking: {lacking}")
    return df


def read_csv(spark: SparkSession, path: str, expected: list[str], strict: bool = False) -> DataFrame:
    """All columns as text, bound by the header, with each row's place in the file."""
    df = spark.read.option("header", True).option("quote", '"').csv(path)
    return check_columns(df, expected, strict).withColumn("line", F.monotonically_increasing_id())


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def numbers(*names: str) -> Column:
    return F.array(*(c(n).cast("double") for n in names))


def object_poses(spark: SparkSession, path: str) -> DataFrame:
    """ts_ns, object_uid, pose (q: wxyz, t)."""
    rows = read_csv(spark, path, POSE_COLUMNS)
    pose = F.struct(numbers("q_wo_w", "q_wo_x", "q_wo_y", "q_wo_z").alias("q"), numbers("t_wo_x[m]", "t_wo_y[m]", "t_wo_z[m]").alias("t"))
    return last_wins(rows.select(c("timestamp[ns]").cast("long").alias("ts_ns"), "object_uid", pose.alias("pose"), "line"), ["ts_ns", "object_uid"], ["line"]).drop("line")


def headset_poses(spark: SparkSession, path: str) -> DataFrame:
    """ts_ns, pose of the one object in the file; a query raises where there are more or none."""
    rows = read_csv(spark, path, POSE_COLUMNS)
    pose = F.struct(numbers("q_wo_w", "q_wo_x", "q_wo_y", "q_wo_z").alias("q"), numbers("t_wo_x[m]", "t_wo_y[m]", "t_wo_z[m]").alias("t"))
    rows = one_uid(rows, "object_uid").select(c("timestamp[ns]").cast("long").alias("ts_ns"), pose.alias("pose"), "line")
    return last_wins(rows, ["ts_ns"], ["line"]).drop("line")


def _boxes(rows: DataFrame, key: str, kind: str) -> DataFrame:
    edges = {"left": "x_min[pixel]", "top": "y_min[pixel]", "right": "x_max[pixel]", "bottom": "y_max[pixel]"}
    box = F.struct(*(float_or_null(c(name)).alias(edge) for edge, name in edges.items()))
    made = rows.select("stream_id", c("timestamp[ns]").cast("long").alias("ts_ns"), c(key).cast(kind).alias(key), F.when(float_or_null(c("x_min[pixel]")).isNotNull(), box).alias("box"), float_or_null(c("visibility_ratio[%]")).alias("visibility"), "line")
    return last_wins(made, ["stream_id", "ts_ns", key], ["line"]).drop("line")


def hand_boxes(spark: SparkSession, path: str) -> DataFrame | None:
    """stream_id, ts_ns, hand_index, box (null without a number), visibility; None without the file."""
    return _boxes(read_csv(spark, path, HAND_BOX_COLUMNS), "hand_index", "int") if exists(spark, path) else None


def object_boxes(spark: SparkSession, path: str) -> DataFrame | None:
    """stream_id, ts_ns, object_uid, box, visibility; None without the file."""
    return _boxes(read_csv(spark, path, OBJECT_BOX_COLUMNS), "object_uid", "string") if exists(spark, path) else None


def mask_series(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, ts (text), mask: true for the text True alone."""
    rows = read_csv(spark, path, MASK_COLUMNS).select("stream_id", c("timestamp[ns]").alias("ts"), (F.col("mask").eqNullSafe("True")).alias("mask"), "line")
    return last_wins(rows, ["stream_id", "ts"], ["line"]).drop("line")


def hand_poses(spark: SparkSession, path: str) -> DataFrame:
    """ts_ns, hand (0 left, 1 right), wrist, pose, betas; a later line replaces only the hands it carries."""
    rows = spark.read.schema(HAND_POSES).json(path).withColumn("line", F.monotonically_increasing_id())
    rows = rows.select(F.col("timestamp_ns").alias("ts_ns"), "line", F.explode("hand_poses").alias("hand", "h")).where(F.col("hand").isin("0", "1") & F.col("h").isNotNull())
    rows = rows.select("ts_ns", F.col("hand").cast("int").alias("hand"), "line", F.struct(F.col("h.wrist_xform.q_wxyz").alias("q"), F.col("h.wrist_xform.t_xyz").alias("t")).alias("wrist"), "h.pose", "h.betas")
    return last_wins(rows, ["ts_ns", "hand"], ["line"]).drop("line")


def hand_shape(spark: SparkSession, path: str) -> DataFrame:
    """The first betas of the file, of a line's left hand before its right: one row at most."""
    rows = spark.read.schema(HAND_POSES).json(path).withColumn("line", F.monotonically_increasing_id())
    rows = rows.select("line", F.explode("hand_poses").alias("hand", "h")).where("h.betas is not null")
    return rows.agg(F.min_by("h.betas", F.struct("line", "hand")).alias("betas"))


def object_library(spark: SparkSession, path: str) -> DataFrame:
    """uid, name, type, motion of each instance of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string, struct<instance_name: string, instance_type: string, motion_type: string>>")).alias("uid", "i"))
    return rows.select("uid", F.col("i.instance_name").alias("name"), F.col("i.instance_type").alias("type"), F.col("i.motion_type").alias("motion"))


def dynamic_objects(library: DataFrame) -> DataFrame:
    return library.where("type = 'object' and motion = 'dynamic'")


def camera_models(spark: SparkSession, path: str) -> DataFrame:
    """Cameras with one focal length: the second projection parameter is left out."""
    rows = spark.read.schema(CAMERAS).option("multiLine", True).json(path)
    p = F.col("projectionParams")
    return rows.select("label", F.col("serialNumber").alias("serial"), F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.concat(F.slice(p, 1, 1), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0)))).alias("projection"), F.struct(F.col("T_Device_Camera.quaternion_wxyz").alias("q"), F.col("T_Device_Camera.translation_xyz").alias("t")).alias("device_camera"))


def chunk_predictions(spark: SparkSession, path: str) -> DataFrame:
    """hand, frame, trans, betas of the chunks' files path/<hand>/<start>_<end>.json; one row of betas serves all frames."""
    rows = spark.read.schema("init_trans array<array<array<double>>>, init_betas array<array<array<double>>>").option("multiLine", True).json(f"{path}/*/*.json").withColumn("__file", F.input_file_name())
    name = F.regexp_extract("__file", r"([^/]+)/(\d+)_\d+\.json$", 1).alias("hand")
    start = F.regexp_extract("__file", r"/(\d+)_\d+\.json$", 1).cast("long")
    betas = F.get("init_betas", F.lit(0))
    frames = rows.select(name, start.alias("start"), betas.alias("b"), F.posexplode(F.get("init_trans", F.lit(0))).alias("i", "trans"))
    return frames.select("hand", (F.col("start") + F.col("i")).alias("frame"), "trans", F.coalesce(F.get("b", F.col("i")), F.get("b", F.lit(0))).alias("betas"))


def segment_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, frame: the second field of each line that has one."""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = F.split(F.trim("value"), r"\s+")
    return rows.where(F.size(parts) >= 2).select("line", F.get(parts, F.lit(1)).cast("long").alias("frame"))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """row, q (wxyz), t of lines tx ty tz qx qy qz qw."""
    rows = spark.read.text(path).withColumn("row", F.monotonically_increasing_id())
    v = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    return rows.where(F.length(F.trim("value")) > 0).select("row", F.concat(F.slice(v, 7, 1), F.slice(v, 4, 3)).alias("q"), F.slice(v, 1, 3).alias("t"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """sequence, data_type, filename, sha1, url of a download manifest."""
    text = spark.read.text(path, wholetext=True)
    kind = "struct<sequences: map<string, map<string, struct<filename: string, sha1sum: string, download_url: string>>>>"
    rows = text.select(F.explode(F.from_json("value", kind)["sequences"]).alias("sequence", "files")).select("sequence", F.explode("files").alias("data_type", "f"))
    return rows.select("sequence", "data_type", "f.filename", F.col("f.sha1sum").alias("sha1"), F.col("f.download_url").alias("url"))


def verify(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """files (filename, sha1) with ok: whether the folder holds each with that sum; null if it lacks it."""
    found = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.sha1("content").alias("__sha1"))
    return files.join(found, "filename", "left").withColumn("ok", F.lower("sha1") == F.col("__sha1")).drop("__sha1")


def depth_annotations(spark: SparkSession, path: str) -> DataFrame:
    """rgb, depth, depth_scale, cam_in of each file of an annotation document."""
    rows = spark.read.schema("files array<struct<rgb: string, depth: string, depth_scale: double, cam_in: array<double>>>").option("multiLine", True).json(path)
    return rows.select(F.explode("files").alias("f")).select("f.*")


def quest_times(seconds: Column) -> Column:
    """Seconds as whole nanoseconds, cut off and not rounded."""
    return (seconds * 1e9).cast("long")


def focal_length(given: float | None, spark: SparkSession, path: str) -> float:
    """What is given, else the number in a file, else 600."""
    if given is not None:
        return float(given)
    row = spark.read.text(path).select(float_or_null(F.trim("value"))).first() if exists(spark, path) else None
    return row[0] if row and row[0] is not None else 600.0


def resume(spark: SparkSession, path: str, make) -> DataFrame:
    """What an earlier run wrote to path, else make() written there."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_chunks(df: DataFrame, path: str) -> None:
    """JSON lines in a folder for each hand and chunk."""
    df.write.mode("overwrite").partitionBy("hand", "chunk_id").json(path)
