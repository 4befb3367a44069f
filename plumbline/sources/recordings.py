"""Where a recording's files are, and which recordings are whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The files of a recording by kind, and the headsets that need them.
FILES = {
    "recording": "recording.vrs",
    "dynamic_objects": "dynamic_objects.csv",
    "headset_trajectory": "headset_trajectory.csv",
    "mano_hand_poses": "mano_hand_pose_trajectory.jsonl",
    "box2d_objects": "box2d_objects.csv",
    "box2d_hands": "box2d_hands.csv",
    "metadata": "metadata.json",
    "camera_models": "camera_models.json",
    "mps": "mps",
}
NEEDED = {
    "Aria": ["recording", "dynamic_objects", "headset_trajectory", "mano_hand_poses"],
    "Quest3": ["recording", "dynamic_objects", "headset_trajectory", "mano_hand_poses", "camera_models"],
}
LACKS = {"Aria": ["camera_models"], "Quest3": ["mps"]}


def recording_files(spark: SparkSession, root: str) -> DataFrame:
    """recording, headset, kind, path, required, present of each file of the recordings root/<recording>/metadata.json.

    An unknown headset fails what reads the result, with the recording's name.
    """
    here = root.rstrip("/")
    meta = spark.read.schema("headset string").option("multiLine", True).json(f"{here}/*/metadata.json")
    meta = meta.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/metadata\.json$", 1).alias("recording"), "headset")
    kinds = spark.createDataFrame([(h, k, f, k in NEEDED[h]) for h in NEEDED for k, f in FILES.items() if k not in LACKS[h]], "headset string, kind string, file string, required boolean")
    # only names are listed, as no other column is read; what lies below a folder counts for it
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(here).select(F.regexp_extract("path", rf"/{re.escape(here.rpartition('/')[2])}/(.*)$", 1).alias("rest"))
    found = names.select(F.element_at(F.split("rest", "/"), 1).alias("recording"), F.get(F.split("rest", "/"), F.lit(1)).alias("file"), F.lit(True).alias("present")).where("file is not null").distinct()
    listed = meta.join(F.broadcast(kinds), "headset", "left")  # a row a headset and kind of file
    listed = listed.where(F.when(F.col("kind").isNotNull(), True).otherwise(F.raise_error(F.concat("recording", F.lit(": headset "), F.coalesce("headset", F.lit("null")), F.lit(" is not supported")))))
    return listed.join(found, ["recording", "file"], "left").select("recording", "headset", "kind", F.concat_ws("/", F.lit(here), "recording", "file").alias("path"), "required", F.coalesce("present", F.lit(False)).alias("present"))


def validity(files: DataFrame) -> DataFrame:
    """recording, headset, valid, and the required kinds that are missing, in order."""
    lost = F.collect_list(F.when(F.col("required") & ~F.col("present"), F.col("kind")))
    return files.groupBy("recording", "headset").agg(F.bool_and(F.col("present") | ~F.col("required")).alias("valid"), F.array_sort(lost).alias("missing"))

