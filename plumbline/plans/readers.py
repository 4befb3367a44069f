"""Files of recordings written from the tables, and read by their readers.

A key's lines stand in one file, in order, as the last of them counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.session import load, shared_folder
from plumbline.sources import tracks

HOUR_NS = "epoch_us(ts) // 3600000000 * 3600000000000"


def events(spark, sf_dir) -> DataFrame:
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 3_600_000_000_000
    return load(spark, sf_dir, "events").withColumn("ns", hour.cast("long")).withColumn("uid", (F.col("user_id") % 50).cast("string"))


def _lines(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions("event_id")


def _csv(df: DataFrame, columns: list[str], keys: list[str], *values) -> str:
    folder = shared_folder(df.sparkSession)
    rows = _lines(df, *keys).select(*(F.col(v).cast("string").alias(c) if isinstance(v, str) else v.cast("string").alias(c) for c, v in zip(columns, values, strict=True)))
    rows.write.option("header", True).csv(folder)
    return folder


def _pose(name: str = "pose") -> list:
    return [F.get(f"{name}.q", F.lit(0)).alias("qw"), F.get(f"{name}.q", F.lit(3)).alias("qz"), F.get(f"{name}.t", F.lit(2)).alias("z")]


POSE = f"SELECT {HOUR_NS} AS ts_ns, {{key}}arg_max(value, event_id) AS qw, CAST(arg_max(event_id % 7, event_id) AS DOUBLE) AS qz, CAST(arg_max(event_id, event_id) AS DOUBLE) AS z FROM events GROUP BY ALL"


def _write_poses(e: DataFrame, uid, keys: list[str]) -> str:
    e = e.withColumn("m", F.col("event_id") % 7)
    return _csv(e, tracks.POSE_COLUMNS, keys, uid, "ns", F.lit(0.5), F.lit(-1), "event_id", "value", F.lit(0), F.lit(0.25), "m")


@query(POSE.format(key="CAST(user_id % 50 AS VARCHAR) AS object_uid, "))
def read_object_poses(spark, sf_dir):
    folder = _write_poses(events(spark, sf_dir), "uid", ["uid", "ns"])
    return tracks.object_poses(spark, folder).select("ts_ns", "object_uid", *_pose())


@query(POSE.format(key=""))
def read_headset_poses(spark, sf_dir):
    folder = _write_poses(events(spark, sf_dir), F.lit("headset"), ["ns"])
    return tracks.headset_poses(spark, folder).select("ts_ns", *_pose())


BOXES = f"""
SELECT 'S' || user_id % 3 AS stream_id, {HOUR_NS} AS ts_ns, {{key}}, CASE WHEN arg_max(event_type <> 'error', event_id) THEN arg_max(value, event_id) END AS left_,
  CASE WHEN arg_max(event_type <> 'error', event_id) THEN arg_max(value, event_id) + 10 END AS bottom_, arg_max(CASE WHEN event_id % 4 > 0 THEN event_id % 4 / 8.0 ELSE -1 END, event_id)::DOUBLE AS seen FROM events GROUP BY ALL
"""


def _write_boxes(e: DataFrame, columns: list[str], key, keys: list[str]) -> str:
    left = F.when(F.col("event_type") != "error", F.col("value").cast("string")).otherwise("None")
    seen = F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4 / 8).otherwise(-1)
    e = e.withColumn("stream", F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string"))).withColumn("key", key)
    return _csv(e, columns, keys, "stream", "key", "ns", left, F.lit(7), F.lit(8), F.col("value") + 10, seen)


def _boxes(found: DataFrame, key: str) -> DataFrame:
    return found.select("stream_id", "ts_ns", key, F.col("box.left").alias("left_"), F.col("box.bottom").alias("bottom_"), F.col("visibility").alias("seen"))


@query(BOXES.format(key="CAST(event_id % 2 AS INTEGER) AS hand_index"))
def read_hand_boxes(spark, sf_dir):
    """Boxes are null where the first edge is no number."""
    folder = _write_boxes(events(spark, sf_dir), tracks.HAND_BOX_COLUMNS, F.col("event_id") % 2, ["stream", "ns", "key"])
    return _boxes(tracks.hand_boxes(spark, folder), "hand_index")


@query(BOXES.format(key="CAST(user_id % 50 AS VARCHAR) AS object_uid"))
def read_object_boxes(spark, sf_dir):
    folder = _write_boxes(events(spark, sf_dir), tracks.OBJECT_BOX_COLUMNS, F.col("uid"), ["stream", "ns", "key"])
    return _boxes(tracks.object_boxes(spark, folder), "object_uid")


@query(f"SELECT 'S' || user_id % 3 AS stream_id, CAST({HOUR_NS} AS VARCHAR) AS ts, arg_max(event_id % 3 = 0, event_id) AS mask FROM events GROUP BY ALL")
def read_masks(spark, sf_dir):
    """Only the text True is true; times stay text."""
    e = events(spark, sf_dir).withColumn("stream", F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")))
    text = F.when(F.col("event_id") % 3 == 0, "True").when(F.col("event_id") % 3 == 1, "False").otherwise("true")
    return tracks.mask_series(spark, _csv(e, tracks.MASK_COLUMNS, ["stream", "ns"], "ns", "stream", text))


@query(f"""
SELECT {HOUR_NS} AS ts_ns, hand, CAST(arg_max(event_id, event_id) AS DOUBLE) AS z, arg_max(value, event_id) AS pose, CAST(arg_max(user_id, event_id) AS DOUBLE) AS beta
FROM (SELECT *, unnest(CASE event_id % 4 WHEN 0 THEN [0, 1] WHEN 1 THEN [0] WHEN 2 THEN [1] ELSE [] END) AS hand FROM events) GROUP BY ALL
""")
def read_hand_poses(spark, sf_dir):
    """Lines with both hands, one, or none; a later line replaces only the hands that it has."""
    e = events(spark, sf_dir)
    d = lambda x: x.cast("double")
    hand = F.struct(F.struct(F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0))).alias("q_wxyz"), F.array(F.lit(0.0), F.lit(0.0), d(F.col("event_id"))).alias("t_xyz")).alias("wrist_xform"), F.array("value").alias("pose"), F.array(d(F.col("user_id"))).alias("betas"))
    has = lambda *rest: F.when((F.col("event_id") % 4).isin(*rest), hand)
    folder = shared_folder(spark)
    _lines(e, "ns").select(F.col("ns").alias("timestamp_ns"), F.struct(has(0, 1).alias("0"), has(0, 2).alias("1")).alias("hand_poses")).write.json(folder)
    found = tracks.hand_poses(spark, folder)
    return found.select("ts_ns", "hand", F.get("wrist.t", F.lit(2)).alias("z"), F.get("pose", F.lit(0)).alias("pose"), F.get("betas", F.lit(0)).alias("beta"))


@query("SELECT event_id % 100 AS frame, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def read_segment_lines(spark, sf_dir):
    """The second field of lines that have one."""
    e = events(spark, sf_dir)
    folder = shared_folder(spark)
    e.select(F.when(F.col("event_type") == "view", F.lit("  single ")).otherwise(F.concat(F.lit(" a \t "), (F.col("event_id") % 100).cast("string"), F.lit("  rest of it"))).alias("value")).write.text(folder)
    return tracks.segment_lines(spark, folder).groupBy("frame").agg(F.count("*").alias("n"))


@query("SELECT event_id, value AS x, CAST(event_id % 5 AS DOUBLE) AS qx, CAST(user_id AS DOUBLE) AS qw FROM events")
def read_trajectory_lines(spark, sf_dir):
    e = events(spark, sf_dir)
    folder = shared_folder(spark)
    # the second number is the row's own, to tell rows apart
    fields = [F.col("value"), F.col("event_id"), F.lit(0), F.col("event_id") % 5, F.lit(0), F.lit(0), F.col("user_id")]
    e.select(F.concat_ws(" ", *(f.cast("string") for f in fields)).alias("value")).write.text(folder)
    v = tracks.trajectory(spark, folder)
    return v.select(F.get("t", F.lit(1)).cast("long").alias("event_id"), F.get("t", F.lit(0)).alias("x"), F.get("q", F.lit(1)).alias("qx"), F.get("q", F.lit(0)).alias("qw"))


@query("SELECT 'seq_' || n_regionkey AS sequence, n_name AS data_type, n_name || '.zip' AS filename, CAST(n_nationkey AS VARCHAR) AS sha1, 'files/' || n_nationkey AS url FROM nation")
def read_manifest(spark, sf_dir):
    """One document; nation has 25 rows at every scale."""
    n = load(spark, sf_dir, "nation")
    entry = F.struct(F.concat("n_name", F.lit(".zip")).alias("filename"), F.col("n_nationkey").cast("string").alias("sha1sum"), F.concat(F.lit("files/"), F.col("n_nationkey").cast("string")).alias("download_url"))
    groups = n.groupBy(F.concat(F.lit("seq_"), F.col("n_regionkey").cast("string")).alias("s")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_name"), entry))).alias("files"))
    folder = shared_folder(spark)
    groups.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("s", "files"))).alias("sequences"))).alias("value")).write.text(folder)
    return tracks.manifest(spark, folder)


@query("SELECT n_name || '.png' AS rgb, n_name || '_d.png' AS depth, n_nationkey + 0.5::DOUBLE AS depth_scale, CAST(n_regionkey AS DOUBLE) AS fx FROM nation")
def read_depth_annotations(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    one = F.struct(F.concat("n_name", F.lit(".png")).alias("rgb"), F.concat("n_name", F.lit("_d.png")).alias("depth"), (F.col("n_nationkey") + 0.5).alias("depth_scale"), F.array(F.col("n_regionkey").cast("double"), F.lit(2.0)).alias("cam_in"))
    folder = shared_folder(spark)
    n.agg(F.to_json(F.struct(F.collect_list(one).alias("files"))).alias("value")).write.text(folder)
    return tracks.depth_annotations(spark, folder).select("rgb", "depth", "depth_scale", F.get("cam_in", F.lit(0)).alias("fx"))


@query("SELECT event_id, CAST(trunc((event_id / 7.0::DOUBLE) * 1e9::DOUBLE) AS BIGINT) AS ns FROM events")
def quest_times(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", tracks.quest_times(F.col("event_id") / 7.0).alias("ns"))


@query("SELECT CAST(label % 2 AS INTEGER) AS hand, CAST(vec_id // 100 AS INTEGER) AS chunk_id, vec_id, label FROM embeddings")
def chunks_written_once(spark, sf_dir):
    """Chunks written by hand, and read back through a step that an earlier run had done."""
    d = load(spark, sf_dir, "embeddings").select((F.col("label") % 2).cast("int").alias("hand"), F.floor(F.col("vec_id") / 100).cast("int").alias("chunk_id"), F.col("vec_id").cast("long").alias("vec_id"), "label")
    chunks, done = shared_folder(spark), shared_folder(spark)
    tracks.write_chunks(d, chunks)
    make = lambda: spark.read.schema(f"vec_id long, label {dict(d.dtypes)['label']}, hand int, chunk_id int").json(chunks)
    tracks.resume(spark, done, make)
    return tracks.resume(spark, done, lambda: d.limit(0)).select("hand", "chunk_id", "vec_id", "label")
