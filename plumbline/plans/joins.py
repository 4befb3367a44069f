"""Gather, scatter and reduce by index, and what is drawn from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import boxes, rigid
from plumbline.functions import rotation as R
from plumbline.operators import updates
from plumbline.plans.geometry import named, part, sql_columns, vectors
from plumbline.plans.registry import query
from plumbline.session import load

E = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query("SELECT e.event_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality * 100.0::DOUBLE ELSE e.value END AS value FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id")
def scatter_update(spark, sf_dir):
    new = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), (F.col("quality") * 100.0).alias("value"))
    return updates.upsert(load(spark, sf_dir, "events").select("event_id", "value"), new, ["event_id"], "value")


@query("SELECT e.event_id, CASE WHEN l.doc_id IS NOT NULL AND e.event_type = 'error' THEN l.quality * 100.0::DOUBLE ELSE e.value END AS value FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id")
def replace_missing(spark, sf_dir):
    new = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), (F.col("quality") * 100.0).alias("value"))
    base = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return updates.upsert(base, new, ["event_id"], "value", F.col("event_type") == "error").select("event_id", "value")


@query("SELECT d.doc_id AS user_id, round(coalesce(sum(e.value), 0), 4) AS value FROM (SELECT DISTINCT doc_id FROM labels) d LEFT JOIN events e ON e.user_id = d.doc_id GROUP BY 1")
def segment_reduce(spark, sf_dir):
    keys = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"))
    return updates.reduce_to(load(spark, sf_dir, "events"), keys, "user_id", "value").select("user_id", F.round("value", 4).alias("value"))


@query("SELECT a.vec_id, b.vec_id AS other FROM embeddings a JOIN (SELECT unnest([-3, -2, -1, 3, 4, 5]) AS o) ON true JOIN embeddings b ON b.vec_id = a.vec_id + o")
def neighbour_offsets(spark, sf_dir):
    return updates.neighbours(load(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", [-3, -2, -1, 3, 4, 5])


@query("SELECT r_name, n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name DESC) AS i FROM nation) USING (i)")
def positional_map(spark, sf_dir):
    """Both tables have a fixed number of rows."""
    n = load(spark, sf_dir, "nation").select("n_name")
    r = load(spark, sf_dir, "region").select("r_name")
    return updates.by_position(r, n, "r_name", F.desc("n_name")).select("r_name", "n_name")


@query("""
WITH t AS (SELECT l_suppkey % 10 AS seq, l_linenumber AS track, avg(l_quantity) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT seq, CAST(arg_min(track, (round(d, 9), track)) AS BIGINT) AS track, count(*) AS candidates FROM t WHERE n >= 80 GROUP BY 1
""")
def nearest_track(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("seq"), F.col("l_linenumber").cast("long").alias("track"), "l_quantity")
    return updates.nearest_track(rows, ["seq"], "track", F.col("l_quantity"), F.lit(100))


@query("SELECT user_id, round(CASE WHEN avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END) < 0.75 THEN 1000 ELSE sum(value * (event_id % 7 + 1)) FILTER (event_type <> 'error') / sum(event_id % 7 + 1) FILTER (event_type <> 'error') END, 5) AS distance FROM events GROUP BY 1")
def frame_distance(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return updates.frame_distance(e, ["user_id"], F.col("value"), F.col("event_id") % 7 + 1, F.col("event_type") != "error").select("user_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id, {sql_columns([f'x[{k}] / greatest(sqrt(x[1] * x[1] + x[2] * x[2] + x[3] * x[3]), 1e-5)' for k in (1, 2, 3)], 'n')} FROM (SELECT vec_id, [u[2]*v[3]-u[3]*v[2], u[3]*v[1]-u[1]*v[3], u[1]*v[2]-u[2]*v[1]] AS x FROM (SELECT vec_id, [e[4]-e[1], e[5]-e[2], e[6]-e[3]] AS u, [e[7]-e[1], e[8]-e[2], e[9]-e[3]] AS v FROM {E}))")
def vertex_normals(spark, sf_dir):
    """Of meshes of one face; its corners have its normal."""
    d = vectors(spark, sf_dir).select(F.col("vec_id").alias("mesh"), F.lit(0).alias("i"), F.lit(1).alias("j"), F.lit(2).alias("k"), part(1, 3).alias("a"), part(4, 3).alias("b"), part(7, 3).alias("c"))
    return updates.vertex_normals(d).where("vertex = 1").select(F.col("mesh").alias("vec_id"), *named(F.col("normal"), 3, "n"))


@query(f"SELECT vec_id, round(exp(-20 * abs(e[1])), 6) AS colour, round(CASE WHEN e[4] <> 0 THEN 1 / e[4] END, 4) AS depth FROM {E}")
def colour_and_depth(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(F.exp(-20 * F.abs(R.at(F.col("e"), 0))), 6).alias("colour"), F.round(F.try_divide(F.lit(1.0), R.at(F.col("e"), 3)), 4).alias("depth"))


@query(f"SELECT vec_id, {sql_columns(['e[1]', 'e[2]', '2 * 600 / (256 * (abs(e[3]) + 1))'])} FROM {E}")
def weak_camera(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("t", rigid.weak_to_full(F.abs(R.at(F.col("e"), 2)) + 1, R.at(F.col("e"), 0), R.at(F.col("e"), 1), F.lit(256.0), F.lit(600.0)))
    return d.select("vec_id", *named(F.col("t"), 3))


@query(f"SELECT vec_id, CAST(trunc(256 * (e[1] * 100 - 1 - 3) / 400.0::DOUBLE + 128) AS INTEGER) + 1 AS x, CAST(trunc(256 * (e[2] * 100 - 1 - 5) / 400.0::DOUBLE + 128) AS INTEGER) + 1 AS y FROM {E}")
def crop_point(spark, sf_dir):
    x, y = R.at(F.col("e"), 0) * 100, R.at(F.col("e"), 1) * 100
    d = vectors(spark, sf_dir).withColumn("p", boxes.crop_point(x, y, F.lit(3.0), F.lit(5.0), F.lit(2.0), 256.0))
    return d.select("vec_id", "p.x", "p.y")


@query(f"SELECT vec_id, {sql_columns(['639 - e[3]', 'e[4]', '639 - e[1]', 'e[2]'])} FROM {E}")
def flip_keypoints(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("p", boxes.flipped(F.array(part(1, 2), part(3, 2)), [1, 0], 640.0))
    return d.select("vec_id", *(F.round(R.at(F.col("p"), i, k), 6).alias(f"x{2 * i + k}") for i in range(2) for k in range(2)))


# a bone of length 1 along y, turned by one unit quaternion, then by the product of two
TURNED_Y = "2 * ({x} * {y} - {w} * {z})", "1 - 2 * ({x} * {x} + {z} * {z})", "2 * ({y} * {z} + {w} * {x})"
TIP = [a.format(**dict(zip("wxyz", ("aw", "ax", "ay", "az"), strict=True))) + " + " + a.format(**dict(zip("wxyz", ("pw", "px", "py", "pz"), strict=True))) for a in TURNED_Y]
UNIT4 = ", ".join(f"e[{4 * i + j + 1}] / sqrt(e[{4 * i + 1}]**2 + e[{4 * i + 2}]**2 + e[{4 * i + 3}]**2 + e[{4 * i + 4}]**2) AS {n}{c}" for i, n in enumerate("ab") for j, c in enumerate("wxyz"))


@query(f"SELECT vec_id, {sql_columns(TIP)} FROM (SELECT *, aw*bw - ax*bx - ay*b_y - az*bz AS pw, aw*bx + ax*bw + ay*bz - az*b_y AS px, aw*b_y - ax*bz + ay*bw + az*bx AS py, aw*bz + ax*b_y - ay*bx + az*bw AS pz FROM (SELECT vec_id, {UNIT4.replace(' AS by', ' AS b_y')} FROM {E}))")
def forward_kinematics(spark, sf_dir):
    """A chain of three bones with the vector's first rotations."""
    turns = [R.unit(part(1 + 4 * i, 4), 4) for i in range(3)]
    bone = R.vec(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    d = vectors(spark, sf_dir).withColumn("tip", R.forward([-1, 0, 1], turns, [R.vec(*[F.lit(0.0)] * 3), bone, bone])[2])
    return d.select("vec_id", *named(F.col("tip"), 3))


HALF = "cos(pi() / 12)", "sin(pi() / 12)"


@query(f"""
SELECT vec_id, {sql_columns([f'k * {c}' for c in 'xyz'])} FROM (
  SELECT *, CASE WHEN w < 0 THEN 2 * atan2(-s, -w) ELSE 2 * atan2(s, w) END / s AS k FROM (SELECT *, sqrt(x * x + y * y + z * z) AS s FROM (
    SELECT vec_id, {HALF[0]} * w + {HALF[1]} * z AS w, {HALF[0]} * x + {HALF[1]} * y AS x, {HALF[0]} * y - {HALF[1]} * x AS y, {HALF[0]} * z - {HALF[1]} * w AS z FROM (
      SELECT vec_id, cos(a / 2) AS w, e[1] * sin(a / 2) / a AS x, e[2] * sin(a / 2) / a AS y, e[3] * sin(a / 2) / a AS z FROM (SELECT *, sqrt(e[1]**2 + e[2]**2 + e[3]**2) AS a FROM {E})))))
""")
def rotate_in_plane(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("v", R.turned_in_plane(part(1, 3), F.lit(30.0)))
    return d.select("vec_id", *named(F.col("v"), 3))
