"""Slices, samples, thresholds, fits and packing over events, order lines and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import points
from plumbline.functions import rotation as R
from plumbline.operators import tracks
from plumbline.plans.geometry import MATRIX, UNIT_QUAT, E, named, part, sql_columns, vectors
from plumbline.plans.registry import query
from plumbline.plans.sequences import FRAMES, ISLANDS, frames
from plumbline.session import load


@query(f"SELECT vec_id, round(e[1]) <> 0 OR round(e[2]) <> 0 AS moved FROM {E}")
def any_nonzero(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", points.any_nonzero(F.transform(part(1, 2), lambda x: F.round(x))).alias("moved"))


@query(f"SELECT vec_id FROM {E} WHERE abs(e[1]) < 1 AND abs(e[2]) < 1 ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 100")
def confident_sample(spark, sf_dir):
    sure = vectors(spark, sf_dir).where((F.abs(R.at(F.col("e"), 0)) < 1) & (F.abs(R.at(F.col("e"), 1)) < 1))
    return tracks.at_most(sure.select("vec_id"), 100, "vec_id")


SLICE = "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) WHERE "


@query(SLICE + "i >= 2 AND i < 5")
def index_slice(spark, sf_dir):
    return tracks.index_slice(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 2, 5).select("user_id", "event_id")


@query(SLICE + "i >= 1")
def skip_first(spark, sf_dir):
    return tracks.index_slice(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 1).select("user_id", "event_id")


@query("SELECT user_id, coalesce(string_agg(CASE WHEN value >= 50 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id), '') AS visible FROM events GROUP BY 1")
def visible_lists(spark, sf_dir):
    found = tracks.ragged(load(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") >= 50, "event_id")
    return found.select("user_id", F.array_join("event_id", ",").alias("visible"))


@query("SELECT event_id, event_type FROM events WHERE event_type LIKE 'p%'")
def stream_prefix(spark, sf_dir):
    return load(spark, sf_dir, "events").where(F.col("event_type").startswith("p")).select("event_id", "event_type")


@query(ISLANDS + ", h AS (SELECT *, frame % 2 AS hand FROM i) SELECT user_id, chunk_id, min(frame) AS start, max(frame) AS \"end\", count(*) AS n, min_by(hand, frame) AS hand FROM h GROUP BY 1, 2")
def islands_with_hand(spark, sf_dir):
    return tracks.islands_with(frames(spark, sf_dir).withColumn("hand", F.col("frame") % 2), ["user_id"], "frame", "hand")


@query(ISLANDS + "SELECT user_id, chunk_id, frame, CAST((row_number() OVER (PARTITION BY user_id, chunk_id ORDER BY frame) - 1) // 2 AS BIGINT) AS window_id FROM i")
def windows_in_islands(spark, sf_dir):
    return tracks.windows_in_islands(frames(spark, sf_dir), ["user_id"], "frame", 2)


@query(FRAMES + " SELECT k.user_id, r.range AS frame, f.frame IS NOT NULL AS valid FROM (SELECT DISTINCT user_id FROM f) k CROSS JOIN range(120) r LEFT JOIN f ON f.user_id = k.user_id AND f.frame = r.range")
def padded_windows(spark, sf_dir):
    return tracks.padded(frames(spark, sf_dir), ["user_id"], "frame", 120)


@query(FRAMES + " SELECT user_id, frame, coalesce(frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame) <> 1, true) AS sent FROM f")
def first_sight(spark, sf_dir):
    return tracks.first_sight(frames(spark, sf_dir), ["user_id"], "frame")


@query("SELECT l_suppkey, round(median(CASE WHEN l_quantity BETWEEN 10 AND 40 THEN l_extendedprice / 1000 - l_quantity END), 6) AS shift FROM lineitem GROUP BY 1")
def median_offset(spark, sf_dir):
    found = tracks.median_offset(load(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_extendedprice") / 1000, F.col("l_quantity"), 10, 40)
    return found.select("l_suppkey", F.round("offset", 6).alias("shift"))


def _fit_sql(scaled: bool) -> str:
    """Three rounds of weighted sums."""
    out, w = "WITH d AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), f0 AS (SELECT DISTINCT k, 0.0::DOUBLE AS scale, 0.0::DOUBLE AS shift FROM d)", "1.0::DOUBLE"
    for i in range(1, 4):
        slope = "coalesce((n * xy - sx * sy) / nullif(n * xx - sx * sx, 0), 1)" if scaled else "1.0::DOUBLE"
        out += f""", s{i} AS (SELECT k, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM (SELECT d.*, {w} AS w FROM d JOIN f{i - 1} f USING (k)) GROUP BY k),
f{i} AS (SELECT k, scale, (sy - scale * sx) / nullif(n, 0) AS shift FROM (SELECT *, {slope} AS scale FROM s{i}))"""
        w = "power(100.0::DOUBLE / (100.0::DOUBLE + power(y - scale * x - shift, 2)), 2)"
    return out + " SELECT k AS l_suppkey, round(scale, 4) AS scale, round(shift, 4) AS shift FROM f3"


def _fitted(spark, sf_dir, scaled: bool):
    found = tracks.scale_and_shift(load(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_quantity"), F.col("l_extendedprice") / 1000, sigma=10.0, scaled=scaled)
    return found.select("l_suppkey", F.round("scale", 4).alias("scale"), F.round("shift", 4).alias("shift"))


@query(_fit_sql(True))
def scale_and_shift(spark, sf_dir):
    return _fitted(spark, sf_dir, True)


@query(_fit_sql(False))
def shift_only(spark, sf_dir):
    return _fitted(spark, sf_dir, False)


@query("""WITH n AS (SELECT l_suppkey, l_orderkey, least(min(ceil(round(greatest(20 - l_quantity, l_quantity - 22, 0) / 5.0::DOUBLE, 9))), 100) AS m FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, max(m) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS steps FROM n) SELECT l_suppkey, l_orderkey, round(20 - 5 * steps, 6) AS near, round(22 + 5 * steps, 6) AS far FROM s""")
def widened_thresholds(spark, sf_dir):
    found = tracks.widened(load(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", F.col("l_quantity"), 20.0, 22.0, 5.0)
    return found.select("l_suppkey", "l_orderkey", F.round("near", 6).alias("near"), F.round("far", 6).alias("far"))


@query()
def mean_rotation(spark, sf_dir):
    """Held against numpy in the tests."""
    m = R.matrix_from_quat(part(1, 4))
    d = vectors(spark, sf_dir).select("label", F.flatten(m).alias("m"))
    return tracks.mean_rotation(d, ["label"], "m").select("label", *(F.round(F.get("m", i), 6).alias(f"m{i}") for i in range(9)))


@query()
def nearest_rotation(spark, sf_dir):
    """Nine numbers made a rotation; held against numpy in the tests."""
    d = vectors(spark, sf_dir).withColumn("m", tracks.nearest_rotation(part(1, 9)))
    return d.select("vec_id", *(F.round(F.get("m", i), 6).alias(f"m{i}") for i in range(9)))


@query(f"""WITH p AS (SELECT label, e[1] AS x, e[2] AS y, e[3] + 5 AS z, e[4] AS u, e[5] AS v, power(e[6], 2) AS w FROM (SELECT em.label, t.* FROM embeddings em JOIN {E} t USING (vec_id))),
s AS (SELECT label, sum(w) AS n, sum(w * u) AS u, sum(w * v) AS v, sum(w * (u * u + v * v)) AS q, sum(w * (u * z - x)) AS b, sum(w * (v * z - y)) AS c, sum(-w * (u * (u * z - x) + v * (v * z - y))) AS d FROM p GROUP BY 1),
t AS (SELECT *, (n * d + u * b + v * c) / (n * q - u * u - v * v) AS t2 FROM s) SELECT label, round((b + u * t2) / n, 5) AS tx, round((c + v * t2) / n, 5) AS ty, round(t2, 5) AS tz FROM t""")
def camera_translation(spark, sf_dir):
    x = [R.at(F.col("e"), i) for i in range(6)]
    found = tracks.camera_translation(vectors(spark, sf_dir), ["label"], F.array(x[0], x[1], x[2] + 5), F.array(x[3], x[4]), x[5])
    return found.select("label", *(F.round(c, 5).alias(c) for c in ("tx", "ty", "tz")))


HANDS = "SELECT vec_id // 2 AS frame, vec_id % 2 = 1 AS is_right, e FROM {}"


@query(f"SELECT frame, {', '.join(f'''round(coalesce(max(e[{i % 3 + 1}]) FILTER (is_right = {i > 2}), 0), 6) AS x{i}''' for i in range(6))} FROM ({HANDS.format(E)}) GROUP BY 1")
def packed_hands(spark, sf_dir):
    d = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 2).alias("frame"), (F.col("vec_id") % 2 == 1).alias("is_right"), part(1, 3).alias("x"))
    return tracks.side_by_side(d, ["frame"], F.col("is_right"), "x", 3).select("frame", *named(F.col("x"), 6))


@query(f"SELECT vec_id, h.is_right, {sql_columns(['e[1 + h.o]', 'e[2 + h.o]', 'e[3 + h.o]'])} FROM {E}, (VALUES (false, 0), (true, 3)) h(is_right, o)")
def unpacked_hands(spark, sf_dir):
    d = vectors(spark, sf_dir).select("vec_id", part(1, 6).alias("x"))
    return tracks.one_by_one(d, "x", 3).select("vec_id", "is_right", *named(F.col("x"), 3))


@query("SELECT label, bit_or(1::BIGINT << (vec_id % 40)) AS mask FROM embeddings GROUP BY 1")
def accumulated_masks(spark, sf_dir):
    return tracks.any_mask(load(spark, sf_dir, "embeddings"), ["label"], F.expr("shiftleft(1L, CAST(vec_id % 40 AS INT))"))


@query("SELECT user_id, date_trunc('day', ts) AS day, bool_and(value >= 5) AS valid FROM events GROUP BY 1, 2")
def all_valid(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.bool_and(F.col("value") >= 5).alias("valid"))


ANCHORS = "SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS i, count(*) OVER w AS n, min(l_quantity) OVER w AS a, max(l_quantity) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)"


def _anchors(spark, sf_dir):
    ends = F.struct(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), F.count("*").alias("n"))
    lines = load(spark, sf_dir, "lineitem")
    ends = lines.groupBy("l_orderkey").agg(ends.alias("s")).select("l_orderkey", "s.*")
    return lines.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("i")).join(ends, "l_orderkey")


@query(f"SELECT l_orderkey, l_linenumber, round(a + (b - a) * coalesce(i / nullif(n - 1, 0)::DOUBLE, 0), 6) AS x FROM ({ANCHORS})")
def lerp_between(spark, sf_dir):
    d = _anchors(spark, sf_dir)
    return d.select("l_orderkey", "l_linenumber", F.round(points.lerp_between(F.col("i"), F.col("n"), F.col("a"), F.col("b")), 6).alias("x"))


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN i < 1 THEN a + (25 - a) * i / 1.0::DOUBLE ELSE 25 + (b - 25) * coalesce((i - 1) / nullif(n - 2, 0)::DOUBLE, 0) END, 6) AS x FROM ({ANCHORS})")
def lerp_by_middle(spark, sf_dir):
    d = _anchors(spark, sf_dir)
    x = points.lerp_between(F.col("i"), F.col("n"), F.col("a"), F.col("b"), F.lit(25.0), F.lit(1))
    return d.select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN i = 0 OR i = n - 1 THEN l_linenumber::DOUBLE ELSE 0.1::DOUBLE END AS x FROM ({ANCHORS})")
def constant_fill(spark, sf_dir):
    d = _anchors(spark, sf_dir)
    x = points.anchored(F.col("l_linenumber").cast("double"), (F.col("i") == 0) | (F.col("i") == F.col("n") - 1))
    return d.select("l_orderkey", "l_linenumber", x.alias("x"))


@query(f"""WITH q AS (SELECT vec_id, w, x, y, z FROM {UNIT_QUAT}), p AS (SELECT a.vec_id, a.w AS w0, a.x AS x0, a.y AS y0, a.z AS z0, b.w, b.x, b.y, b.z, a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z AS t FROM q a JOIN q b ON b.vec_id = a.vec_id + 1),
c AS (SELECT *, least(abs(t), 1.0::DOUBLE) AS k, acos(least(abs(t), 1.0::DOUBLE)) AS o, CASE WHEN t < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM p),
f AS (SELECT *, CASE WHEN 1 - k < 0.01 THEN 0.7::DOUBLE ELSE sin(0.7::DOUBLE * o) / sin(o) END AS f0, s * CASE WHEN 1 - k < 0.01 THEN 0.3::DOUBLE ELSE sin(0.3::DOUBLE * o) / sin(o) END AS f1 FROM c),
r AS (SELECT vec_id, {', '.join(f'f0 * {a}0 + f1 * {a} AS r{a}' for a in 'wxyz')} FROM f), m AS (SELECT *, sqrt(rw * rw + rx * rx + ry * ry + rz * rz) AS n FROM r)
SELECT vec_id, {sql_columns([f'r{a} / n' for a in 'wxyz'])} FROM m""")
def slerp_short(spark, sf_dir):
    d = vectors(spark, sf_dir).select("vec_id", R.unit(part(1, 4), 4).alias("a"))
    pairs = d.join(d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", *named(points.slerp_short(F.col("a"), F.col("b"), F.lit(0.3)), 4))


@query(f"SELECT vec_id, {', '.join(f'''round(({MATRIX[3 * i]}) * r[1] + ({MATRIX[3 * i + 1]}) * r[2] + ({MATRIX[3 * i + 2]}) * r[3] + t[{i + 1}] + (m[{i + 1}] - r[{i + 1}]), 6) AS x{i}''' for i in range(3))} FROM (SELECT u.*, e[5:7] AS t, e[8:10] AS r, e[11:13] AS m FROM {UNIT_QUAT} u JOIN {E} USING (vec_id))")
def camera_to_world(spark, sf_dir):
    d = vectors(spark, sf_dir)
    p = points.camera_to_world(R.matrix_from_quat(part(1, 4)), part(5, 3), part(8, 3), part(11, 3))
    return d.select("vec_id", *named(p, 3))


SIDE = "CAST(trunc(least(greatest((lo{0} + hi{0}) / 2 - (hi{0} - lo{0}) / 2 * 1.2::DOUBLE, 0), {1})) AS INTEGER)", "CAST(trunc(least(greatest((lo{0} + hi{0}) / 2 + (hi{0} - lo{0}) / 2 * 1.2::DOUBLE, 0), {1})) AS INTEGER)"


@query(f"SELECT vec_id, {SIDE[0].format('x', 639)} AS \"left\", {SIDE[0].format('y', 479)} AS top, greatest({SIDE[1].format('x', 640)}, {SIDE[0].format('x', 639)} + 1) AS \"right\", greatest({SIDE[1].format('y', 480)}, {SIDE[0].format('y', 479)} + 1) AS bottom FROM (SELECT vec_id, least(e[1], e[3]) * 200 + 300 AS lox, greatest(e[1], e[3]) * 200 + 300 AS hix, least(e[2], e[4]) * 200 + 200 AS loy, greatest(e[2], e[4]) * 200 + 200 AS hiy FROM {E})")
def scaled_box(spark, sf_dir):
    x = [R.at(F.col("e"), i) * 200 + (300 if i % 2 == 0 else 200) for i in range(4)]
    d = vectors(spark, sf_dir).withColumn("b", points.scaled_box(F.array(F.array(x[0], x[1]), F.array(x[2], x[3])), 0.2, 640, 480))
    return d.select("vec_id", "b.*")


@query("SELECT p_partkey, CAST(greatest(p_size, 20) AS DOUBLE) AS focal, p_size / 2 AS cx, 10.0::DOUBLE AS cy, round(sqrt(p_size * p_size + 400), 6) AS diagonal FROM part")
def guessed_camera(spark, sf_dir):
    w, h = F.col("p_size"), F.lit(20)
    d = load(spark, sf_dir, "part")
    return d.select("p_partkey", points.guessed_camera(w, h).alias("c"), F.round(points.guessed_camera(w, h, True)["focal"], 6).alias("diagonal")).select("p_partkey", "c.*", "diagonal")


@query(f"SELECT vec_id, {sql_columns(['e[5]', 'e[1]', 'e[4]', 'e[2]', 'e[3]'])} FROM {E}")
def remapped_joints(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", *named(points.remapped(F.col("e"), [4, 0, 3, 1, 2]), 5))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def lower_keys(spark, sf_dir):
    m = points.lower_keys(F.from_json(F.upper("props"), "map<string,string>"))
    return load(spark, sf_dir, "events").select("event_id", m["k"].alias("k"))


@query(f"SELECT label, count(*) AS n, round(avg(abs(e[1])) * 1000, 4) AS error_mm, round(max(abs(e[2])) * 100, 4) AS rte_percent FROM (SELECT em.label, t.e FROM embeddings em JOIN {E} t USING (vec_id)) GROUP BY 1")
def errors_in_units(spark, sf_dir):
    x, y = R.at(F.col("e"), 0), R.at(F.col("e"), 1)
    return vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(x)) * 1e3, 4).alias("error_mm"), F.round(F.max(F.abs(y)) * 1e2, 4).alias("rte_percent"))


@query(FRAMES + ", n AS (SELECT user_id, count(*) AS length FROM f GROUP BY 1) SELECT user_id, length, row_number() OVER (ORDER BY length DESC, user_id) AS place FROM n")
def tracks_by_length(spark, sf_dir):
    """Places are counted by length first, then inside it, so that no task orders all tracks."""
    from pyspark.sql import Window

    n = frames(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("length"))
    longer = n.groupBy("length").agg(F.count("*").alias("same")).withColumn("before", F.coalesce(F.sum("same").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("before") + F.row_number().over(Window.partitionBy("length").orderBy("user_id"))
    return n.join(F.broadcast(longer), "length").select("user_id", "length", place.cast("long").alias("place"))  # a row a different length


@query("SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT user_id, ts FROM events)")
def sorted_times(spark, sf_dir):
    from plumbline.operators.segments import numbered

    return numbered(load(spark, sf_dir, "events").select("user_id", "ts").distinct(), ["user_id"], ["ts"], "i")


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_ids(spark, sf_dir):
    return load(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT user_id FROM events WHERE event_type = 'error'")
def union_of_streams(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.where("event_type = 'view'").select("user_id").union(e.where("event_type = 'error'").select("user_id")).distinct()


@query("""SELECT user_id, hand, event_id, row_number() OVER (PARTITION BY user_id, hand ORDER BY date_trunc('day', ts), track, ts, event_id) - 1 AS i
FROM (SELECT *, event_type IN ('view', 'click') AS hand, CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 0 ELSE 1 END AS track FROM events)""")
def concatenated_tracks(spark, sf_dir):
    """Tracks of a side one after another, ordered by day; rows of a day keep the tracks' order, then their own."""
    from plumbline.operators.segments import numbered

    e = load(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    side = [e.where(F.col("event_type").isin("view", "click")).withColumn("hand", F.lit(True)), e.where(~F.col("event_type").isin("view", "click")).withColumn("hand", F.lit(False))]
    both = side[0].unionByName(side[1]).withColumn("track", F.when(F.col("event_type").isin("view", "error"), 0).otherwise(1))
    return numbered(both, ["user_id", "hand"], ["day", "track", "ts", "event_id"], "i").select("user_id", "hand", "event_id", "i")


@query(FRAMES + ", c AS (SELECT l_orderkey AS frame, sum(l_quantity) AS camera FROM lineitem GROUP BY 1) SELECT user_id, frame, camera FROM f JOIN c USING (frame)")
def gathered_frames(spark, sf_dir):
    camera = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.sum("l_quantity").alias("camera"))
    return tracks.gathered(camera, frames(spark, sf_dir)).select("user_id", "frame", "camera")


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS ts, value, event_type FROM events), a AS (SELECT user_id, ts, min(value) AS truth FROM h WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
b AS (SELECT user_id, ts, min(value) AS found FROM h WHERE event_type NOT IN ('view', 'click') GROUP BY 1, 2) SELECT user_id, count(*) AS n, round(sqrt(avg(power(truth - found, 2))), 6) AS ate FROM a JOIN b USING (user_id, ts) GROUP BY 1""")
def associated_error(spark, sf_dir):
    h = load(spark, sf_dir, "events").withColumn("ts", F.date_trunc("hour", "ts"))
    truth = F.col("event_type").isin("view", "click")
    pairs = tracks.associated(h.where(truth), h.where(~truth), ["user_id"], "ts", "value")
    return pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("truth") - F.col("found"), F.lit(2)))), 6).alias("ate"))


@query(ISLANDS + ", c AS (SELECT user_id, min(frame) AS s, max(frame) AS e FROM i GROUP BY user_id, chunk_id) SELECT user_id, '[' || string_agg('[' || s || ',' || e || ']', ',' ORDER BY s) || ']' AS segments FROM c GROUP BY 1")
def segment_lists(spark, sf_dir):
    from plumbline.operators import segments

    runs = segments.islands(frames(spark, sf_dir), ["user_id"])
    return runs.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.array("start", "end")))).alias("segments"))
