"""Tracks of events in hours, masks of labels, gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import asof, fill, masks, segments
from plumbline.plans.lookup import HOUR, micros
from plumbline.plans.registry import query
from plumbline.session import load

START = 1_704_067_200_000_000


def frames(spark, sf_dir):
    """Each user's different hours since 2024 as frames of a track."""
    e = load(spark, sf_dir, "events").select("user_id", F.floor((micros() - START) / HOUR).alias("frame"))
    return e.distinct()


FRAMES = "WITH f AS (SELECT DISTINCT user_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS BIGINT) AS frame FROM events)"
ISLANDS = FRAMES + """, s AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <> 1 THEN 1 ELSE 0 END AS b FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
i AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY frame) AS BIGINT) AS chunk_id FROM s)
"""


@query(ISLANDS + 'SELECT user_id, chunk_id, min(frame) AS start, max(frame) AS "end", count(*) AS n FROM i GROUP BY 1, 2')
def track_islands(spark, sf_dir):
    return segments.islands(frames(spark, sf_dir), ["user_id"])


@query(ISLANDS + 'SELECT user_id, chunk_id, min(frame) AS start, max(frame) AS "end", count(*) AS n FROM i GROUP BY 1, 2 HAVING count(*) >= 2')
def track_islands_minlen(spark, sf_dir):
    return segments.islands(frames(spark, sf_dir), ["user_id"], min_len=2)


@query("SELECT vec_id // 1000 AS window_id, min(vec_id) AS start, max(vec_id) + 1 AS \"end\" FROM embeddings GROUP BY 1")
def fixed_windows_1000(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return e.groupBy(F.floor(F.col("vec_id") / 1000).alias("window_id")).agg(F.min("vec_id").alias("start"), (F.max("vec_id") + 1).alias("end"))


@query("SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 100 AS window_id, vec_id FROM embeddings")
def window_100(spark, sf_dir):
    rows = segments.numbered(load(spark, sf_dir, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"])
    return rows.select("label", F.floor(F.col("rn") / 100).alias("window_id"), "vec_id")


@query("SELECT user_id, CASE WHEN avg(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) < 0.5 THEN 0 ELSE 1 END AS hand, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def handedness_vote(spark, sf_dir):
    return segments.vote(load(spark, sf_dir, "events"), ["user_id"], F.col("event_type").isin("view", "click"), F.col("event_type") != "error")


@query("""
SELECT h, hand, min(event_id) AS event_id FROM (SELECT epoch_us(ts) // 3600000000 AS h, CAST(user_id % 2 AS BIGINT) AS hand, event_id FROM events) GROUP BY 1, 2
""")
def first_per_hand_per_frame(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.floor(micros() / HOUR).alias("h"), (F.col("user_id") % 2).alias("hand"), "event_id")
    return asof.first_wins(e, ["h", "hand"], ["event_id"])


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN user_id WHEN value > 50 THEN 10000 ELSE 5000 END AS track_id FROM events")
def default_track_id(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", segments.default_track(F.when(F.col("event_type") == "view", F.col("user_id")), F.when(F.col("value") > 50, 1).otherwise(0)).cast("long").alias("track_id"))


@query("""
WITH b AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.user_id, e.event_id FROM events e JOIN b USING (user_id) WHERE e.event_id BETWEEN lo AND hi
""")
def trim_nonzero(spark, sf_dir):
    return segments.trim(load(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase").select("user_id", "event_id")


@query("""
SELECT user_id, event_id, coalesce(max(CASE WHEN event_type IN ('view', 'click') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous FROM events
""")
def prev_both_valid(spark, sf_dir):
    return segments.previous_valid(load(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type").isin("view", "click")).select("user_id", "event_id", "previous")


@query("""
WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS v FROM events),
g AS (SELECT user_id, event_id, v, coalesce(max(CASE WHEN v THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
      max(event_id) OVER (PARTITION BY user_id) AS last FROM e)
SELECT user_id, start, least(max(last), start + 120) AS "end", count(*) AS missing FROM g WHERE NOT v GROUP BY 1, 2
""")
def infill_windows(spark, sf_dir):
    return segments.fill_windows(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") != "error")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events)
SELECT user_id, rn // 4 AS group_id, max(CASE WHEN rn % 4 = 1 THEN event_id END) AS start, max(CASE WHEN rn % 4 = 2 THEN event_id END) AS "end" FROM r GROUP BY 1, 2 HAVING count(*) = 4
""")
def groups_of_four(spark, sf_dir):
    return segments.groups_of(load(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 4, 1, 2, "event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events) WHERE rn % 3 = 0 AND rn < 30")
def stride_sample(spark, sf_dir):
    """Every third frame of a track, ten at most: a sampling operator."""
    return segments.numbered(load(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"]).where("rn % 3 = 0 and rn < 30").drop("rn")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def caption_changes(spark, sf_dir):
    return segments.changes(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query("SELECT event_id, CASE WHEN i < 10 THEN i / 10.0::DOUBLE WHEN 25 - i <= 10 THEN (25 - i) / 10.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM (SELECT event_id, event_id % 25 AS i FROM events)")
def caption_fade(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", segments.fade(F.col("event_id") % 25, F.lit(0), F.lit(25)).cast("double").alias("weight"))


@query("SELECT n.user_id, frame FROM (SELECT user_id, unnest(range(0, 50)) AS frame FROM (SELECT DISTINCT user_id FROM events)) n ANTI JOIN (SELECT user_id, event_id % 50 AS frame FROM events) e USING (user_id, frame)")
def missing_frames(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    all_ = segments.dense(e.select("user_id").distinct().withColumn("n", F.lit(50).cast("long")), ["user_id"], "n")
    return masks.missing(e.select("user_id", (F.col("event_id") % 50).alias("frame")), all_.select("user_id", F.col("frame").cast("long").alias("frame")), ["user_id", "frame"])


def _masks(spark, sf_dir):
    rows = load(spark, sf_dir, "labels")
    return [rows.select("doc_id", (F.col(c) == 1).alias("mask")) for c in ("quality", "toxic")]


@query("SELECT doc_id, quality = 1 AND toxic = 1 AS mask FROM labels")
def mask_and(spark, sf_dir):
    return masks.combine(_masks(spark, sf_dir), ["doc_id"], "and")


@query("SELECT doc_id, quality = 1 OR toxic = 1 AS mask FROM labels")
def mask_or(spark, sf_dir):
    return masks.combine(_masks(spark, sf_dir), ["doc_id"], "or")


@query("SELECT doc_id % 5 AS stream, count(*) AS length, count(*) FILTER (quality = 1) AS num_true, count(*) FILTER (quality <> 1) AS num_false FROM labels GROUP BY 1")
def mask_stats(spark, sf_dir):
    return masks.stats(load(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("stream"), (F.col("quality") == 1).alias("mask")), ["stream"])


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def seen_anti(spark, sf_dir):
    """What was not seen, to be cleared."""
    return load(spark, sf_dir, "labels").select("doc_id").join(load(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct(), "doc_id", "left_anti")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER a AS lx, last_value(v IGNORE NULLS) OVER a AS ly,
      first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS rx, first_value(v IGNORE NULLS) OVER b AS ry, count(v) OVER (PARTITION BY user_id) AS c
      FROM e WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(CASE WHEN c < 2 THEN v ELSE coalesce(v, ly + (ry - ly) * (event_id - lx)::DOUBLE / nullif(rx - lx, 0)::DOUBLE, ly, ry) END, 6) AS value FROM n
""")
def linear_fill_clamped(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return fill.fill_linear(e, ["user_id"], "event_id", "value").select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("""
SELECT s.*, l.n AS n FROM (SELECT CAST(doc_id % 7 AS BIGINT) AS stream, count(*) AS length, count(*) FILTER (quality = 1) AS num_true, count(*) FILTER (quality <> 1) AS num_false FROM labels WHERE doc_id % 7 < 5 GROUP BY 1
  UNION ALL SELECT x, 0, 0, 0 FROM (SELECT DISTINCT CAST(doc_id % 7 AS BIGINT) AS x FROM labels) WHERE x >= 5) s, (SELECT count(DISTINCT doc_id % 7) AS n FROM labels) l
""")
def mask_stats_absent(spark, sf_dir):
    """Statistics of all streams, of which two have no mask."""
    rows = load(spark, sf_dir, "labels").select((F.col("doc_id") % 7).alias("stream"), (F.col("quality") == 1).alias("mask"))
    found = masks.stats(rows.where("stream < 5"), ["stream"], of=rows)
    return found.join(F.broadcast(rows.agg(F.count_distinct("stream").alias("n"))))  # one row


BOXES = "b AS (SELECT label, vec_id, CASE WHEN vec_id % 4 = 0 OR vec_id < 30 OR vec_id % 97 > 90 THEN NULL ELSE list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings)"


def _line(i: int) -> str:
    return f"round(CASE WHEN v IS NOT NULL THEN v[{i}] WHEN a.vec_id IS NULL OR z.vec_id IS NULL THEN 0.0::DOUBLE ELSE a.v[{i}] + (z.v[{i}] - a.v[{i}]) * (x.vec_id - a.vec_id)::DOUBLE / (z.vec_id - a.vec_id) END, 6) + 0.0 AS x{i - 1}"


@query(f"""
WITH {BOXES}, g AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM b WHERE v IS NOT NULL),
x AS (SELECT label, vec_id, v, count(v) OVER (PARTITION BY label ORDER BY vec_id) AS k, count(v) OVER (PARTITION BY label) AS n FROM b)
SELECT x.label, x.vec_id, {", ".join(_line(i).replace("WHEN v IS", "WHEN x.v IS").replace("THEN v[", "THEN x.v[") for i in range(1, 6))}
FROM x LEFT JOIN g a ON a.label = x.label AND a.k = least(greatest(x.k, 1), x.n - 1) LEFT JOIN g z ON z.label = x.label AND z.k = least(greatest(x.k, 1), x.n - 1) + 1
""")
def boxes_filled(spark, sf_dir):
    """Boxes of zeros between, before and behind those that there are."""
    d = load(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("v"))
    lost = (F.col("vec_id") % 4 == 0) | (F.col("vec_id") < 30) | (F.col("vec_id") % 97 > 90)
    rows = d.withColumn("v", F.when(lost, F.array_repeat(F.lit(0.0), 5)).otherwise(F.col("v")))
    made = fill.fill_boxes(rows, ["label"], "vec_id", "v")
    return made.select("label", "vec_id", *((F.round(F.get("v", F.lit(i)), 6) + 0.0).alias(f"x{i}") for i in range(5)))


SLERP = "CASE WHEN abs(c) > 1 - 1e-8 THEN {flat} ELSE sin({t} * acos(least(abs(c), 1))) / sin(acos(least(abs(c), 1))) END"
UNITS = ", ".join(f"CASE WHEN vec_id % 3 <> 1 THEN e[{i + 1}] / sqrt(e[1]**2 + e[2]**2 + e[3]**2 + e[4]**2) END AS {q}" for i, q in enumerate("wxyz"))


@query(f"""
WITH u AS (SELECT label, vec_id, {UNITS} FROM (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)),
n AS (SELECT *, count(w) OVER (PARTITION BY label) AS n, {", ".join(f"last_value({q} IGNORE NULLS) OVER a AS l{q}, first_value({q} IGNORE NULLS) OVER b AS r{q}" for q in "wxyz")},
  last_value(CASE WHEN w IS NOT NULL THEN vec_id END IGNORE NULLS) OVER a AS lt, first_value(CASE WHEN w IS NOT NULL THEN vec_id END IGNORE NULLS) OVER b AS rt
  FROM u WINDOW a AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT *, (vec_id - lt)::DOUBLE / (rt - lt) AS t, lw * rw + lx * rx + ly * ry + lz * rz AS c FROM n),
p AS (SELECT *, {SLERP.format(flat="1 - t", t="(1 - t)")} AS p, sign(c) * {SLERP.format(flat="t", t="t")} AS q FROM t),
m AS (SELECT *, {", ".join(f"p * l{q} + q * r{q} AS m{q}" for q in "wxyz")} FROM p)
SELECT label, vec_id, {", ".join(f"round(CASE WHEN n < 2 THEN {q} WHEN {q} IS NOT NULL THEN {q} WHEN lt IS NULL THEN r{q} WHEN rt IS NULL THEN l{q} ELSE m{q} / sqrt(mw * mw + mx * mx + my * my + mz * mz) END, 6) + 0.0 AS {q}" for q in "wxyz")} FROM m
""")
def slerp_fill(spark, sf_dir):
    """Every third rotation of a track is filled along the arc between its neighbours."""
    from plumbline.functions import rotation

    q = rotation.unit(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 4), 4)
    rows = load(spark, sf_dir, "embeddings").select("label", "vec_id", F.when(F.col("vec_id") % 3 != 1, q).alias("q"))
    made = fill.fill_rotations(rows, ["label"], "vec_id", "q")
    return made.select("label", "vec_id", *((F.round(F.get("q", F.lit(i)), 6) + 0.0).alias(n) for i, n in enumerate("wxyz")))
