"""Time lookups over events: each view with the user's nearest error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import asof
from plumbline.plans.registry import query
from plumbline.session import load

HOUR = 3_600_000_000


def micros():
    """events.ts as whole microseconds; the session's zone is UTC."""
    return F.unix_micros(F.col("ts").cast("timestamp"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "user_id", micros().alias("ts"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", micros().alias("ts"), F.col("event_id").alias("error_id"), "value")
    return asof.last_wins(found, ["user_id", "ts"], ["error_id"])


def _found(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("match.error_id").alias("error_id"), F.col("delta").alias("delta_us"))


EVENTS = """
WITH q AS (SELECT event_id, user_id, epoch_us(ts) AS ts FROM events WHERE event_type = 'view'),
t AS (SELECT user_id, epoch_us(ts) AS ts, max(event_id) AS error_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY 1, 2),
l AS (SELECT q.event_id, t.error_id, q.ts - t.ts AS d FROM q ASOF LEFT JOIN t ON q.user_id = t.user_id AND q.ts >= t.ts),
r AS (SELECT q.event_id, t.error_id, q.ts - t.ts AS d FROM q ASOF LEFT JOIN t ON q.user_id = t.user_id AND q.ts <= t.ts),
c AS (SELECT l.event_id, CASE WHEN l.d IS NULL OR l.d > -r.d THEN r.error_id ELSE l.error_id END AS error_id,
             CASE WHEN l.d IS NULL OR l.d > -r.d THEN r.d ELSE l.d END AS delta_us FROM l JOIN r USING (event_id))
"""


@query(EVENTS + "SELECT event_id, error_id, d AS delta_us FROM l")
def asof_before(spark, sf_dir):
    return _found(asof.asof_join(views(spark, sf_dir), errors(spark, sf_dir), ["user_id"], mode="before"))


@query(EVENTS + "SELECT event_id, error_id, d AS delta_us FROM r")
def asof_after(spark, sf_dir):
    return _found(asof.asof_join(views(spark, sf_dir), errors(spark, sf_dir), ["user_id"], mode="after"))


@query(EVENTS + "SELECT * FROM c")
def asof_closest(spark, sf_dir):
    return _found(asof.asof_join(views(spark, sf_dir), errors(spark, sf_dir), ["user_id"]))


@query(EVENTS + "SELECT * FROM c")
def asof_closest_spans(spark, sf_dir):
    """As asof_closest, with each user's time cut into days that are sorted apart."""
    return _found(asof.asof_join(views(spark, sf_dir), errors(spark, sf_dir), ["user_id"], bucket=24 * HOUR))


@query(EVENTS + "SELECT event_id, CASE WHEN abs(delta_us) <= 21600000000 THEN error_id END AS error_id, CASE WHEN abs(delta_us) <= 21600000000 THEN delta_us END AS delta_us FROM c")
def asof_closest_tolerance(spark, sf_dir):
    return _found(asof.asof_join(views(spark, sf_dir), errors(spark, sf_dir), ["user_id"], tolerance=6 * HOUR))


@query("""
WITH f AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT e.event_id, f.error_id, CASE WHEN f.h IS NOT NULL THEN CAST(0 AS BIGINT) END AS delta_us
FROM events e LEFT JOIN f ON e.user_id = f.user_id AND epoch_us(e.ts) // 3600000000 = f.h WHERE e.event_type = 'view'
""")
def asof_exact(spark, sf_dir):
    """Tolerance zero on whole hours: an equality join."""
    hour = F.floor(F.col("ts") / HOUR).alias("ts")
    t = asof.last_wins(errors(spark, sf_dir).select("user_id", hour, "error_id"), ["user_id", "ts"], ["error_id"])
    return _found(asof.asof_join(views(spark, sf_dir).select("event_id", "user_id", hour), t, ["user_id"], tolerance=0))


@query(EVENTS + """, s AS (SELECT q.event_id, t.ts AS ts, t.value AS value, q.ts AS q FROM q ASOF LEFT JOIN t ON q.user_id = t.user_id AND q.ts > t.ts),
u AS (SELECT q.event_id, t.ts AS ts, t.value AS value FROM q ASOF LEFT JOIN t ON q.user_id = t.user_id AND q.ts <= t.ts)
SELECT s.event_id, s.ts AS lower_us, u.ts AS upper_us, round((s.q - s.ts)::DOUBLE / (u.ts - s.ts)::DOUBLE, 6) AS alpha FROM s JOIN u USING (event_id)""")
def bracket_alpha(spark, sf_dir):
    found = asof.bracket(views(spark, sf_dir), errors(spark, sf_dir), ["user_id"])
    return found.select("event_id", F.col("lower.ts").alias("lower_us"), F.col("upper.ts").alias("upper_us"), F.round("alpha", 6).alias("alpha"))


@query("""
WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS start FROM orders),
l AS (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS d, row_number() OVER () AS k FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(d AS BIGINT) AS ship_day, CAST(o.start AS BIGINT) AS start_day
FROM l LEFT JOIN o ON l.l_orderkey = o.o_orderkey AND d >= o.start AND d < o.start + 90
""")
def interval_by_order(spark, sf_dir):
    """Line items shipped within 90 days of their order."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("start")).withColumn("end", F.col("start") + 90)
    q = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), day("l_shipdate").alias("d"))
    found = asof.interval_join(q, o, "d", "start", "end", "start", 90, ["l_orderkey"])
    return found.select("l_orderkey", "l_linenumber", F.col("d").cast("long").alias("ship_day"), F.col("clip.start").cast("long").alias("start_day"))


@query("""
WITH c AS (SELECT doc_id AS pos, doc_id * 37 % 5000 AS s, doc_id * 37 % 5000 + 8 + doc_id % 25 AS e FROM labels),
f AS (SELECT event_id, CAST(trunc(event_id * 30 / 50.0) AS BIGINT) AS f FROM events)
SELECT f.event_id, f.f AS frame, min(c.pos) AS caption FROM f LEFT JOIN c ON f.f >= c.s AND f.f < c.e GROUP BY 1, 2
""")
def caption_for_frame(spark, sf_dir):
    """The first clip of a list that holds each frame, frames counted at another rate."""
    clips = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), (F.col("doc_id") * 37 % 5000).alias("s"))
    clips = clips.withColumn("e", F.col("s") + 8 + F.col("pos") % 25)
    frames = load(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 30 / 50.0).cast("long").alias("frame"))
    return asof.interval_join(frames, clips, "frame", "s", "e", "pos", 16).select("event_id", "frame", F.col("clip.pos").alias("caption"))


@query("""
SELECT e.event_id, coalesce(l.quality, 0) AS quality, CAST(coalesce(l.toxic, 0) AS INTEGER) AS toxic, n.n_name
FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25 LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = e.event_id
""")
def gt_export_join(spark, sf_dir):
    """Rows with a head pose (inner), hands where there are any (left, zeros else), names from a small dimension."""
    e, n = load(spark, sf_dir, "events"), load(spark, sf_dir, "nation")
    hands = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # nation has 25 rows at every scale
    held = e.join(F.broadcast(n), F.col("n_nationkey") == F.col("user_id") % 25).join(hands, F.col("doc_id") == F.col("event_id"), "left")
    return held.select("event_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n_name")
