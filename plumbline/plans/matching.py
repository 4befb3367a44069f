"""Times matched one to one, masks as runs, meshes, checked keys and report lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import association, metrics, references, runs, updates
from plumbline.plans.geometry import E, vectors
from plumbline.plans.lookup import HOUR, micros
from plumbline.plans.registry import query
from plumbline.session import load


@query("""
WITH RECURSIVE t AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'), f AS (SELECT DISTINCT user_id, epoch_us(ts) AS f FROM events WHERE event_type = 'click'),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(t - f), t, f) AS i FROM t JOIN f USING (user_id) WHERE abs(t - f) <= 43200000000),
m AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS fs FROM p
  UNION ALL SELECT user_id, i, CASE WHEN ok THEN list_append(ts, t) ELSE ts END, CASE WHEN ok THEN list_append(fs, f) ELSE fs END
  FROM (SELECT p.user_id, p.i, t, f, ts, fs, NOT list_contains(ts, t) AND NOT list_contains(fs, f) AS ok FROM m JOIN p ON p.user_id = m.user_id AND p.i = m.i + 1))
SELECT user_id, unnest(ts) AS truth, unnest(fs) AS found FROM (SELECT user_id, max_by(ts, i) AS ts, max_by(fs, i) AS fs FROM m GROUP BY 1)
""")
def matched_times(spark, sf_dir):
    """A user's views and clicks within twelve hours, one to one, nearest first."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", micros().alias("ts"))
    return association.matched(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"], "ts", 12 * HOUR)


#: Masks of 20 x 15 pixels, in which a vector's 64 numbers stand from a place of its own on, row by row.
HEIGHT, WIDTH, PLACES = 20, 15, 237
PIXELS = f"x AS (SELECT vec_id, q, coalesce(e[q % {HEIGHT} * {WIDTH} + q // {HEIGHT} - vec_id % {PLACES} + 1] > 0, false) AND q % {HEIGHT} * {WIDTH} + q // {HEIGHT} >= vec_id % {PLACES} AS p FROM (SELECT vec_id, e, unnest(range(0, {HEIGHT * WIDTH})) AS q FROM {E}))"


def _run_lengths(pixels: str, key: str) -> str:
    """SQL: key, runs and area of rows (key, q, p)."""
    turns = f"SELECT *, CASE WHEN q = 0 OR p <> lag(p) OVER w THEN 1 ELSE 0 END AS b FROM {pixels} WINDOW w AS (PARTITION BY {key} ORDER BY q)"
    lengths = f"SELECT {key}, r, any_value(p) AS p, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY {key} ORDER BY q) AS r FROM ({turns})) GROUP BY ALL"
    return f"SELECT {key}, CASE WHEN arg_min(p, r) THEN '0 ' ELSE '' END || string_agg(n, ' ' ORDER BY r) AS runs, CAST(coalesce(sum(n) FILTER (p), 0) AS BIGINT) AS area FROM ({lengths}) GROUP BY ALL"


def _masks(spark, sf_dir):
    number = lambda r, c: r * WIDTH + c - F.col("vec_id") % PLACES
    on = lambda r, c: F.when(number(r, c) >= 0, F.get("e", number(r, c).cast("int")) > 0)
    rows = F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda c: on(r, c)))
    return vectors(spark, sf_dir).withColumn("rows", rows).select("vec_id", runs.encode(runs.by_columns(F.col("rows"))).alias("runs"))


@query(f"WITH {PIXELS} {_run_lengths('x', 'vec_id')}")
def mask_runs(spark, sf_dir):
    """Run lengths column by column, decoded and encoded again."""
    again = _masks(spark, sf_dir).withColumn("runs", runs.encode(runs.decode(F.col("runs"))))
    return again.select("vec_id", F.array_join(F.col("runs").cast("array<string>"), " ").alias("runs"), runs.area(F.col("runs")).alias("area"))


@query(f"""
WITH {PIXELS}, g AS (SELECT vec_id % 10 AS track, vec_id // {PLACES} AS turn, q, count(*) FILTER (p) AS n, count(*) AS total FROM x GROUP BY ALL),
k AS (SELECT 'union' AS kind, track, turn, q, n >= 1 AS p FROM g UNION ALL SELECT 'two', track, turn, q, n >= 2 FROM g UNION ALL SELECT 'all', track, turn, q, n = total FROM g)
{_run_lengths('k', 'kind, track, turn')}
""")
def mask_overlays(spark, sf_dir):
    """Masks of a track laid over each other: where any, two at least, or all are set."""
    own = _masks(spark, sf_dir).select((F.col("vec_id") % 10).alias("track"), F.floor(F.col("vec_id") / PLACES).alias("turn"), "runs")
    out = None
    for kind, least in (("union", 1), ("two", 2), ("all", None)):
        made = runs.combined(own, ["track", "turn"], "runs", least).select(F.lit(kind).alias("kind"), "track", "turn", F.array_join(F.col("runs").cast("array<string>"), " ").alias("runs"), runs.area(F.col("runs")).alias("area"))
        out = made if out is None else out.unionByName(made)
    return out


#: Faces over the 21 points of a vector's first 63 numbers: a strip, and two that share its first point.
FACES = [(i, i + 1, i + 2) for i in range(19)] + [(0, 5, 10), (0, 10, 15)]
CROSS = "(b_y - a_y) * (c_z - a_z) - (b_z - a_z) * (c_y - a_y)", "(b_z - a_z) * (c_x - a_x) - (b_x - a_x) * (c_z - a_z)", "(b_x - a_x) * (c_y - a_y) - (b_y - a_y) * (c_x - a_x)"
UNIT = "{0} / greatest(sqrt(x * x + y * y + z * z), 1e-5)"
_summed = lambda rows: "SELECT vec_id, vertex, " + ", ".join(UNIT.format(c) + f" AS {c}" for c in "xyz") + f" FROM (SELECT vec_id, vertex, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM {rows} GROUP BY 1, 2)"


@query(f"""
WITH f(face, i, j, k) AS (VALUES {', '.join(str((n, *f)) for n, f in enumerate(FACES))}),
p AS (SELECT vec_id, face, i, j, k, {', '.join(f'e[3 * {v} + {d + 1}] AS {p}_{c}' for p, v in zip('abc', 'ijk', strict=True) for d, c in enumerate('xyz'))} FROM {E}, f),
n AS (SELECT vec_id, face, i, j, k, {', '.join(UNIT.format(c) + f' AS {c}' for c in 'xyz')} FROM (SELECT *, {', '.join(f'{x} AS {c}' for x, c in zip(CROSS, 'xyz', strict=True))} FROM p)),
v AS (SELECT vec_id, face, 0 AS corner, i AS vertex, x, y, z FROM n UNION ALL SELECT vec_id, face, 1, j, x, y, z FROM n UNION ALL SELECT vec_id, face, 2, k, x, y, z FROM n),
l AS (SELECT vec_id, vertex, corner, arg_max(x, face) AS x, arg_max(y, face) AS y, arg_max(z, face) AS z FROM v GROUP BY 1, 2, 3)
SELECT a.vec_id, a.vertex, {', '.join(f'round(a.{c}, 6) + 0.0 AS {c}, round(b.{c}, 6) + 0.0 AS last_{c}' for c in 'xyz')} FROM ({_summed('v')}) a JOIN ({_summed('l')}) b ON a.vec_id = b.vec_id AND a.vertex = b.vertex
""")
def mesh_normals(spark, sf_dir):
    """Normals at all vertices of meshes of 21 faces; and those where of the faces at one corner the last counts."""
    d = vectors(spark, sf_dir)
    faces = F.array(*(F.struct(F.lit(n).alias("face"), *(F.lit(v).alias(c) for v, c in zip(f, "ijk", strict=True))) for n, f in enumerate(FACES)))
    rows = d.select("vec_id", "e", F.inline(faces)).select("vec_id", "face", "i", "j", "k", *(F.slice("e", 3 * F.col(v) + 1, 3).alias(p) for v, p in zip("ijk", "abc", strict=True)))
    numbers = lambda df, name: df.select("vec_id", "vertex", *((F.round(F.get("normal", F.lit(i)), 6) + 0.0).alias(name + c) for i, c in enumerate("xyz")))
    return numbers(updates.vertex_normals(rows, "vec_id"), "").join(numbers(updates.vertex_normals(rows, "vec_id", last="face"), "last_"), ["vec_id", "vertex"])


@query("""
WITH q AS (SELECT event_id, user_id, epoch_us(ts) AS ts FROM events WHERE event_type = 'view'),
t AS (SELECT user_id, epoch_us(ts) AS ts, max(event_id) AS other FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT q.event_id, t.other FROM q ASOF LEFT JOIN t ON q.user_id = t.user_id AND q.ts >= t.ts
""")
def asof_known_streams(spark, sf_dir):
    """The last other event before each view; a view of a user that the table of users lacks would fail."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", micros().alias("ts"))
    facts = e.where("event_type <> 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("other"))
    found = references.strict_asof(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), facts, ["user_id"], streams=e, mode="before")
    return found.select("event_id", F.col("match.other").alias("other"))


@query("SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def checked_names(spark, sf_dir):
    """Every line item has to name a part that there is."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = references.known_only(load(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), part, ["l_partkey"], "part is not in the library")
    return rows.join(part, "l_partkey").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT e.event_id, CASE WHEN l.doc_id IS NULL THEN -1 ELSE l.quality END AS quality, CASE WHEN l.doc_id IS NULL THEN 'none' ELSE CAST(l.toxic AS VARCHAR) END AS toxic FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id")
def lookup_with_default(spark, sf_dir):
    table = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), "quality", F.col("toxic").cast("string").alias("toxic"))
    return references.looked_up(load(spark, sf_dir, "events").select("event_id"), table, ["event_id"], quality=F.lit(-1), toxic=F.lit("none"))


@query("""
SELECT label, CASE WHEN grouping(label) = 1 THEN 'Evaluation of embeddings FIRST, SPREAD, ' || printf('%.2f %.2f', avg(first), avg(spread)) ELSE label || printf(' %.4f %.4f', avg(first), avg(spread)) END AS line
FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS first, CAST(list_max(embedding) AS DOUBLE) AS spread FROM embeddings) GROUP BY GROUPING SETS ((label), ())
""")
def report_lines(spark, sf_dir):
    """A line of means for each sequence, and one over all."""
    d = load(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.array_max("embedding").cast("double").alias("spread"))
    return metrics.report_lines(d, "label", ["first", "spread"], "Evaluation of embeddings")
