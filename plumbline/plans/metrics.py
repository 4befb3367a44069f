"""Evaluation: 21 joints of a vector against the next one of its label."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import metrics
from plumbline.plans.geometry import joints, vectors
from plumbline.plans.registry import query


def pairs(spark, sf_dir):
    """Each vector's joints as truth, the next vector's of the label as what was found."""
    d = vectors(spark, sf_dir).select("vec_id", "label", joints().alias("truth"))
    return d.withColumn("found", F.lead("truth").over(Window.partitionBy("label").orderBy("vec_id"))).where("found is not null")


E = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS t FROM embeddings)"
PAIRS = f"(SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM {E}) WHERE f IS NOT NULL)"


def _norm(terms: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({t}) * ({t})" for t in terms) + ")"


def _mean(expression: str, n: int = 21) -> str:
    return f"list_avg(list_transform(range(0, {n}), lambda i: {expression}))"


ERROR = _mean(_norm([f"t[i * 3 + {k}] - f[i * 3 + {k}]" for k in (1, 2, 3)]))
ALIGNED = _mean(_norm([f"(t[i * 3 + {k}] - (t[{k}] + t[{k + 3}]) / 2) - (f[i * 3 + {k}] - (f[{k}] + f[{k + 3}]) / 2)" for k in (1, 2, 3)]))


@query(f"SELECT vec_id, round({ERROR}, 6) AS error FROM {PAIRS}")
def joint_error(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.round(metrics.joint_error(F.col("truth"), F.col("found")), 6).alias("error"))


@query(f"SELECT vec_id, round({ALIGNED}, 6) AS error FROM {PAIRS}")
def root_aligned_error(spark, sf_dir):
    c = lambda x: metrics.centred(F.col(x), [0, 1])
    return pairs(spark, sf_dir).select("vec_id", F.round(metrics.joint_error(c("truth"), c("found")), 6).alias("error"))


ACCEL = _mean(_norm([f"(t0[i * 3 + {k}] - 2 * t[i * 3 + {k}] + t2[i * 3 + {k}]) - (f0[i * 3 + {k}] - 2 * f[i * 3 + {k}] + f2[i * 3 + {k}])" for k in (1, 2, 3)])) + " * 900"
THREE = f"(SELECT *, lag(t) OVER w AS t0, lead(t) OVER w AS t2, lag(f) OVER w AS f0, lead(f) OVER w AS f2, lag(vec_id) OVER w AS v0, lead(vec_id) OVER w AS v2 FROM {PAIRS} WINDOW w AS (PARTITION BY label ORDER BY vec_id))"


@query(f"SELECT vec_id, CASE WHEN t0 IS NOT NULL AND t2 IS NOT NULL THEN round({ACCEL}, 5) END AS accel_error FROM {THREE}")
def accel_error(spark, sf_dir):
    d = metrics.acceleration_error(pairs(spark, sf_dir), ["label"], "vec_id", "truth", "found", factor=900.0)
    return d.select("vec_id", F.round("accel_error", 5).alias("accel_error"))


@query(f"SELECT vec_id, CASE WHEN t0 IS NOT NULL AND t2 IS NOT NULL AND v0 % 7 <> 0 AND vec_id % 7 <> 0 AND v2 % 7 <> 0 THEN round({ACCEL}, 5) END AS accel_error FROM {THREE}")
def accel_error_visible(spark, sf_dir):
    d = pairs(spark, sf_dir).withColumn("visible", F.col("vec_id") % 7 != 0)
    d = metrics.acceleration_error(d, ["label"], "vec_id", "truth", "found", "visible", factor=900.0)
    return d.select("vec_id", F.round("accel_error", 5).alias("accel_error"))


FOUR = f"(SELECT *, lag(t, 1) OVER w AS t1, lag(t, 2) OVER w AS t2, lag(t, 3) OVER w AS t3 FROM {E} WINDOW w AS (PARTITION BY label ORDER BY vec_id))"
JERK = _mean(_norm([f"t[i * 3 + {k}] - 3 * t1[i * 3 + {k}] + 3 * t2[i * 3 + {k}] - t3[i * 3 + {k}]" for k in (1, 2, 3)]))


@query(f"SELECT vec_id, CASE WHEN t3 IS NOT NULL THEN round({JERK} * 2700.0::DOUBLE, 4) END AS jitter FROM {FOUR}")
def jitter(spark, sf_dir):
    d = vectors(spark, sf_dir).select("vec_id", "label", joints().alias("truth"))
    return metrics.jitter(d, ["label"], "vec_id", "truth").select("vec_id", F.round("jitter", 4).alias("jitter"))


STEP = _norm([f"t[{k}] - t1[{k}]" for k in (1, 2, 3)])


@query(f"SELECT label, round(coalesce(sum({STEP}), 0), 6) AS path_length FROM {FOUR} GROUP BY 1")
def path_length(spark, sf_dir):
    d = vectors(spark, sf_dir).select("label", "vec_id", F.slice("e", 1, 3).alias("p"))
    return metrics.path_length(d, ["label"], "vec_id", "p").select("label", F.round("path_length", 6).alias("path_length"))


SPEED = _mean(_norm([f"t[i * 3 + {k}] - t1[i * 3 + {k}]" for k in (1, 2, 3)]))


@query(f"SELECT vec_id, CASE WHEN t1 IS NOT NULL THEN round({SPEED}, 6) END AS velocity FROM {FOUR}")
def velocity(spark, sf_dir):
    d = vectors(spark, sf_dir).select("vec_id", "label", joints().alias("truth"))
    return metrics.velocity(d, ["label"], "vec_id", "truth").select("vec_id", F.round("velocity", 6).alias("velocity"))


@query(f"""SELECT label, count(*) AS frames, round(avg(e), 6) AS error, round(avg(a), 6) AS aligned FROM (SELECT label, {ERROR} AS e, {ALIGNED} AS a FROM {PAIRS}) GROUP BY ROLLUP (label)""")
def eval_report(spark, sf_dir):
    """Means by sequence, and over all frames."""
    c = lambda x: metrics.centred(F.col(x), [0, 1])
    d = pairs(spark, sf_dir).select("label", metrics.joint_error(F.col("truth"), F.col("found")).alias("error"), metrics.joint_error(c("truth"), c("found")).alias("aligned"))
    return metrics.report(d, ["label"], ["error", "aligned"]).select("label", "frames", F.round("error", 6).alias("error"), F.round("aligned", 6).alias("aligned"))


# joints that move by less than 0.12 in truth, from one row of a label to the next, and how far they move in what was found
MOVES = f"SELECT vec_id, unnest(range(0, 21)) AS i, t, f, lag(t) OVER w AS t1, lag(f) OVER w AS f1 FROM {PAIRS} WINDOW w AS (PARTITION BY label ORDER BY vec_id)"
MOVED = f"SELECT vec_id, {_norm([f't[i * 3 + {k}] - t1[i * 3 + {k}]' for k in (1, 2, 3)])} AS t, {_norm([f'f[i * 3 + {k}] - f1[i * 3 + {k}]' for k in (1, 2, 3)])} AS f FROM ({MOVES})"


@query(f"SELECT vec_id, round(avg(f) FILTER (t < 0.12), 6) AS sliding FROM ({MOVED}) GROUP BY 1")
def sliding_contact(spark, sf_dir):
    return metrics.sliding(pairs(spark, sf_dir), ["label"], "vec_id", "truth", "found", 0.12).select("vec_id", F.round("sliding", 6).alias("sliding"))
