"""Robust scale of prices, alignment of components, distances of distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import alignment, metrics, scale
from plumbline.plans.geometry import joints, vectors
from plumbline.plans.registry import query
from plumbline.session import load


def prices(spark, sf_dir):
    """Unit prices of line items beside their part's retail price, by supplier."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return load(spark, sf_dir, "lineitem").join(part, "l_partkey").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("top"), F.col("p_retailprice").alias("bottom"))


PRICES = "(SELECT l_suppkey, l_extendedprice / l_quantity AS top, p_retailprice AS bottom, l_extendedprice / l_quantity / p_retailprice AS ratio FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _rounds(n: int) -> str:
    sql = f"SELECT *, median(ratio) FILTER (top > 500 AND top < 9000) OVER w AS scale FROM {PRICES} WINDOW w AS (PARTITION BY l_suppkey)"
    for _ in range(n):
        sql = f"SELECT * EXCLUDE (scale), median(ratio) FILTER (bottom * scale > 0 AND bottom * scale < 9000 AND top > 500 AND top < 9000) OVER w AS scale FROM ({sql}) WINDOW w AS (PARTITION BY l_suppkey)"
    return sql


@query(f"SELECT l_suppkey, round(min(scale), 6) AS scale, count(*) AS n FROM ({_rounds(10)}) GROUP BY 1")
def trimmed_median_ratio(spark, sf_dir):
    rows = prices(spark, sf_dir)
    found = scale.trimmed_ratio(rows, ["l_suppkey"], F.col("top"), F.col("bottom"), 500.0, 9000.0)
    found = rows.where(F.try_divide("top", "bottom").isNotNull()).groupBy("l_suppkey").agg(F.count("*").alias("n")).join(found, "l_suppkey", "left")
    return found.select("l_suppkey", F.round("scale", 6).alias("scale"), "n")


@query(f"SELECT l_suppkey, round(median(ratio), 6) AS scale FROM {PRICES} GROUP BY 1")
def median_scale(spark, sf_dir):
    return prices(spark, sf_dir).groupBy("l_suppkey").agg(F.round(F.median(F.col("top") / F.col("bottom")), 6).alias("scale"))


def _reweighted(n: int) -> str:
    sql = f"SELECT *, 2.0::DOUBLE AS s FROM {PRICES}"
    for _ in range(n):
        sql = f"SELECT * EXCLUDE (s, k), sum(k * top * bottom) OVER w / sum(k * bottom * bottom) OVER w AS s FROM (SELECT *, pow(1e6::DOUBLE / (1e6::DOUBLE + (top - s * bottom) * (top - s * bottom)), 2) AS k FROM ({sql})) WINDOW w AS (PARTITION BY l_suppkey)"
    return sql


@query(f"SELECT l_suppkey, round(min(s), 5) AS scale, count(*) AS n FROM ({_reweighted(8)}) GROUP BY 1")
def robust_scale(spark, sf_dir):
    found = scale.reweighted(prices(spark, sf_dir), ["l_suppkey"], F.col("top"), F.col("bottom"), F.lit(2.0), sigma=1000.0)
    return found.select("l_suppkey", F.round("scale", 5).alias("scale"), "n")


def _converged(rows: str, start: str) -> str:
    """Reweighting until nothing moves any more. rows: l_suppkey, top, bottom; start: l_suppkey, s."""
    step = "sum(k * top * bottom) / sum(k * bottom * bottom) AS s FROM (SELECT r.*, top, bottom, pow(1e6::DOUBLE / (1e6::DOUBLE + (top - s * bottom) * (top - s * bottom)), 2) AS k FROM r JOIN p USING (l_suppkey) WHERE i < 300)"
    return f"WITH RECURSIVE p AS ({rows}), r AS (SELECT l_suppkey, 0 AS i, s FROM ({start}) UNION ALL SELECT l_suppkey, i + 1 AS i, {step} GROUP BY l_suppkey, i) SELECT l_suppkey, round(s, 4) AS scale, n FROM r JOIN (SELECT l_suppkey, count(*) AS n FROM p GROUP BY 1) USING (l_suppkey) WHERE i = 300"


@query(_converged(f"SELECT * FROM {PRICES}", f"SELECT DISTINCT l_suppkey, 2.0::DOUBLE AS s FROM {PRICES}"))
def scale_descent(spark, sf_dir):
    """The same optimum as robust_scale, by descent."""
    found = scale.descended(prices(spark, sf_dir), ["l_suppkey"], F.col("top"), F.col("bottom"), F.lit(2.0), sigma=1000.0)
    return found.select("l_suppkey", F.round("scale", 4).alias("scale"), "n")


def _wide() -> str:
    """The rounds without a mask, up to 10,000."""
    sql = f"SELECT *, median(ratio) FILTER (top > 0 AND top < 10000) OVER w AS scale FROM {PRICES} WINDOW w AS (PARTITION BY l_suppkey)"
    for _ in range(10):
        sql = f"SELECT * EXCLUDE (scale), median(ratio) FILTER (bottom * scale > 0 AND bottom * scale < 10000 AND top > 0 AND top < 10000) OVER w AS scale FROM ({sql}) WINDOW w AS (PARTITION BY l_suppkey)"
    return f"SELECT l_suppkey, min(scale) AS s FROM ({sql}) GROUP BY 1"


@query(_converged(f"SELECT * FROM {PRICES} WHERE top > 0 AND top < 10000", _wide()))
def scale_unmasked(spark, sf_dir):
    """Trimmed medians, then descent, with no mask and a far bound that hardly binds."""
    rows, columns = prices(spark, sf_dir), (F.col("top"), F.col("bottom"))
    start = scale.trimmed_ratio(rows, ["l_suppkey"], *columns, near=0.0, far=10_000.0)
    found = scale.descended(rows, ["l_suppkey"], *columns, start, sigma=1000.0, far=10_000.0)
    return found.select("l_suppkey", F.round("scale", 4).alias("scale"), "n")


NEAR = f"(SELECT l_suppkey, l_linestatus, top / 200 AS top, bottom / 200 AS bottom, ratio FROM (SELECT l.l_suppkey, l.l_linestatus, l.l_extendedprice / l.l_quantity AS top, p_retailprice AS bottom, l.l_extendedprice / l.l_quantity / p_retailprice AS ratio FROM lineitem l JOIN part ON p_partkey = l.l_partkey))"


def _banded() -> str:
    seen = "l_linestatus <> 'F' AND top > 0 AND top < 10"
    sql = f"SELECT *, median(ratio) FILTER ({seen}) OVER w AS scale FROM {NEAR} WINDOW w AS (PARTITION BY l_suppkey)"
    for _ in range(10):
        sql = f"SELECT * EXCLUDE (scale), median(ratio) FILTER ({seen} AND bottom * scale > 0 AND bottom * scale < 10) OVER w AS scale FROM ({sql}) WINDOW w AS (PARTITION BY l_suppkey)"
    return f"SELECT l_suppkey, round(min(scale), 6) AS scale FROM ({sql}) GROUP BY 1 HAVING count(*) FILTER ({seen}) > 0"


@query(_banded())
def scale_simple(spark, sf_dir):
    """Medians alone, in the band from 0 to 10, where the mask doesn't hold."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_retailprice") / 200).alias("bottom"))
    rows = load(spark, sf_dir, "lineitem").join(part, "l_partkey")
    found = scale.trimmed_ratio(rows, ["l_suppkey"], F.col("l_extendedprice") / F.col("l_quantity") / 200, F.col("bottom"), 0.0, 10.0, mask=F.col("l_linestatus") == "F")
    return found.select("l_suppkey", F.round("scale", 6).alias("scale"))


@query("""
WITH g AS (SELECT l_suppkey, f, avg(abs(l_extendedprice / l_quantity - f)) AS err FROM lineitem, (SELECT unnest([2000.0::DOUBLE, 500.0::DOUBLE, 1000.0::DOUBLE, 1500.0::DOUBLE, 2500.0::DOUBLE, 3000.0::DOUBLE]) AS f) GROUP BY 1, 2)
SELECT l_suppkey, arg_min(f, round(err, 6)) AS focal FROM g GROUP BY 1
""")
def focal_argmin(spark, sf_dir):
    """The candidate of least error; the first of equals, the default before all."""
    candidates = [2000.0, 500.0, 1000.0, 1500.0, 2500.0, 3000.0]
    price = F.col("l_extendedprice") / F.col("l_quantity")
    errors = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(F.avg(F.abs(price - f)).alias(f"e{i}") for i, f in enumerate(candidates)))
    options = F.array(*(F.struct(F.round(f"e{i}", 6).alias("err"), F.lit(i).alias("i"), F.lit(f).alias("focal")) for i, f in enumerate(candidates)))
    return errors.select("l_suppkey", F.array_min(options)["focal"].alias("focal"))


def tracks(spark, sf_dir):
    """A point of each vector and the next one of its label."""
    d = vectors(spark, sf_dir).select("label", "vec_id", F.slice("e", 1, 3).alias("x"))
    return d.withColumn("y", F.lead("x").over(Window.partitionBy("label").orderBy("vec_id"))).where("y is not null")


def _moments() -> str:
    a, b = ([f"{c}[{i}]" for i in (1, 2, 3)] for c in "xy")
    columns = [f"round(sum({v}), 6) AS x{i}" for i, v in enumerate(a)] + [f"round(sum({v}), 6) AS y{i}" for i, v in enumerate(b)]
    columns += [f"round(sum({q} * {p}), 6) AS c{i}{j}" for i, q in enumerate(b) for j, p in enumerate(a)]
    return ", ".join(columns)


@query(f"SELECT label, count(*) AS n, {_moments()} FROM (SELECT label, e AS x, lead(e) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)) WHERE y IS NOT NULL GROUP BY 1")
def alignment_moments(spark, sf_dir):
    """The sums that a fit needs."""
    m = alignment.sums(tracks(spark, sf_dir), ["label"], "x", "y")
    columns = [F.round(F.get(F.col(c), F.lit(i)), 6).alias(f"{c}{i}") for c in "xy" for i in range(3)]
    return m.select("label", F.col("w").cast("long").alias("n"), *columns, *(F.round(F.get("yx", F.lit(3 * i + j)), 6).alias(f"c{i}{j}") for i in range(3) for j in range(3)))


def _flat(made):
    return made.select("label", F.round("scale", 6).alias("scale"), F.transform(F.flatten("r"), lambda v: F.round(v, 6)).alias("r"), F.transform("t", lambda v: F.round(v, 6)).alias("t"))


@query()
def rigid_align(spark, sf_dir):
    return _flat(alignment.fit(alignment.sums(tracks(spark, sf_dir), ["label"], "x", "y"), ["label"], scaled=False))


@query()
def similarity_align(spark, sf_dir):
    return _flat(alignment.fit(alignment.sums(tracks(spark, sf_dir), ["label"], "x", "y"), ["label"]))


@query()
def first_two_frames_align(spark, sf_dir):
    """A fit on a track's first two frames, applied to all of it."""
    d = tracks(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return alignment.align(d, ["label"], "x", "y", fit_on=F.col("rn") <= 2).select("label", "vec_id", F.transform("aligned", lambda v: F.round(v, 6)).alias("aligned"))


@query()
def pa_joint_error(spark, sf_dir):
    """Joint errors after each frame's own similarity."""
    d = vectors(spark, sf_dir).select("vec_id", "label", joints().alias("truth"))
    d = d.withColumn("found", F.lead("truth").over(Window.partitionBy("label").orderBy("vec_id"))).where("found is not null")
    points = d.select("vec_id", F.explode(F.arrays_zip("truth", "found")).alias("p")).select("vec_id", F.col("p.truth").alias("y"), F.col("p.found").alias("x"))
    moved = alignment.align(points, ["vec_id"], "x", "y")
    return moved.groupBy("vec_id").agg(F.round(F.avg(metrics.distance(F.col("aligned"), F.col("y"))), 6).alias("error"))


@query()
def rte(spark, sf_dir):
    """Error after rigid alignment by the length of the true path."""
    d = tracks(spark, sf_dir)
    path = metrics.path_length(d, ["label"], "vec_id", "y")
    moved = alignment.align(d, ["label"], "x", "y", scaled=False).join(path, "label")
    return moved.select("label", "vec_id", F.round(F.try_divide(metrics.distance(F.col("aligned"), F.col("y")), F.col("path_length")), 6).alias("rte"))


@query()
def ate_stats(spark, sf_dir):
    """Errors of aligned trajectories in six figures."""
    d = alignment.align(tracks(spark, sf_dir), ["label"], "x", "y").withColumn("e", metrics.distance(F.col("aligned"), F.col("y")))
    figures = {"rmse": F.sqrt(F.avg(F.col("e") * F.col("e"))), "mean": F.avg("e"), "median": F.median("e"), "std": F.stddev_pop("e"), "min": F.min("e"), "max": F.max("e")}
    return d.groupBy("label").agg(*(F.round(c, 6).alias(n) for n, c in figures.items()))


@query()
def frechet_distance(spark, sf_dir):
    """Even against odd labels, over eight components."""
    d = vectors(spark, sf_dir).select((F.col("label") % 2).alias("k"), F.slice("e", 1, 8).alias("v"))
    rows = {r["k"]: (r["n"], r["m"]) for r in alignment.gaussian_sums(d, "k", "v", 8).collect()}  # two rows of 72 numbers
    value = alignment.frechet(rows[0], rows[1], 8) if len(rows) == 2 else None
    return spark.createDataFrame([(value,)], "frechet double").select(F.round("frechet", 6).alias("frechet"))
