"""Points through cameras with lenses, and through turned crops, there and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import cameras, rigid
from plumbline.functions import rotation as R
from plumbline.plans.geometry import E, part, vectors
from plumbline.plans.registry import query

FOCAL, CENTRE = 600.0, (320.0, 240.0)
#: A vector's point, the camera's turn and place, the lens.
POINT, LENS = "[10 * e[1], 10 * e[2], 10 * e[3] + 8]", "[0.3 * e[10], 0.2 * e[11], 0.05 * e[12], 0.05 * e[13], 0.1 * e[14]]"


def _scene(spark, sf_dir):
    d = vectors(spark, sf_dir)
    times = lambda x, *factors: F.array(*(R.at(x, i) * f for i, f in enumerate(factors)))
    p = times(part(1, 3), 10.0, 10.0, 10.0)
    d = d.select("vec_id", F.array(R.at(p, 0), R.at(p, 1), R.at(p, 2) + 8).alias("p"), R.matrix_from_quat(part(4, 4)).alias("r"), part(8, 2).alias("t2"), times(part(10, 5), 0.3, 0.2, 0.05, 0.05, 0.1).alias("k"))
    # the camera looks at the points: its own turn is undone by the way they are given
    t = F.array(R.at(F.col("t2"), 0), R.at(F.col("t2"), 1), F.lit(1.0))
    return d.select("vec_id", R.mat_vec(R.transpose(F.col("r")), F.col("p")).alias("world"), "p", "r", t.alias("t"), "k")


def _camera():
    return F.lit(FOCAL), F.array(*map(F.lit, CENTRE))


@query(f"""
SELECT vec_id, round(600 * ((1 + k[1] * r + k[2] * r * r + k[5] * r * r * r) * x + 2 * k[3] * x * y + k[4] * (r + 2 * x * x)) + 320, 4) + 0.0 AS u,
  round(600 * ((1 + k[1] * r + k[2] * r * r + k[5] * r * r * r) * y + 2 * k[4] * x * y + k[3] * (r + 2 * y * y)) + 240, 4) + 0.0 AS v
FROM (SELECT *, x * x + y * y AS r FROM (SELECT vec_id, (p[1] + e[8]) / (p[3] + 1) AS x, (p[2] + e[9]) / (p[3] + 1) AS y, {LENS} AS k FROM (SELECT *, {POINT} AS p FROM {E})))
""")
def camera_projection(spark, sf_dir):
    focal, centre = _camera()
    d = _scene(spark, sf_dir).select("vec_id", cameras.project(F.col("world"), focal, centre, F.col("r"), F.col("t"), F.col("k")).alias("q"))
    return d.select("vec_id", *((F.round(R.at(F.col("q"), i), 4) + 0.0).alias(n) for i, n in enumerate("uv")))


@query(f"SELECT vec_id, round(p[1], 6) + 0.0 AS x, round(p[2], 6) + 0.0 AS y, round(p[3], 6) + 0.0 AS z FROM (SELECT vec_id, {POINT} AS p FROM {E})")
def camera_inverse(spark, sf_dir):
    """Pixels through the lens back into the world at their depth, and from there before the camera: the points they came from."""
    focal, centre = _camera()
    d = _scene(spark, sf_dir).withColumn("q", cameras.project(F.col("world"), focal, centre, F.col("r"), F.col("t"), F.col("k")))
    there = cameras.unproject(F.col("q"), R.at(F.col("p"), 2) + 1, focal, centre, F.col("r"), F.col("t"), F.col("k"))
    d = d.withColumn("back", R.mat_vec(F.col("r"), there))
    return d.select("vec_id", *((F.round(R.at(F.col("back"), i), 6) + 0.0).alias(n) for i, n in enumerate("xyz")))


#: The rows of the turn, about the middle of a crop of 256 x 192, of what is scaled and moved.
SCALED = f"SELECT *, radians(-30.0::DOUBLE) AS w FROM (SELECT vec_id, x, y, 256 / h * x + 256 * (0.5 - cx / h) - 128 AS sx, 192 / h * y + 192 * (0.5 - cy / h) - 96 AS sy FROM (SELECT vec_id, 100 * e[1] AS x, 100 * e[2] AS y, 50 * e[3] AS cx, 50 * e[4] AS cy, 200 * (abs(e[5]) + 0.5) + 1e-6 AS h FROM {E}))"


def _crop(spark, sf_dir):
    at = lambda i: R.at(F.col("e"), i)
    t = cameras.crop(50 * at(2), 50 * at(3), F.abs(at(4)) + 0.5, 256.0, 192.0, F.lit(30.0))
    return vectors(spark, sf_dir).select("vec_id", F.array(100 * at(0), 100 * at(1)).alias("p"), t.alias("t"))


@query(f"SELECT vec_id, round(cos(w) * sx - sin(w) * sy + 128, 6) + 0.0 AS x, round(sin(w) * sx + cos(w) * sy + 96, 6) + 0.0 AS y FROM ({SCALED})")
def crop_turned(spark, sf_dir):
    d = _crop(spark, sf_dir).select("vec_id", cameras.cropped(F.col("p"), F.col("t")).alias("q"))
    return d.select("vec_id", *((F.round(R.at(F.col("q"), i), 6) + 0.0).alias(n) for i, n in enumerate("xy")))


@query(f"SELECT vec_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM ({SCALED})")
def crop_inverse(spark, sf_dir):
    d = _crop(spark, sf_dir).select("vec_id", cameras.cropped(cameras.cropped(F.col("p"), F.col("t")), cameras.inverse_crop(F.col("t"))).alias("q"))
    return d.select("vec_id", *((F.round(R.at(F.col("q"), i), 6) + 0.0).alias(n) for i, n in enumerate("xy")))


def _product(i: int, j: int) -> str:
    """An entry of the product of two 4 x 4 poses, of the vector's numbers from the 1st and the 17th on."""
    return "(" + " + ".join(f"e[{4 * i + k + 1}] * e[{16 + 4 * k + j + 1}]" for k in range(3)) + (f" + e[{4 * i + 4}]" if j == 3 else "") + ")"


@query(f"SELECT vec_id, {', '.join(f'round({x}, 6) + 0.0 AS {n}' for i in range(3) for x, n in ((f'-{_product(i, 1)}', f'm{i}0'), (_product(i, 0), f'm{i}1'), (_product(i, 2), f'm{i}2'), (_product(i, 3), f't{i}')))} FROM {E}")
def camera_chain(spark, sf_dir):
    """The head's pose, the camera's in it, and the fixed quarter turn."""
    pose = lambda start: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("e", start + 4 * i, 4))
    d = vectors(spark, sf_dir).select("vec_id", rigid.camera_in_world(pose(1), pose(17)).alias("p"))
    return d.select("vec_id", *((F.round(R.at(F.col("p.r"), i, j), 6) + 0.0).alias(f"m{i}{j}") for i in range(3) for j in range(3)), *((F.round(R.at(F.col("p.t"), i), 6) + 0.0).alias(f"t{i}") for i in range(3)))
