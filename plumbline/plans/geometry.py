"""Rotations, rigid transforms and boxes over components of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import boxes, rigid
from plumbline.functions import rotation as R
from plumbline.plans.registry import query
from plumbline.session import load

E = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def part(start: int, n: int):
    """n components from the start-th, counted from 1."""
    return F.slice("e", start, n)


def named(c, n: int, name: str = "x") -> list:
    return [F.round(R.at(c, i), 6).alias(f"{name}{i}") for i in range(n)]


def named_matrix(m) -> list:
    return [F.round(R.at(m, i, j), 6).alias(f"m{i}{j}") for i in range(3) for j in range(3)]


def sql_columns(expressions: list[str], name: str = "x") -> str:
    return ", ".join(f"round({e}, 6) AS {name}{i}" for i, e in enumerate(expressions))


def sql_matrix(expressions: list[str]) -> str:
    return ", ".join(f"round({e}, 6) AS m{i // 3}{i % 3}" for i, e in enumerate(expressions))


QUAT = [f"{a} / n" for a in "wxyz"]
UNIT_QUAT = f"(SELECT vec_id, e[1] / n AS w, e[2] / n AS x, e[3] / n AS y, e[4] / n AS z FROM (SELECT *, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4]) AS n FROM {E}))"
MATRIX = ["1 - 2 * (y * y + z * z)", "2 * (x * y - w * z)", "2 * (x * z + w * y)", "2 * (x * y + w * z)", "1 - 2 * (x * x + z * z)", "2 * (y * z - w * x)", "2 * (x * z - w * y)", "2 * (y * z + w * x)", "1 - 2 * (x * x + y * y)"]


@query(f"SELECT vec_id, {sql_columns(['cos(a / 2)', *(f'e[{i}] * sin(a / 2) / a' for i in (1, 2, 3))])} FROM (SELECT *, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) AS a FROM {E})")
def quat_from_axis_angle(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("q", R.quat_from_axis_angle(part(1, 3)))
    return d.select("vec_id", *named(F.col("q"), 4))


@query(f"SELECT vec_id, {sql_columns(['e[1]', 'e[2]', 'e[3]'])} FROM {E}")
def axis_angle_roundtrip(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("v", R.axis_angle_from_matrix(R.matrix_from_axis_angle(part(1, 3))))
    return d.select("vec_id", *named(F.col("v"), 3))


@query(f"SELECT vec_id, {sql_matrix(MATRIX)} FROM {UNIT_QUAT}")
def quat_to_matrix(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("m", R.matrix_from_quat(part(1, 4)))
    return d.select("vec_id", *named_matrix(F.col("m")))


@query(f"SELECT vec_id, {sql_columns([f'{a} * CASE WHEN w < 0 THEN -1 ELSE 1 END' for a in 'wxyz'])} FROM {UNIT_QUAT}")
def quat_matrix_roundtrip(spark, sf_dir):
    """A quaternion and its opposite are one rotation; the one with positive w is returned."""
    d = vectors(spark, sf_dir).withColumn("q", R.quat_from_matrix(R.matrix_from_quat(part(1, 4))))
    d = d.withColumn("q", F.when(R.at(F.col("q"), 0) < 0, F.transform("q", lambda x: -x)).otherwise(F.col("q")))
    return d.select("vec_id", *named(F.col("q"), 4))


@query(f"SELECT vec_id, {sql_matrix(MATRIX)} FROM {UNIT_QUAT}")
def rot6d_columns_roundtrip(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("m", R.matrix_from_quat(part(1, 4)))
    d = d.withColumn("m", R.matrix_from_sixd_columns(R.sixd_columns(F.col("m"))))
    return d.select("vec_id", *named_matrix(F.col("m")))


@query(f"SELECT vec_id, {sql_matrix(MATRIX)} FROM {UNIT_QUAT}")
def rot6d_rows_roundtrip(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("m", R.matrix_from_quat(part(1, 4)))
    d = d.withColumn("m", R.matrix_from_sixd_rows(R.sixd_rows(F.col("m"))))
    return d.select("vec_id", *named_matrix(F.col("m")))


@query(f"""SELECT vec_id, {sql_columns(['e[1]*e[5]-e[2]*e[6]-e[3]*e[7]-e[4]*e[8]', 'e[1]*e[6]+e[2]*e[5]+e[3]*e[8]-e[4]*e[7]', 'e[1]*e[7]-e[2]*e[8]+e[3]*e[5]+e[4]*e[6]', 'e[1]*e[8]+e[2]*e[7]-e[3]*e[6]+e[4]*e[5]'])} FROM {E}""")
def quat_mul(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("q", R.quat_mul(part(1, 4), part(5, 4)))
    return d.select("vec_id", *named(F.col("q"), 4))


@query(f"SELECT vec_id, {sql_columns([f'{s}e[{i}] / (n + 1e-8)' for s, i in (('', 1), ('-', 2), ('-', 3), ('-', 4))])} FROM (SELECT *, e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4] AS n FROM {E})")
def quat_inverse(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("q", R.quat_inverse(part(1, 4)))
    return d.select("vec_id", *named(F.col("q"), 4))


@query(f"SELECT vec_id, {sql_columns(['e[1]', '-e[2]', '-e[3]'])} FROM {E}")
def mirror_hand(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", *named(R.mirror(part(1, 3)), 3))


@query(f"SELECT vec_id, {sql_columns(['e[8]', 'e[9]', 'e[10]'])} FROM {E}")
def rigid_roundtrip(spark, sf_dir):
    """A point moved by a transform and by its inverse is where it was."""
    d = vectors(spark, sf_dir).withColumn("p", rigid.rigid(R.matrix_from_quat(part(1, 4)), part(5, 3)))
    d = d.withColumn("both", rigid.compose(rigid.inverse(F.col("p")), F.col("p"))).withColumn("v", rigid.act(F.col("both"), part(8, 3)))
    return d.select("vec_id", *named(F.col("v"), 3))


@query(f"SELECT vec_id, {sql_columns([f'({MATRIX[3 * i]}) * e[8] + ({MATRIX[3 * i + 1]}) * e[9] + ({MATRIX[3 * i + 2]}) * e[10] + 2 * e[{i + 5}]' for i in range(3)])} FROM {UNIT_QUAT} JOIN {E} USING (vec_id)")
def trajectory_act(spark, sf_dir):
    """A pose stored as tx ty tz qx qy qz qw, scaled by two, acts on a point."""
    d = vectors(spark, sf_dir).withColumn("row", F.concat(part(5, 3), part(2, 3), part(1, 1)))
    d = d.withColumn("p", rigid.from_trajectory(F.col("row"), F.lit(2.0))).withColumn("v", rigid.act(F.col("p"), part(8, 3)))
    return d.select("vec_id", *named(F.col("v"), 3))


@query(f"SELECT vec_id, round(CASE WHEN e[3] > 1e-6 THEN 600 * e[1] / e[3] + 320 END, 6) AS u, round(CASE WHEN e[3] > 1e-6 THEN 600 * e[2] / e[3] + 240 END, 6) AS v FROM {E}")
def pinhole_project(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("p", boxes.project(part(1, 3), F.lit(600.0), F.lit(600.0), F.lit(320.0), F.lit(240.0)))
    return d.select("vec_id", F.round(R.at(F.col("p"), 0), 6).alias("u"), F.round(R.at(F.col("p"), 1), 6).alias("v"))


def item_boxes(spark, sf_dir):
    """Line items as boxes: left and top from keys, sides from quantities."""
    left, top = (F.col("l_partkey") % 1000).cast("double"), (F.col("l_suppkey") % 700).cast("double")
    b = boxes.box(left, top, left + F.col("l_quantity"), top + F.col("l_quantity") * 2.5)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", b.alias("b"))


ITEM_BOXES = "(SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(l_partkey % 1000 AS DOUBLE) AS l, CAST(l_suppkey % 700 AS DOUBLE) AS t, l_partkey % 1000 + l_quantity AS r, l_suppkey % 700 + l_quantity * 2.5::DOUBLE AS b FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, (l + r) / 2 AS cx, (t + b) / 2 AS cy, greatest(r - l, b - t) / 200 AS scale FROM {ITEM_BOXES}")
def box_centre_scale(spark, sf_dir):
    return item_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", boxes.centre_scale(F.col("b")).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


def _in(v: str, top: int) -> str:
    return f"round_even(least(greatest({v}, 0), {top}), 0) + 0.0"


@query(f'SELECT l_orderkey, l_linenumber, {_in("l - 7.5", 900)} AS "left", {_in("t - 3", 800)} AS top, {_in("r + 7.5", 900)} AS "right", {_in("b + 3", 800)} AS bottom FROM {ITEM_BOXES}')
def box_pad_clip_round(spark, sf_dir):
    made = boxes.rounded(boxes.clip(boxes.pad(F.col("b"), F.lit(7.5), F.lit(3.0)), 900, 800))
    return item_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", made.alias("m")).select("l_orderkey", "l_linenumber", "m.*")


def joints(scale: float = 1.0, shift: float = 0.0):
    """The first 63 components as 21 points."""
    return F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.array(*(F.get(F.col("e"), i * 3 + k) * scale + shift for k in range(3))))


def _xs(k: int) -> str:
    return f"list_transform(range(0, 21), lambda i: e[i * 3 + {k + 1}] * 400 + 200)"


@query(f"""SELECT vec_id, round(greatest(0, x0 - 0.2 * (x1 - x0)), 6) AS "left", round(greatest(0, y0 - 0.2 * (y1 - y0)), 6) AS top,
round(least(400, x1 + 0.2 * (x1 - x0)), 6) AS "right", round(least(400, y1 + 0.2 * (y1 - y0)), 6) AS bottom
FROM (SELECT vec_id, list_min({_xs(0)}) AS x0, list_max({_xs(0)}) AS x1, list_min({_xs(1)}) AS y0, list_max({_xs(1)}) AS y1 FROM {E})""")
def joints_to_box(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("j", joints(400.0, 200.0)).withColumn("b", boxes.around_points(F.col("j"), 0.2, 400, 400))
    return d.select("vec_id", *(F.round(F.col("b")[c], 6).alias(c) for c in ("left", "top", "right", "bottom")))


@query(f"SELECT vec_id, CAST(len(list_filter(range(0, 21), lambda i: e[i * 3 + 1] >= 0 AND e[i * 3 + 1] < 0.1 AND e[i * 3 + 2] >= 0 AND e[i * 3 + 2] < 0.1)) AS INTEGER) AS inside FROM {E}")
def joints_in_image(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("j", joints()).select("vec_id", boxes.in_image(F.col("j"), 0.1, 0.1).alias("inside"))


@query(f"""SELECT vec_id, round(coalesce(x1 - x0, 0), 6) AS w, round(coalesce(y1 - y0, 0), 6) AS h, round(coalesce(x1 - x0, 0) * coalesce(y1 - y0, 0), 6) AS area FROM (
SELECT vec_id, list_min(list_transform(k, lambda i: e[i * 3 + 1])) AS x0, list_max(list_transform(k, lambda i: e[i * 3 + 1])) AS x1, list_min(list_transform(k, lambda i: e[i * 3 + 2])) AS y0, list_max(list_transform(k, lambda i: e[i * 3 + 2])) AS y1
FROM (SELECT vec_id, e, list_filter(range(0, 21), lambda i: e[i * 3 + 3] > 0.1) AS k FROM {E}))""")
def keypoint_rect(spark, sf_dir):
    d = vectors(spark, sf_dir).withColumn("j", joints()).withColumn("r", boxes.confident_rectangle(F.col("j"), 0.1))
    return d.select("vec_id", *(F.round(F.col("r")[c], 6).alias(c) for c in ("w", "h", "area")))


@query("SELECT page_id, CAST(trunc(w * k) - trunc(w * k) % 8 AS INTEGER) AS w, CAST(trunc(h * k) - trunc(h * k) % 8 AS INTEGER) AS h FROM (SELECT *, sqrt(196608.0::DOUBLE / (w * h)) AS k FROM (SELECT page_id, 640 + page_id % 700 AS w, 480 + page_id % 300 AS h FROM pages))")
def working_size(spark, sf_dir):
    d = load(spark, sf_dir, "pages").select("page_id", boxes.working_size(640 + F.col("page_id") % 700, 480 + F.col("page_id") % 300).alias("s"))
    return d.select("page_id", "s.w", "s.h")
