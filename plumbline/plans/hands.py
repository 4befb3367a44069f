"""Windows of hands packed for a model and back, and skeletons; hands are made of the embeddings' numbers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.functions import rotation as R
from plumbline.operators import infill
from plumbline.operators.skeleton import Skeleton
from plumbline.plans.geometry import E, vectors
from plumbline.plans.registry import query

#: Vectors of one window: ten frames of two hands. Rotations are the vectors' numbers times TURN.
PER_WINDOW, TURN = 20, 8.0
KEYS = ["window_id", "frame"]


def hands(spark, sf_dir):
    """A hand a vector: trans, rot, pose and betas are its first 61 numbers, the 62nd says whether it's valid."""
    d = vectors(spark, sf_dir)
    turned = lambda start, n: F.transform(F.slice("e", start, n), lambda x: x * TURN)
    return d.select(
        "vec_id", F.floor(F.col("vec_id") / PER_WINDOW).alias("window_id"), F.floor(F.col("vec_id") % PER_WINDOW / 2).alias("frame"), (F.col("vec_id") % 2 == 1).alias("right"),
        F.slice("e", 1, 3).alias("trans"), turned(4, 3).alias("rot"), turned(7, 45).alias("pose"), F.slice("e", 52, 10).alias("betas"), (F.get("e", F.lit(61)) > -0.05).alias("valid"),
    )


HANDS = f"""
h AS (SELECT vec_id, vec_id // {PER_WINDOW} AS window_id, vec_id % {PER_WINDOW} // 2 AS frame, vec_id % 2 AS hand, e, e[62] > -0.05 AS ok FROM {E}),
v AS (SELECT *, 8 * e[4 + 3 * j] AS rx, 8 * e[5 + 3 * j] AS ry, 8 * e[6 + 3 * j] AS rz FROM (SELECT *, unnest(range(0, 16)) AS j FROM h)),
o AS (SELECT *, cos(a / 2) AS ow, rx * sin(a / 2) / a AS ox, ry * sin(a / 2) / a AS oy, rz * sin(a / 2) / a AS oz FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS a FROM v)),
f AS (SELECT *, first_value(ow) OVER k AS fw, first_value(ox) OVER k AS fx, first_value(oy) OVER k AS fy, first_value(oz) OVER k AS fz FROM o WINDOW k AS (PARTITION BY window_id, hand, j ORDER BY frame)),
c AS (SELECT window_id, frame, hand, j, ok,
        CASE WHEN j = 0 THEN fw * ow + fx * ox + fy * oy + fz * oz ELSE ow END AS qw, CASE WHEN j = 0 THEN fw * ox - fx * ow - fy * oz + fz * oy ELSE ox END AS qx,
        CASE WHEN j = 0 THEN fw * oy + fx * oz - fy * ow - fz * ox ELSE oy END AS qy, CASE WHEN j = 0 THEN fw * oz - fx * oy + fy * ox - fz * ow ELSE oz END AS qz FROM f)
"""


def _around(names: list[str], key: str) -> str:
    """SQL columns: each name's valid value before (l) and after (r), the frames they stand at, and how many are valid."""
    sides = (("l", "last_value", "before"), ("r", "first_value", "behind"))
    parts = [f"{f}(CASE WHEN ok THEN {n} END IGNORE NULLS) OVER {w} AS {s}{n}" for s, f, w in sides for n in (*names, "frame")]
    windows = f"WINDOW before AS (PARTITION BY {key} ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), behind AS (PARTITION BY {key} ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"SELECT *, {', '.join(parts)}, count(*) FILTER (ok) OVER (PARTITION BY {key}) AS n, (frame - lframe)::DOUBLE / (rframe - lframe) AS t" + " FROM {} " + windows


SIXD = ["1 - 2 * (y * y + z * z)", "2 * (x * y - w * z)", "2 * (x * y + w * z)", "1 - 2 * (x * x + z * z)", "2 * (x * z - w * y)", "2 * (y * z + w * x)"]
TURNED = ["(1 - 2 * (fy * fy + fz * fz)) * {0} + 2 * (fx * fy + fw * fz) * {1} + 2 * (fx * fz - fw * fy) * {2}", "2 * (fx * fy - fw * fz) * {0} + (1 - 2 * (fx * fx + fz * fz)) * {1} + 2 * (fy * fz + fw * fx) * {2}", "2 * (fx * fz + fw * fy) * {0} + 2 * (fy * fz - fw * fx) * {1} + (1 - 2 * (fx * fx + fy * fy)) * {2}"]
Q = "wxyz"
PACKED = f"""
WITH {HANDS},
s AS ({_around([f"q{c}" for c in Q], "window_id, hand, j").format("c")}),
d AS (SELECT *, lqw * rqw + lqx * rqx + lqy * rqy + lqz * rqz AS cs FROM s),
p AS (SELECT *, CASE WHEN abs(cs) > 1 - 1e-8 THEN 1 - t ELSE sin((1 - t) * acos(least(abs(cs), 1))) / sin(acos(least(abs(cs), 1))) END AS lp,
        sign(cs) * CASE WHEN abs(cs) > 1 - 1e-8 THEN t ELSE sin(t * acos(least(abs(cs), 1))) / sin(acos(least(abs(cs), 1))) END AS rp FROM d),
q AS (SELECT window_id, frame, hand, j, {", ".join(f"CASE WHEN ok OR n < 2 THEN q{c} WHEN lframe IS NULL THEN rq{c} WHEN rframe IS NULL THEN lq{c} ELSE lp * lq{c} + rp * rq{c} END AS u{c}" for c in Q)} FROM p),
m AS (SELECT window_id, frame, hand, j, {", ".join(f"u{c} / sqrt(uw * uw + ux * ux + uy * uy + uz * uz) AS {c}" for c in Q)} FROM q),
x AS (SELECT window_id, frame, hand, ok, unnest(range(0, 13)) AS i, [{", ".join(TURNED[i].format(*(f"(e[{k + 1}] - first_value(e[{k + 1}]) OVER k)" for k in range(3))) for i in range(3))}] || e[52:61] AS b
      FROM f WHERE j = 0 WINDOW k AS (PARTITION BY window_id, hand ORDER BY frame)),
y AS (SELECT window_id, frame, hand, ok, i, b[i + 1] AS b FROM x),
z AS ({_around(["b"], "window_id, hand, i").format("y")})
SELECT window_id, frame, CAST(109 * hand + 13 + 6 * j + i AS INTEGER) AS k, round(v[i + 1], 6) + 0.0 AS value FROM (SELECT *, unnest(range(0, 6)) AS i, [{", ".join(SIXD)}] AS v FROM m)
UNION ALL
SELECT window_id, frame, CAST(109 * hand + i AS INTEGER) AS k, round(CASE WHEN ok OR n < 2 THEN b WHEN lframe IS NULL THEN rb WHEN rframe IS NULL THEN lb ELSE lb + (rb - lb) * t END, 6) + 0.0 AS value FROM z
"""


def _packed(spark, sf_dir):
    rows = infill.canonicalise(hands(spark, sf_dir), ["window_id", "right"], "frame")
    return infill.pack(infill.fill_hands(rows, ["window_id", "right"], "frame"), KEYS, F.col("right"))


@query(PACKED)
def infill_pack(spark, sf_dir):
    """The numbers that a model gets: 109 a hand, in the window's own frame, gaps filled."""
    rows = _packed(spark, sf_dir).select(*KEYS, F.posexplode("packed").alias("k", "value"))
    return rows.select(*KEYS, "k", (F.round("value", 6) + 0.0).alias("value"))


MATRIX = ["1 - 2 * (oy * oy + oz * oz)", "2 * (ox * oy - ow * oz)", "2 * (ox * oz + ow * oy)", "2 * (ox * oy + ow * oz)", "1 - 2 * (ox * ox + oz * oz)", "2 * (oy * oz - ow * ox)", "2 * (ox * oz - ow * oy)", "2 * (oy * oz + ow * ox)", "1 - 2 * (ox * ox + oy * oy)"]


@query(f"""
WITH {HANDS}, r AS (SELECT window_id, frame, hand = 1 AS is_right, j, CASE WHEN j = 0 THEN e[1:3] ELSE [] END || [{", ".join(MATRIX)}] || CASE WHEN j = 0 THEN e[52:61] ELSE [] END AS v FROM o WHERE ok)
SELECT window_id, frame, is_right, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, round(v[i + 1], 6) + 0.0 AS value FROM (SELECT *, unnest(range(0, len(v))) AS i FROM r)
""")
def infill_roundtrip(spark, sf_dir):
    """Packed, unpacked and moved back into the world, valid hands are what they were: places, shapes and all matrices."""
    there = infill.to_world(infill.unpack(_packed(spark, sf_dir)))
    valid = hands(spark, sf_dir).where("valid").select(*KEYS, F.col("right").alias("is_right"))
    matrix = lambda c, j: F.flatten(R.matrix_from_axis_angle(F.slice(c, 3 * j + 1, 3)))
    joints = F.concat(F.array(F.concat("trans", matrix("rot", F.lit(0)), "betas")), F.transform(F.sequence(F.lit(0), F.lit(infill.JOINTS - 1)), lambda j: matrix("pose", j)))
    rows = there.join(valid, [*KEYS, "is_right"]).select(*KEYS, "is_right", F.posexplode(joints).alias("j", "v")).select(*KEYS, "is_right", "j", F.posexplode("v").alias("i", "value"))
    return rows.select(*KEYS, "is_right", "j", "i", (F.round("value", 6) + 0.0).alias("value"))


#: A wrist with five fingers of three joints.
TREE = Skeleton((-1, 0, 1, 2, 0, 4, 5, 0, 7, 8, 0, 10, 11, 0, 13, 14), tuple((0.3 + math.sin(j), math.cos(j), 0.1 * j) for j in range(16)))
JOINTS = "tree(joint, parent, dx, dy, dz, len) AS (VALUES " + ", ".join(f"({j}, {p}, {o[0]!r}::DOUBLE, {o[1]!r}::DOUBLE, {o[2]!r}::DOUBLE, {n!r}::DOUBLE)" for j, (p, o, n) in enumerate(zip(TREE.parents, TREE.offsets, TREE.lengths, strict=True))) + ")"
LOCAL = f"l AS (SELECT vec_id, j AS joint, e[1:3] AS root, {', '.join(f'e[4 * j + {i + 1}] / sqrt(e[4 * j + 1]**2 + e[4 * j + 2]**2 + e[4 * j + 3]**2 + e[4 * j + 4]**2) AS {c}' for i, c in enumerate(Q))} FROM (SELECT vec_id, e, unnest(range(0, 16)) AS j FROM {E}))"
STEP = """
SELECT vec_id, joint, w, x, y, z, root[1] AS px, root[2] AS py, root[3] AS pz FROM l WHERE joint = 0
UNION ALL
SELECT f.vec_id, t.joint, f.w * l.w - f.x * l.x - f.y * l.y - f.z * l.z, f.w * l.x + f.x * l.w + f.y * l.z - f.z * l.y, f.w * l.y - f.x * l.z + f.y * l.w + f.z * l.x, f.w * l.z + f.x * l.y - f.y * l.x + f.z * l.w,
  px + (1 - 2 * (f.y * f.y + f.z * f.z)) * dx + 2 * (f.x * f.y - f.w * f.z) * dy + 2 * (f.x * f.z + f.w * f.y) * dz,
  py + 2 * (f.x * f.y + f.w * f.z) * dx + (1 - 2 * (f.x * f.x + f.z * f.z)) * dy + 2 * (f.y * f.z - f.w * f.x) * dz,
  pz + 2 * (f.x * f.z - f.w * f.y) * dx + 2 * (f.y * f.z + f.w * f.x) * dy + (1 - 2 * (f.x * f.x + f.y * f.y)) * dz
FROM f JOIN tree t ON t.parent = f.joint JOIN l ON l.vec_id = f.vec_id AND l.joint = t.joint
"""


def _posed(spark, sf_dir):
    d = vectors(spark, sf_dir)
    return d.select("vec_id", F.slice("e", 1, 3).alias("root"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: R.unit(F.slice("e", 4 * j + 1, 4), 4)).alias("q"))


def _numbers(*columns: tuple) -> list:
    return [(F.round(c, 6) + 0.0).alias(n) for c, n in columns]


@query(f"WITH RECURSIVE {JOINTS}, {LOCAL}, f AS ({STEP}) SELECT vec_id, CAST(joint AS INTEGER) AS joint, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('w', 'x', 'y', 'z', 'px', 'py', 'pz'))} FROM f")
def skeleton_forward(spark, sf_dir):
    rows = _posed(spark, sf_dir).select("vec_id", F.posexplode(TREE.forward(F.col("q"), F.col("root"))).alias("joint", "f"))
    return rows.select("vec_id", "joint", *_numbers(*((F.get("f.turn", F.lit(i)), c) for i, c in enumerate(Q)), *((F.get("f.place", F.lit(i)), c) for i, c in enumerate(("px", "py", "pz")))))


@query(f"""
WITH RECURSIVE {JOINTS}, k AS (SELECT joint AS old, row_number() OVER (ORDER BY joint) - 1 AS joint, parent FROM tree WHERE joint NOT IN (3, 4, 12)),
  l0 AS (SELECT vec_id, j AS old, e[1:3] AS root, {', '.join(f'e[4 * j + {i + 1}] / sqrt(e[4 * j + 1]**2 + e[4 * j + 2]**2 + e[4 * j + 3]**2 + e[4 * j + 4]**2) AS {c}' for i, c in enumerate(Q))} FROM (SELECT vec_id, e, unnest(range(0, 16)) AS j FROM {E})),
  l AS (SELECT l0.*, k.joint FROM l0 JOIN k USING (old)),
  less AS (SELECT k.joint, CASE WHEN k.parent < 0 THEN -1 ELSE (SELECT max(b.joint) FROM k b WHERE b.old <= k.parent) END AS parent, dx, dy, dz FROM k JOIN tree ON tree.joint = k.old),
  f AS ({STEP.replace('JOIN tree t', 'JOIN less t')})
SELECT vec_id, CAST(joint AS INTEGER) AS joint, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('px', 'py', 'pz'))} FROM f
""")
def skeleton_without(spark, sf_dir):
    """Three joints fewer: two ends, and one whose children hang elsewhere."""
    less, kept = TREE.without({3, 4, 12})
    rows = _posed(spark, sf_dir).withColumn("q", F.array(*(F.get("q", F.lit(j)) for j in kept)))
    rows = rows.select("vec_id", F.posexplode(less.forward(F.col("q"), F.col("root"), identity_leaves=True)).alias("joint", "f"))
    return rows.select("vec_id", "joint", *_numbers(*((F.get("f.place", F.lit(i)), c) for i, c in enumerate(("px", "py", "pz")))))


def _points(spark, sf_dir):
    d = vectors(spark, sf_dir)
    return d.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.slice("e", 3 * j + 1, 3)).alias("u"))


POINTS = f"u AS (SELECT vec_id, j AS joint, e[3 * j + 1] AS x, e[3 * j + 2] AS y, e[3 * j + 3] AS z FROM (SELECT vec_id, e, unnest(range(0, 16)) AS j FROM {E}))"
XYZ = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in "xyz")


@query(f"""
WITH RECURSIVE {JOINTS}, {POINTS}, p AS (SELECT * FROM u WHERE joint = 0 UNION ALL
  SELECT p.vec_id, t.joint, {', '.join(f'p.{c} + u.{c} / sqrt(u.x * u.x + u.y * u.y + u.z * u.z) * len' for c in 'xyz')} FROM p JOIN tree t ON t.parent = p.joint JOIN u ON u.vec_id = p.vec_id AND u.joint = t.joint)
SELECT vec_id, CAST(joint AS INTEGER) AS joint, {XYZ} FROM p
""")
def skeleton_positions(spark, sf_dir):
    rows = _points(spark, sf_dir).select("vec_id", F.posexplode(TREE.positions(F.col("u"))).alias("joint", "p"))
    return rows.select("vec_id", "joint", *_numbers(*((F.get("p", F.lit(i)), c) for i, c in enumerate("xyz"))))


@query(f"""
WITH {JOINTS}, {POINTS} SELECT vec_id, CAST(joint AS INTEGER) AS joint, {XYZ} FROM (
  SELECT u.vec_id, u.joint, {', '.join(f'CASE WHEN t.parent < 0 THEN u.{c} ELSE (u.{c} - p.{c}) / len END AS {c}' for c in 'xyz')} FROM u JOIN tree t USING (joint) LEFT JOIN u p ON p.vec_id = u.vec_id AND p.joint = t.parent)
""")
def skeleton_units(spark, sf_dir):
    rows = _points(spark, sf_dir).select("vec_id", F.posexplode(TREE.units(F.col("u"))).alias("joint", "p"))
    return rows.select("vec_id", "joint", *_numbers(*((F.get("p", F.lit(i)), c) for i, c in enumerate("xyz"))))
