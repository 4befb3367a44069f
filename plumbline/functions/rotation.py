"""Rotations as column expressions: axis-angle, quaternions (wxyz), matrices (rows), 6-D.

Vectors and quaternions are arrays of doubles, matrices arrays of three rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(x: Column, *path: int) -> Column:
    for i in path:
        x = F.get(x, F.lit(i))
    return x


def bind(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def vec(*x: Column) -> Column:
    return F.array(*x)


def dot(a: Column, b: Column, n: int = 3) -> Column:
    out = at(a, 0) * at(b, 0)
    for i in range(1, n):
        out = out + at(a, i) * at(b, i)
    return out


def norm(a: Column, n: int = 3) -> Column:
    return F.sqrt(dot(a, a, n))


def scale(a: Column, s: Column, n: int = 3) -> Column:
    return vec(*(at(a, i) * s for i in range(n)))


def plus(a: Column, b: Column, n: int = 3) -> Column:
    return vec(*(at(a, i) + at(b, i) for i in range(n)))


def minus(a: Column, b: Column, n: int = 3) -> Column:
    return vec(*(at(a, i) - at(b, i) for i in range(n)))


def cross(a: Column, b: Column) -> Column:
    return vec(at(a, 1) * at(b, 2) - at(a, 2) * at(b, 1), at(a, 2) * at(b, 0) - at(a, 0) * at(b, 2), at(a, 0) * at(b, 1) - at(a, 1) * at(b, 0))


def unit(a: Column, n: int = 3, least: float = 1e-12) -> Column:
    return bind(a, lambda v: bind(1 / F.greatest(norm(v, n), F.lit(least)), lambda s: scale(v, s, n)))


def quat_from_axis_angle(v: Column) -> Column:
    """At no angle the vector's share is its limit, a half."""

    def made(x: Column) -> Column:
        angle, v = x["angle"], x["v"]
        k = F.when(angle > 0, F.try_divide(F.sin(angle / 2), angle)).otherwise(0.5)
        return vec(F.cos(angle / 2), *(at(v, i) * k for i in range(3)))

    return bind(v, lambda v: bind(F.struct(v.alias("v"), norm(v).alias("angle")), made))


def axis_angle_from_quat(q: Column) -> Column:
    """The angle is within half a turn either way."""

    def made(x: Column) -> Column:
        q, s = x["q"], x["s"]
        two = F.when(at(q, 0) < 0, 2 * F.atan2(-s, -at(q, 0))).otherwise(2 * F.atan2(s, at(q, 0)))
        k = F.when(s > 0, F.try_divide(two, s)).otherwise(2.0)
        return bind(k, lambda k: vec(*(at(q, i) * k for i in (1, 2, 3))))

    return bind(q, lambda q: bind(F.struct(q.alias("q"), F.sqrt(at(q, 1) * at(q, 1) + at(q, 2) * at(q, 2) + at(q, 3) * at(q, 3)).alias("s")), made))


def quat_mul(a: Column, b: Column) -> Column:
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda p: _quat_mul(p["a"], p["b"]))


def _quat_mul(a: Column, b: Column) -> Column:
    w, x, y, z = (at(a, i) for i in range(4))
    p, q, r, s = (at(b, i) for i in range(4))
    return vec(w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p)


def quat_inverse(q: Column) -> Column:
    return bind(q, lambda q: bind(dot(q, q, 4) + 1e-8, lambda n: vec(at(q, 0) / n, *(-at(q, i) / n for i in (1, 2, 3)))))


def matrix_from_quat(q: Column) -> Column:
    return bind(unit(q, 4), _matrix)


def _matrix(u: Column) -> Column:
    w, x, y, z = (at(u, i) for i in range(4))
    return vec(
        vec(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        vec(2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        vec(2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def quat_from_matrix(m: Column) -> Column:
    """By the largest of the four squares, so that no small number divides."""
    return bind(m, _quat)


def _quat(m: Column) -> Column:
    a, e, i = at(m, 0, 0), at(m, 1, 1), at(m, 2, 2)
    skew = (at(m, 2, 1) - at(m, 1, 2), at(m, 0, 2) - at(m, 2, 0), at(m, 1, 0) - at(m, 0, 1))
    sums = (at(m, 0, 1) + at(m, 1, 0), at(m, 0, 2) + at(m, 2, 0), at(m, 1, 2) + at(m, 2, 1))
    fours = (1 + a + e + i, 1 + a - e - i, 1 - a + e - i, 1 - a - e + i)
    parts = (
        (fours[0], skew[0], skew[1], skew[2]),
        (skew[0], fours[1], sums[0], sums[1]),
        (skew[1], sums[0], fours[2], sums[2]),
        (skew[2], sums[1], sums[2], fours[3]),
    )
    best = F.greatest(*fours)
    made = [vec(*(p * 0.5 / F.sqrt(best) for p in row)) for row in parts]
    return F.when(fours[0] == best, made[0]).when(fours[1] == best, made[1]).when(fours[2] == best, made[2]).otherwise(made[3])


def matrix_from_axis_angle(v: Column) -> Column:
    return matrix_from_quat(quat_from_axis_angle(v))


def axis_angle_from_matrix(m: Column) -> Column:
    """Not-a-number becomes 0."""
    return bind(axis_angle_from_quat(quat_from_matrix(m)), lambda v: vec(*(F.nanvl(at(v, i), F.lit(0.0)) for i in range(3))))


def mat_mul(a: Column, b: Column) -> Column:
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda p: _mat_mul(p["a"], p["b"]))


def _mat_mul(a: Column, b: Column) -> Column:
    return vec(*(vec(*(at(a, i, 0) * at(b, 0, j) + at(a, i, 1) * at(b, 1, j) + at(a, i, 2) * at(b, 2, j) for j in range(3))) for i in range(3)))


def mat_vec(m: Column, v: Column) -> Column:
    return bind(F.struct(m.alias("m"), v.alias("v")), lambda p: vec(*(dot(at(p["m"], i), p["v"]) for i in range(3))))


def transpose(m: Column) -> Column:
    return vec(*(vec(*(at(m, j, i) for j in range(3))) for i in range(3)))


def sixd_columns(m: Column) -> Column:
    """The first two columns, interleaved by rows."""
    return vec(*(at(m, i, j) for i in range(3) for j in range(2)))


def sixd_rows(m: Column) -> Column:
    """The first two rows one after the other."""
    return vec(*(at(m, i, j) for i in range(2) for j in range(3)))


def _orthogonal(a: Column, b: Column, last) -> Column:
    """last of the two vectors made orthogonal unit ones, and their cross product."""
    first = bind(F.struct(unit(a).alias("x"), b.alias("b")), lambda p: F.struct(p["x"].alias("x"), unit(minus(p["b"], scale(p["x"], dot(p["x"], p["b"])))).alias("y")))
    return bind(first, lambda p: last(p["x"], p["y"], cross(p["x"], p["y"])))


def matrix_from_sixd_columns(d: Column) -> Column:
    return _orthogonal(vec(at(d, 0), at(d, 2), at(d, 4)), vec(at(d, 1), at(d, 3), at(d, 5)), lambda *c: vec(*(vec(*(at(x, i) for x in c)) for i in range(3))))


def matrix_from_sixd_rows(d: Column) -> Column:
    return _orthogonal(vec(at(d, 0), at(d, 1), at(d, 2)), vec(at(d, 3), at(d, 4), at(d, 5)), vec)


def mirror(v: Column) -> Column:
    """An axis-angle of the other hand."""
    return vec(at(v, 0), -at(v, 1), -at(v, 2))


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Along the shortest arc; nearly equal rotations along the line."""

    def made(x: Column) -> Column:
        c = F.least(F.abs(x["d"]), F.lit(1.0))
        angle, flat, sign = F.acos(c), c > 1 - 1e-8, F.when(x["d"] < 0, -1.0).otherwise(1.0)
        p = F.when(flat, 1 - x["t"]).otherwise(F.try_divide(F.sin((1 - x["t"]) * angle), F.sin(angle)))
        q = F.when(flat, x["t"]).otherwise(F.try_divide(F.sin(x["t"] * angle), F.sin(angle))) * sign
        return bind(F.struct(p.alias("p"), q.alias("q")), lambda w: unit(vec(*(w["p"] * at(x["a"], i) + w["q"] * at(x["b"], i) for i in range(4))), 4))

    return bind(F.struct(a.alias("a"), b.alias("b"), t.alias("t")), lambda x: bind(F.struct(x["a"].alias("a"), x["b"].alias("b"), x["t"].alias("t"), dot(x["a"], x["b"], 4).alias("d")), made))


def turned_in_plane(v: Column, degrees: Column) -> Column:
    """An axis-angle after a turn of the image."""
    return axis_angle_from_quat(quat_mul(quat_from_axis_angle(vec(F.lit(0.0), F.lit(0.0), -F.radians(degrees))), quat_from_axis_angle(v)))


def forward(parents: list[int], rotations: list[Column], offsets: list[Column]) -> list[Column]:
    """Places of a skeleton's joints from quaternions and offsets to the parents; the root's parent is -1.

    Parents come before their children. The tree is written out in the plan, so it should be small.
    """
    turns: list[Column] = []
    places: list[Column] = []
    for i, p in enumerate(parents):
        if p < 0:
            turns.append(rotations[i])
            places.append(offsets[i])
        else:
            turns.append(quat_mul(turns[p], rotations[i]))
            places.append(plus(places[p], mat_vec(matrix_from_quat(turns[p]), offsets[i])))
    return places
