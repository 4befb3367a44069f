"""Windows of hand poses in a frame of their own: made canonical, filled, packed for a model, and back.

A row is a hand at a time: trans (3), rot (axis-angle, 3), pose (15 joints' axis-angles, 45), betas (10) and
valid. A hand's first row in its window gives the frame of reference, whether valid or not.

offset is what lies between trans and the place about which the hand turns. It comes from a hand
model and is nought without one. A window needs one shuffle, by its key, for all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import rotation as R
from plumbline.operators import fill, tracks

JOINTS = 15
#: trans, betas, 6-D root, 6-D joints.
NUMBERS = 3 + 10 + 6 + 6 * JOINTS


def _offset(offset: Column | None) -> Column:
    return F.array(*(F.lit(0.0) for _ in range(3))) if offset is None else offset


def _turned(r: Column, rot: str) -> Column:
    return R.axis_angle_from_matrix(R.mat_mul(r, R.matrix_from_axis_angle(F.col(rot))))


def canonicalise(df: DataFrame, by: list[str], at: str, offset: Column | None = None) -> DataFrame:
    """df with trans and rot in the frame of the first row of its key, and reference: struct(r, root, offset), which leads back."""
    first = F.first(F.struct("rot", "trans", _offset(offset).alias("offset"))).over(Window.partitionBy(*by).orderBy(at))
    df = df.withColumn("__f", first).withColumn("reference", F.struct(R.matrix_from_axis_angle(F.col("__f.rot")).alias("r"), R.minus(F.col("__f.trans"), F.col("__f.offset")).alias("root"), F.col("__f.offset").alias("offset")))
    back = R.transpose(F.col("reference.r"))
    root = R.minus(R.minus(F.col("trans"), _offset(offset)), F.col("reference.root"))
    moved = R.plus(R.minus(R.mat_vec(back, root), F.col("reference.offset")), _offset(offset))
    return df.withColumns({"trans": moved, "rot": _turned(back, "rot")}).drop("__f")


def to_world(df: DataFrame, offset: Column | None = None) -> DataFrame:
    """The inverse of canonicalise, by the column reference, which goes."""
    r = F.col("reference.r")
    turned = R.mat_vec(r, R.plus(R.minus(F.col("trans"), _offset(offset)), F.col("reference.offset")))
    return df.withColumns({"trans": R.plus(R.plus(turned, F.col("reference.root")), _offset(offset)), "rot": _turned(r, "rot")}).drop("reference")


def fill_hands(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Rows that aren't valid from the valid ones around them: numbers on lines, each joint's rotation along its arc.

    Before the first and after the last valid row its values hold. A key with fewer than two valid rows is left as it is.
    """
    columns = ["trans", "rot", "pose", "betas"]
    found = fill._around(df, by, at, F.when(F.col("valid"), F.struct(*columns)))
    w = fill._weight(at)

    def line(c: str) -> Column:
        return F.zip_with(f"__l.y.{c}", f"__r.y.{c}", lambda a, b: a + (b - a) * w)

    def arcs(c: str, joints: int) -> Column:
        vector = lambda side, j: F.slice(f"{side}.y.{c}", 3 * j + 1, 3)
        arc = lambda j: R.axis_angle_from_quat(R.slerp(R.quat_from_axis_angle(vector("__l", j)), R.quat_from_axis_angle(vector("__r", j)), w))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(joints - 1)), arc))

    between = {"trans": line("trans"), "betas": line("betas"), "rot": arcs("rot", 1), "pose": arcs("pose", JOINTS)}
    made = {c: F.when(F.col("valid") | (F.col("__n") < 2), F.col(c)).otherwise(F.coalesce(F.when(w.isNotNull(), between[c]), F.col(f"__l.y.{c}"), F.col(f"__r.y.{c}"))) for c in columns}
    return found.withColumns(made).drop("__p", "__l", "__r", "__n")


def numbers(joint_rotations: str, joints: int) -> Column:
    """The 6-D forms of axis-angles that stand one after another."""
    sixd = lambda j: R.sixd_columns(R.matrix_from_axis_angle(F.slice(joint_rotations, 3 * j + 1, 3)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(joints - 1)), sixd))


def angles(packed: Column, joints: int) -> Column:
    """The inverse of numbers()."""
    vector = lambda j: R.axis_angle_from_matrix(R.matrix_from_sixd_columns(F.slice(packed, 6 * j + 1, 6)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(joints - 1)), vector))


def pack(df: DataFrame, keys: list[str], right: Column) -> DataFrame:
    """keys, packed: 109 numbers of the left hand, then of the right; and references: left and right."""
    hand = F.concat("trans", "betas", numbers("rot", 1), numbers("pose", JOINTS))
    rows = df.select(*keys, right.alias("__right"), hand.alias("packed"), "reference")
    side = lambda is_right: F.min(F.when(F.col("__right") == is_right, F.col("reference")))
    return tracks.side_by_side(rows, keys, F.col("__right"), "packed", NUMBERS, F.array(side(False), side(True)).alias("references"))


def unpack(df: DataFrame) -> DataFrame:
    """The inverse of pack: a row a hand, with is_right, for hands that have a reference."""
    keys = [c for c in df.columns if c not in ("packed", "references")]
    rows = tracks.one_by_one(df, "packed", NUMBERS).where(F.get("references", F.col("is_right").cast("int")).isNotNull())
    cut = lambda start, n: F.slice("packed", start, n)
    return rows.select(
        *keys, "is_right", cut(1, 3).alias("trans"), angles(cut(14, 6), 1).alias("rot"), angles(cut(20, 6 * JOINTS), JOINTS).alias("pose"), cut(4, 10).alias("betas"),
        F.get("references", F.col("is_right").cast("int")).alias("reference"),
    )
