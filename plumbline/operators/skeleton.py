"""Skeletons: a tree of joints given as a table of parents, and what is folded along it.

A skeleton is small and its size is checked. Poses are rows with arrays over the joints; a fold takes the
joints in order, each from what its parent got, so an expression's size doesn't depend on the tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rotation as R

MOST_JOINTS = 1024


@dataclass(frozen=True)
class Skeleton:
    """Parents (-1: the root, which is first) and offsets from them; a parent comes before its children."""

    parents: tuple[int, ...]
    offsets: tuple[tuple[float, float, float], ...]

    def __post_init__(self) -> None:
        odd = [j for j, p in enumerate(self.parents) if not (-1 < p < j) and (j or p != -1)]
        if odd or len(self.parents) != len(self.offsets) or not self.parents:
            raise ValueError(f"joints without a parent before them: {odd}" if odd else "a skeleton needs an offset for each of its joints")

    @classmethod
    def from_table(cls, joints: DataFrame, joint: str = "joint", parent: str = "parent", offset: str = "offset") -> Skeleton:
        """From rows (joint, parent, offset: three numbers), joints numbered from 0."""
        rows = joints.select(joint, parent, offset).limit(MOST_JOINTS + 1).collect()
        rows = sorted((r[0], r[1], tuple(map(float, r[2]))) for r in rows)
        if len(rows) > MOST_JOINTS or [r[0] for r in rows] != list(range(len(rows))):
            raise ValueError(f"joints have to be numbered from 0 without gaps, {MOST_JOINTS} at most")
        return cls(tuple(r[1] for r in rows), tuple(r[2] for r in rows))

    @property
    def lengths(self) -> list[float]:
        """Of the bones from the parents; 1 for the root."""
        return [1.0 if p < 0 else math.hypot(*o) for p, o in zip(self.parents, self.offsets, strict=True)]

    @property
    def leaves(self) -> list[bool]:
        return [j not in self.parents for j in range(len(self.parents))]

    def without(self, gone: set[int]) -> tuple[Skeleton, list[int]]:
        """The skeleton of the other joints, numbered anew, and their old numbers.

        A child of a joint that goes hangs on the last kept joint before that one.
        """
        kept = [j for j in range(len(self.parents)) if j not in gone]
        anew = {-1: -1} | {p: sum(k <= p for k in kept) - 1 for p in range(len(self.parents))}
        return Skeleton(tuple(anew[self.parents[j]] for j in kept), tuple(self.offsets[j] for j in kept)), kept

    def _fold(self, root: Column, step) -> Column:
        """One struct a joint: root for the first, then step(parent's struct, number, offset, length, leaf)."""
        tree = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(p).alias("p"), F.array(*map(F.lit, o)).alias("offset"), F.lit(n).alias("length"), F.lit(leaf).alias("leaf")) for j, (p, o, n, leaf) in enumerate(zip(self.parents, self.offsets, self.lengths, self.leaves, strict=True)) if j))
        if len(self.parents) == 1:
            return F.array(root)
        return F.aggregate(tree, F.array(root), lambda done, b: F.concat(done, F.array(step(F.get(done, b["p"]), b["j"], b["offset"], b["length"], b["leaf"]))))

    def forward(self, rotations: Column, root: Column, identity_leaves: bool = False) -> Column:
        """turn (quaternion) and place of every joint, from quaternions relative to the parents and the root's place.

        identity_leaves: joints without children have no turn, as nothing depends on it.
        """
        none = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))

        def step(parent, j, offset, length, leaf):
            turn = R.quat_mul(parent["turn"], F.get(rotations, j))
            place = R.plus(parent["place"], R.mat_vec(R.matrix_from_quat(parent["turn"]), offset))
            return F.struct((F.when(leaf, none).otherwise(turn) if identity_leaves else turn).alias("turn"), place.alias("place"))

        return self._fold(F.struct(F.get(rotations, F.lit(0)).alias("turn"), root.alias("place")), step)

    def positions(self, units: Column) -> Column:
        """Places from directions: each joint a bone's length from its parent. The first is the root's place."""
        step = lambda parent, j, offset, length, leaf: R.plus(parent, R.bind(R.unit(F.get(units, j)), lambda u: R.scale(u, length)))
        return self._fold(F.get(units, F.lit(0)), step)

    def units(self, positions: Column) -> Column:
        """Differences from the parents' places, by the bones' lengths; the root's place first."""
        tree = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(max(p, 0)).alias("p"), F.lit(n).alias("n")) for j, (p, n) in enumerate(zip(self.parents, self.lengths, strict=True))))
        unit = lambda b: F.when(b["j"] == 0, F.get(positions, F.lit(0))).otherwise(R.bind(R.minus(F.get(positions, b["j"]), F.get(positions, b["p"])), lambda v: R.scale(v, 1 / b["n"])))
        return F.transform(tree, unit)
