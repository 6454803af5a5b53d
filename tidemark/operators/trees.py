"""Binary trees as arrays of the plan: rows are walked to their ends by expressions, in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(values: list[float] | np.ndarray, kind: str = "double") -> Column:
    """Many numbers as one literal array of the plan, which no row carries."""
    return F.split(F.lit(",".join(map(repr, np.asarray(values).tolist()))), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class Trees:
    """Node ``i`` of tree ``t`` lies at ``t * width + i``, its children at ``2i`` (up to the cut) and ``2i + 1`` (above it);
    ``axis`` is -1 at ends."""

    names: tuple[str, ...]
    trees: int
    levels: int
    axis: np.ndarray
    cut: np.ndarray

    @property
    def width(self) -> int:
        return 2 << self.levels

    def ends(self) -> Column:
        """For each tree the place of the end that a row comes to; missing values go to the lower child."""
        axis, cut = numbers(self.axis, "int"), numbers(self.cut)
        x = F.array(*[F.col(n).cast("double") for n in self.names])

        def end(tree: Column) -> Column:
            at = lambda node: tree * self.width + node
            above = lambda node: F.coalesce(F.get(x, F.get(axis, at(node))) > F.get(cut, at(node)), F.lit(False))
            step = lambda node, _: F.when(F.get(axis, at(node)) < 0, node).otherwise(2 * node + above(node).cast("int"))
            return at(F.aggregate(F.sequence(F.lit(1), F.lit(self.levels)), F.lit(1), step))

        return F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), end)

    def sum_at_ends(self, values: np.ndarray, ends: str) -> Column:
        """The sum over trees of the values at the ends that the column ``ends`` holds."""
        held = numbers(values)
        return F.aggregate(ends, F.lit(0.0), lambda s, at: s + F.get(held, at))

    def plain_ends(self, row: Callable[[str], float]) -> list[int]:
        """The same for one row, in Python; for tests."""
        found = []
        for tree in range(self.trees):
            at = 1
            while (axis := self.axis[tree * self.width + at]) >= 0:
                at = 2 * at + int(row(self.names[axis]) > self.cut[tree * self.width + at])
            found.append(tree * self.width + at)
        return found
