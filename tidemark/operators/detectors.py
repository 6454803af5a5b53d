"""Detectors of unusual rows: a forest of isolating trees and a boundary round the bulk; and what several of them agree on."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import exact_quantiles
from tidemark.operators.trees import Trees, numbers
from tidemark.sources.staging import staged

#: Rows that all trees draw from, chosen by a hash of their values; the trees are the same at any size beyond it.
FOREST_ROWS = 4096
#: Euler's constant, in the mean depth of a search tree.
EULER = 0.5772156649015329


def mean_depth(n: float) -> float:
    """Mean depth at which a search tree of ``n`` rows ends."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Isolating trees of ``drawn`` rows each; ``depth`` at an end counts what the rows left there would need on."""

    trees: Trees
    drawn: int
    depth: np.ndarray

    def scored(self, rows: DataFrame, as_name: str = "isolation") -> DataFrame:
        """``rows`` with ``-2 ** (-mean depth / expected depth)``, lower where rows are isolated sooner."""
        out = rows.withColumn("__ends", self.trees.ends())
        depth = self.trees.sum_at_ends(self.depth, "__ends") / (self.trees.trees * mean_depth(self.drawn))
        whole = F.lit(True)
        for n in self.trees.names:
            whole &= F.col(n).isNotNull()
        return out.withColumn(as_name, F.when(whole, -F.pow(F.lit(2.0), -depth))).drop("__ends")


def chance(seed: int, tree: Column, node: Column, what: str) -> Column:
    """A number in 0..1 that follows from its arguments alone."""
    return F.crc32(F.concat_ws("/", F.lit(str(seed)), tree.cast("string"), node.cast("string"), F.lit(what)).cast("binary")) / float(1 << 32)


def plain_chance(seed: int, tree: int, node: int, what: str) -> float:
    return zlib.crc32(f"{seed}/{tree}/{node}/{what}".encode()) / (1 << 32)


def isolation_forest(rows: DataFrame, names: tuple[str, ...], trees: int = 200, drawn: int = 256, seed: int = 42) -> Forest:
    """Trees of random axes and cuts between the least and largest value there, grown for all trees at once, level by level.

    Each tree draws ``drawn`` of FOREST_ROWS rows without repeats. A level is one aggregate by tree and node, of at most
    ``trees * drawn`` rows, and its splits send the rows on. Rows that lack a value are left out.
    """
    whole = rows.select(*[F.col(n).cast("double").alias(n) for n in names]).where(" and ".join(f"abs({n}) < double('infinity')" for n in names))
    base = whole.withColumn("h", F.xxhash64(*names)).orderBy("h", *names).limit(FOREST_ROWS)
    base = staged(base.withColumn("row", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("h", *names))).drop("h"))  # FOREST_ROWS rows
    taken = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    place = Window.partitionBy("tree").orderBy(F.xxhash64("row", "tree", F.lit(seed)), "row")
    held = staged(taken.withColumn("n", F.row_number().over(place)).where(F.col("n") <= drawn).drop("n", "row").withColumn("node", F.lit(1)))
    drawn = min(drawn, base.count())
    levels = max(1, math.ceil(math.log2(max(2, drawn))))
    width = 2 << levels
    axis, cut, depth = np.full(trees * width, -1), np.zeros(trees * width), np.zeros(trees * width)
    for level in range(levels + 1):
        spread = F.array_compact(F.array(*[F.when(F.max(n) > F.min(n), F.struct(F.lit(i).alias("axis"), F.min(n).alias("lo"), F.max(n).alias("hi"))) for i, n in enumerate(names)]))
        nodes = held.groupBy("tree", "node").agg(F.count("*").alias("n"), spread.alias("spread"))
        pick = F.get("spread", F.floor(chance(seed, F.col("tree"), F.col("node"), "axis") * F.size("spread")).cast("int"))
        nodes = nodes.select("tree", "node", "n", pick.alias("s")).select("tree", "node", "n", F.col("s.axis").alias("axis"), (F.col("s.lo") + chance(seed, F.col("tree"), F.col("node"), "cut") * (F.col("s.hi") - F.col("s.lo"))).alias("cut"))
        split = (F.col("n") > 1) & F.col("axis").isNotNull() if level < levels else F.lit(False)
        nodes = nodes.withColumns({"axis": F.when(split, F.col("axis")), "cut": F.when(split, F.col("cut"))})
        nodes = staged(nodes)
        for r in nodes.collect():  # trees * 2 ** level rows at most
            at = r["tree"] * width + r["node"]
            if r["axis"] is None:
                depth[at] = level + mean_depth(r["n"])
            else:
                axis[at], cut[at] = r["axis"], r["cut"]
        if level < levels:
            x = F.array(*names)
            on = held.join(F.broadcast(nodes.where("axis is not null").drop("n")), ["tree", "node"])
            held = on.withColumn("node", 2 * F.col("node") + (F.get(x, F.col("axis")) > F.col("cut")).cast("int")).drop("axis", "cut")
            held = staged(held)
    return Forest(Trees(names, trees, levels, axis, cut), drawn, depth)


def flagged(rows: DataFrame, score: str, shares: tuple[float, ...]) -> DataFrame:
    """``flag_p`` for each share: 1 where the score lies below the exact ``p`` percent quantile, 0 elsewhere, null without one."""
    rows = staged(rows)
    cuts = exact_quantiles(rows, (score,), shares)[score]
    return rows.withColumns({f"flag_{round(100 * p)}": (F.col(score) < F.lit(cut)).cast("int") for p, cut in zip(shares, cuts, strict=True)})


def isolation_scores(rows: DataFrame, names: tuple[str, ...], shares: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1), **more: int) -> DataFrame:
    """``rows`` with ``isolation`` (lower is more unusual) and a flag for each share; every row is scored in the JVM."""
    return flagged(isolation_forest(rows, names, **more).scored(rows), "isolation", shares)


@dataclass(frozen=True)
class Boundary:
    """``weights`` over cosine features ``sqrt(2 / D) * cos(waves x + phases)``; rows below ``offset`` lie outside."""

    names: tuple[str, ...]
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    offset: float
    objective: float

    def score(self) -> Column:
        waves, phases, weights = numbers(self.waves.ravel()), numbers(self.phases), numbers(self.weights)
        d = len(self.names)

        def wave(j: Column) -> Column:
            inner = F.get(phases, j)
            for i, n in enumerate(self.names):
                inner = inner + F.get(waves, j * d + i) * F.col(n)
            return F.get(weights, j) * F.cos(inner)

        total = F.aggregate(F.sequence(F.lit(0), F.lit(len(self.phases) - 1)), F.lit(0.0), lambda s, j: s + wave(j))
        return math.sqrt(2 / len(self.phases)) * total - self.offset


def smooth_hinge(gap: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """``max(0, gap)`` with its corner rounded over ``width``, and the slope."""
    slope = np.clip(gap / width, 0, 1)
    return np.where(gap < width, slope * gap / 2, gap - width / 2), slope


def minimised(cost: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], x: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton steps; ``cost`` takes several points at once, so that a line search is one job."""
    (value, slope), pairs = cost([x])[0], []
    for _ in range(rounds):
        direction, kept = -slope, []
        for s, y in reversed(pairs):
            a = s @ direction / (s @ y)
            direction = direction - a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            direction = direction + s * (a - y @ direction / (s @ y))
        steps = [1.0, 0.4, 0.1, 0.01, 0.0001] if pairs else [1.0, 0.1, 0.01, 0.001, 0.00001]
        tried = cost([x + t * direction for t in steps])
        t, (new_value, new_slope) = min(zip(steps, tried, strict=True), key=lambda z: z[1][0])
        if not new_value < value:
            break
        s, y = t * direction, new_slope - slope
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs[-9:], (s, y)]
        gain, x, value, slope = value - new_value, x + s, new_value, new_slope
        if gain < tolerance * max(1e-12, abs(value)):
            break
    return x, value


def one_class_boundary(rows: DataFrame, names: tuple[str, ...], nu: float = 0.05, features: int = 128, seed: int = 42, rounds: int = 60) -> Boundary:
    """The boundary that leaves about ``nu`` of the rows outside: a one-class support vector machine whose Gaussian kernel
    is drawn as ``features`` random cosines, its scale one over the axes times the variance of all values.

    Half the squared weights, less the offset, plus the mean shortfall over ``nu`` is minimised over all rows: a round is
    one job of sums by partition, a vector for each, and nothing is sampled. The hinge's corner is rounded, by less and
    less. Rows that lack a value take no part.
    """
    held = rows.select(*[F.col(n).cast("double").alias(n) for n in names]).where(" and ".join(f"abs({n}) < double('infinity')" for n in names))
    held = staged(held)
    every = F.array(*names)
    n, total, square = held.agg(F.count("*"), F.sum(F.aggregate(every, F.lit(0.0), lambda s, x: s + x)), F.sum(F.aggregate(every, F.lit(0.0), lambda s, x: s + x * x))).first()
    d = len(names)
    variance = square / (n * d) - (total / (n * d)) ** 2 if n else 1.0
    gamma = 1 / (d * variance) if variance > 0 else 1.0
    rng = np.random.default_rng(seed)
    waves = rng.normal(0, math.sqrt(2 * gamma), (features, d))
    phases = rng.uniform(0, 2 * math.pi, features)
    scale = math.sqrt(2 / features)
    if not n:
        return Boundary(names, waves, phases, np.zeros(features), 0.0, 0.0)

    def sums(points: list[np.ndarray], width: float) -> list[tuple[float, np.ndarray]]:
        weights, offsets = np.array([p[:-1] for p in points]), np.array([p[-1] for p in points])

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(points), features + 2))
            for batch in batches:
                x = np.column_stack([c.to_numpy() for c in batch.columns])
                z = scale * np.cos(x @ waves.T + phases)
                loss, slope = smooth_hinge(offsets - z @ weights.T, width)
                out[:, 0] += loss.sum(axis=0)
                out[:, 1] += slope.sum(axis=0)
                out[:, 2:] += slope.T @ z
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], ["sums"])

        parts = held.mapInArrow(part, "sums array<double>").collect()  # a vector for each partition and point
        summed = np.sum([r["sums"] for r in parts], axis=0).reshape(len(points), -1)
        found = []
        for point, s in zip(points, summed, strict=True):
            value = point[:-1] @ point[:-1] / 2 - point[-1] + s[0] / (nu * n)
            found.append((value, np.append(point[:-1] - s[2:] / (nu * n), s[1] / (nu * n) - 1)))
        return found

    point = np.zeros(features + 1)
    for width in (0.1, 0.01, 0.001):
        point, _ = minimised(lambda ps, width=width: sums(ps, width), point, rounds // 3, 1e-5)
    objective = sums([point], 1e-12)[0][0]
    return Boundary(names, waves, phases, point[:-1], float(point[-1]), float(objective))


def boundary_scores(rows: DataFrame, names: tuple[str, ...], nu: float = 0.05, **more: int) -> DataFrame:
    """``rows`` with ``boundary`` (below 0: outside) and ``outside``; every row is scored in the JVM."""
    scored = rows.withColumn("boundary", one_class_boundary(rows, names, nu, **more).score())
    return scored.withColumn("outside", (F.col("boundary") < 0).cast("int"))
