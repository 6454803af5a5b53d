"""Rows that a few axes can't rebuild, and how much a detector leans on each of its columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import exact_quantiles
from tidemark.sources.staging import staged

#: Rows among which values are exchanged, on average.
GROUP_ROWS = 4096


def whole(names: tuple[str, ...]) -> Column:
    """Rows that have a finite number in each of the columns."""
    held = F.lit(True)
    for n in names:
        held &= F.coalesce(F.abs(F.col(n).cast("double")) < float("inf"), F.lit(False))
    return held


@dataclass(frozen=True)
class Reconstruction:
    """The mean of ordinary rows and the axes along which they vary most; ``left`` takes a row's distance from the mean to
    what the axes leave of it."""

    names: tuple[str, ...]
    mean: np.ndarray
    left: np.ndarray

    def scored(self, rows: DataFrame, as_name: str = "rebuilt_error") -> DataFrame:
        """``rows`` with ``error_<column>``, the squared miss in each column, and their mean; null where a value lacks."""
        away = [F.col(n).cast("double") - float(m) for n, m in zip(self.names, self.mean, strict=True)]

        def miss(weights: np.ndarray) -> Column:
            return F.pow(sum((float(w) * x for w, x in zip(weights, away, strict=True)), F.lit(0.0)), F.lit(2.0))

        errors = {f"error_{n}": F.when(whole(self.names), miss(w)) for n, w in zip(self.names, self.left, strict=True)}
        found = rows.withColumns(errors)
        return found.withColumn(as_name, sum((F.col(e) for e in errors), F.lit(0.0)) / len(self.names))


def ordinary(rows: DataFrame, names: tuple[str, ...], share: float = 0.9) -> Column:
    """The rows whose length is at most the exact ``share`` quantile of all lengths."""
    length = F.sqrt(sum((F.pow(F.col(n).cast("double"), F.lit(2.0)) for n in names), F.lit(0.0)))
    (cut,) = exact_quantiles(rows.where(whole(names)).select(length.alias("length")), ("length",), (share,))["length"]
    return whole(names) & (length <= F.lit(cut))


def reconstruction(rows: DataFrame, names: tuple[str, ...], axes: int, chosen: Column) -> Reconstruction:
    """The axes of the chosen rows: one aggregate of sums and products, a row of the square of the columns' number, comes
    to the driver, whatever the table's size. Without rows nothing is left out: every value is its own miss."""
    d = len(names)
    x = [F.col(n).cast("double") for n in names]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    held = rows.where(chosen & whole(names))
    first = held.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    if not first["n"]:
        return Reconstruction(names, np.zeros(d), np.eye(d))
    mean = np.array([first[f"m{i}"] for i in range(d)])
    away = [c - float(m) for c, m in zip(x, mean, strict=True)]
    sums = held.agg(*[F.sum(away[i] * away[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    spread = np.zeros((d, d))
    for i, j in pairs:
        spread[i, j] = spread[j, i] = sums[f"s{i}_{j}"] / first["n"]
    found = np.linalg.eigh(spread)[1][:, ::-1][:, :axes]
    return Reconstruction(names, mean, np.eye(d) - found @ found.T)


def reconstruction_scores(rows: DataFrame, names: tuple[str, ...], axes: int, sigmas: tuple[int, ...] = (2, 3), share: float = 0.9) -> DataFrame:
    """``rows`` with their errors and ``flag_<s>sigma``: 1 where the error lies over the mean of ordinary rows by more than
    so many of their deviations. A linear stand-in for a network that squeezes rows through a narrow layer."""
    rows = staged(rows)
    chosen = ordinary(rows, names, share)
    scored = staged(reconstruction(rows, names, axes, chosen).scored(rows))
    mean, deviation = scored.where(chosen).agg(F.avg("rebuilt_error"), F.stddev_pop("rebuilt_error")).first()
    cuts = {f"flag_{s}sigma": (F.col("rebuilt_error") > F.lit(None if mean is None else mean + s * deviation)).cast("int") for s in sigmas}
    return scored.withColumns(cuts)


def exchanged(rows: DataFrame, names: tuple[str, ...], by: tuple[str, ...], seed: int) -> DataFrame:
    """``rows`` with ``other_<column>``: the values of another row, each row giving its own to just one.

    Rows are dealt by a hash of ``by``, which tells them apart, to groups of some GROUP_ROWS and take the values of the
    row before them in the hash's order, the first one those of the last. Rows of equal values with keys of their own
    spread over all groups.
    """
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    dealt = rows.withColumn("__h", F.xxhash64(F.lit(seed), *by)).withColumn("__g", F.pmod(F.xxhash64(F.lit(seed), "__h"), F.lit(groups)))
    order = Window.partitionBy("__g").orderBy("__h", *by, *names)
    before = F.lag(F.struct(*names)).over(order)
    last = F.last(F.struct(*names)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    dealt = dealt.withColumn("__o", F.coalesce(before, last))
    return dealt.select(*rows.columns, *[F.col(f"__o.{n}").alias(f"other_{n}") for n in names])


def importance(
    rows: DataFrame, names: tuple[str, ...], by: tuple[str, ...], score: Callable[[DataFrame], DataFrame], as_name: str, cut: float, repeats: int = 3
) -> DataFrame:
    """Per column: how many of the flags ``score < cut`` change if the column's values are exchanged between rows, as a mean
    and a deviation over ``repeats``, and by how much scores move. Rows that lack a value are left out.

    Every row is scored once for each column and repeat, in one job.
    """
    base = staged(score(rows.where(whole(names)).select(*by, *names)).withColumnRenamed(as_name, "__base"))
    parts = None
    for r in range(repeats):
        part = exchanged(base, names, by, r).withColumn("repeat", F.lit(r))
        parts = part if parts is None else parts.unionByName(part)
    each = parts.withColumn("feature", F.explode(F.array(*map(F.lit, names))))
    mixed = [F.when(F.col("feature") == n, F.col(f"other_{n}")).otherwise(F.col(n)).alias(n) for n in names]
    each = each.select("feature", "repeat", "__base", *mixed)
    scored = score(each.repartition(rows.sparkSession.sparkContext.defaultParallelism))
    flag = lambda x: (F.col(x) < cut).cast("int")
    runs = scored.groupBy("feature", "repeat").agg(F.avg(F.abs(flag(as_name) - flag("__base"))).alias("changed"), F.avg(F.abs(F.col(as_name) - F.col("__base"))).alias("moved"))
    return runs.groupBy("feature").agg(F.avg("changed").alias("importance_mean"), F.stddev_pop("changed").alias("importance_std"), F.avg("moved").alias("mean_shift"))
