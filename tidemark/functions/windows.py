"""Window idioms of panels: guarded rolling aggregates and average-tie percent ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def rolling(how: Callable[[Column], Column], x: Column, n: int, least: int | None = None) -> Column:
    """``how`` over the last ``n`` rows; null unless ``least`` (all ``n`` by default) of them have a value."""
    w = by_ticker().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) >= (least or n), how(x).over(w))


def change(x: Column, n: int) -> Column:
    return x / F.lag(x, n).over(by_ticker()) - 1


def percent_rank(x: Column, *keys: str) -> Column:
    """Average rank of ties over the number of values; null stays null. One sort by key and value."""
    ordered = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(ordered) - F.rank().over(ordered) + 1  # rows up to here end with the ties
    return F.when(x.isNotNull(), (F.rank().over(ordered) + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*keys)))
