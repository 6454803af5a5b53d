"""Rounding and rolling idioms that queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Added before rounding where values are ratios of whole numbers: these often lie on a tie, which engines round apart.
OFF_TIES = 1.2345678e-7


def rounded_off_ties(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + OFF_TIES, digits) + F.lit(0.0) for n in names})


def round_off_ties_sql(names: tuple[str, ...], digits: int = 6) -> str:
    return ", ".join(f"round({n} + {OFF_TIES}, {digits}) + 0.0 AS {n}" for n in names)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def roll_sql(how: str, x: str, n: int, least: int | None = None) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least or n} THEN {how}({x}) {w} END"


def round_sql(names: tuple[str, ...], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)
