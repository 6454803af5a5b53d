"""Cleaning of bars and features: parsing, duplicates, gaps, imputation and standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_ticker
from tidemark.operators.order import exact_quantiles
from tidemark.sources.staging import staged


def number(text: Column) -> Column:
    """A padded number as double; null for a dash, an empty text and anything else that isn't a number."""
    trimmed = F.trim(text)
    return F.when(trimmed != "-", trimmed).try_cast("double")


def parsed_microstructure(raw: DataFrame) -> DataFrame:
    """Typed rows of exchange files whose headers and values are padded strings; equity series only, first row per key.

    The delivered share is delivered over traded quantity or, where there is no quantity, the percentage given.
    """
    named = raw.toDF(*[c.strip() for c in raw.columns])
    rows = named.where(F.trim("SERIES").isin("EQ", "BE", "BZ"))
    traded, delivered = number(F.col("TTL_TRD_QNTY")), number(F.col("DELIV_QTY"))
    typed = rows.select(
        F.trim("SYMBOL").alias("symbol"), F.to_date(F.trim("DATE"), "dd-MMM-yyyy").alias("date"), traded.alias("traded_qty"), delivered.alias("delivered_qty"),
        F.coalesce(F.try_divide(delivered, traded), number(F.col("DELIV_PER")) / 100).alias("delivered_share"), F.col("row_no"),
    )
    return keep_first(typed, ("symbol", "date"), F.col("row_no")).drop("row_no")


def keep_first(rows: DataFrame, keys: tuple[str, ...], order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def bar_profile(rows: DataFrame) -> DataFrame:
    """Per ticker: rows, rows with a missing price, rows without volume and the widest gap in days."""
    gap = F.datediff("date", F.lag("date").over(by_ticker()))
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    return rows.withColumn("gap", gap).groupBy("ticker").agg(
        F.count("*").alias("n_rows"), F.count_if(missing).alias("n_missing_price"), F.count_if(F.col("volume") == 0).alias("n_zero_volume"), F.max("gap").alias("max_gap_days")
    )


def filled(x: str, most: int = 2) -> Column:
    """The value, or the last one of up to ``most`` rows before."""
    return F.coalesce(F.col(x), F.last(x, ignorenulls=True).over(by_ticker().rowsBetween(-most, -1)))


def cleaned_bars(raw: DataFrame) -> DataFrame:
    """One row per ticker and date, prices carried over two rows at most, volume flagged and filled, derived columns."""
    rows = keep_first(raw, ("ticker", "date"), F.col("ingest"))
    rows = rows.withColumn("close", filled("close")).withColumns({"volume_missing": F.col("volume").isNull().cast("int"), "volume": F.coalesce("volume", F.lit(0.0))})
    rows = rows.dropna(subset=["close"]).withColumns({"typical_price": (F.col("high") + F.col("low") + F.col("close")) / 3, "price_range": F.col("high") - F.col("low")})
    return rows.withColumns({"range_pct": F.try_divide("price_range", "close"), "weekday": F.weekday("date"), "month": F.month("date"), "year": F.year("date")})


def finite(x: str) -> Column:
    """Null in place of infinite values and NaN."""
    return F.when(F.abs(F.col(x)) < float("inf"), F.col(x))


def warmed(rows: DataFrame, n: int = 30) -> DataFrame:
    """Without each ticker's first ``n`` rows."""
    return rows.withColumn("_n", F.row_number().over(by_ticker())).where(F.col("_n") > n).drop("_n")


def imputed(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Missing and infinite values replaced by the column's exact median, a number per column."""
    rows = staged(rows.withColumns({c: finite(c) for c in names}))
    middle = exact_quantiles(rows, names, (0.5,))
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(middle[c][0])) for c in names})


def imputed_by_date(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Missing values replaced by the date's median, and by 0 where a date has none."""
    middle = rows.groupBy("date").agg(*[F.percentile(c, 0.5).alias(f"_{c}") for c in names])
    return rows.join(middle, "date").withColumns({c: F.coalesce(c, f"_{c}", F.lit(0.0)) for c in names}).drop(*[f"_{c}" for c in names])


def standardised(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant column is only centred."""
    both = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in names], *[F.stddev_pop(c).alias(f"_s_{c}") for c in names])
    out = rows.crossJoin(F.broadcast(both))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in names}
    return out.withColumns(scaled).drop(*both.columns)


def long_form(rows: DataFrame, names: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, feature, value)``, a row per value."""
    return rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(keys), list(names), "feature", "value")


def feature_statistics(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per feature: count, mean, deviation, minimum, quartiles, maximum and missing values."""
    rows = staged(rows.select(*names))
    found = long_form(rows, names).groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_missing"), F.avg(F.col("value").isNull().cast("double")).alias("missing_share"),
    )
    shares = (0.25, 0.5, 0.75)
    held = [(name, *at) for name, at in exact_quantiles(rows, names, shares).items()]
    quartiles = rows.sparkSession.createDataFrame(held, "feature string, " + ", ".join(f"q{int(100 * q)} double" for q in shares))
    return found.join(F.broadcast(quartiles), "feature").select("feature", "n", "mean", "std", "min", "q25", "q50", "q75", "max", "n_missing", "missing_share")


def empty_features(rows: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Features without any value; callers that need all of them raise."""
    counts = rows.agg(*[F.count(c).alias(c) for c in names]).first()
    return [c for c in names if not counts[c]]


def numeric_features(rows: DataFrame, without: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns that are neither excluded by name nor by prefix; schema only."""
    from pyspark.sql.types import NumericType

    return [f.name for f in rows.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without and not f.name.startswith(prefixes or ("\0",))]
