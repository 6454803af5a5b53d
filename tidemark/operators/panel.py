"""Operators over ``(ticker, date)`` panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import EPS, by_ticker, change, percent_rank, rolling


def price_features(bars: DataFrame) -> DataFrame:
    """Returns, volatilities, averages and volume features per ticker; all windows share one shuffle and sort."""
    c, v = F.col("close"), F.col("volume")
    base = bars.withColumns({**{f"ret_{n}d": change(c, n) for n in (1, 2, 3, 5, 10, 20, 60)}, "log_ret_1d": F.log(c / F.lag(c).over(by_ticker())), "momentum_12_1": F.lag(c, 21).over(by_ticker()) / (F.lag(c, 252).over(by_ticker()) + EPS) - 1, **{f"sma_{n}": rolling(F.avg, c, n) for n in (5, 20, 50, 200)}, "sd_20": rolling(F.stddev_samp, c, 20), "high_252": rolling(F.max, F.col("high"), 252, 60), "low_252": rolling(F.min, F.col("low"), 252, 60), "vma_5": rolling(F.avg, v, 5), "vma_20": rolling(F.avg, v, 20), "vsd_20": rolling(F.stddev_samp, v, 20), "range2": F.pow(F.log((F.col("high") + EPS) / (F.col("low") + EPS)), 2)})
    full = base.withColumns({**{f"vol_{n}d": rolling(F.stddev_samp, F.col("log_ret_1d"), n) for n in (5, 20, 60)}, "parkinson_vol_20": F.sqrt(rolling(F.avg, F.col("range2"), 20) / (4 * F.log(F.lit(2.0)))), "volume_ratio_20": v / (F.col("vma_20") + EPS), "amihud_illiq": rolling(F.avg, F.abs(F.col("ret_1d")) / (c * v + EPS), 20) * 1e9})
    return full.withColumns({"reversal_1d": -F.col("ret_1d"), "reversal_5d": -F.col("ret_5d"), "vol_ratio_5_20": F.col("vol_5d") / (F.col("vol_20d") + EPS), "vol_ratio_20_60": F.col("vol_20d") / (F.col("vol_60d") + EPS), **{f"px_to_sma_{n}": c / (F.col(f"sma_{n}") + EPS) - 1 for n in (5, 20, 50, 200)}, "sma_5_20_cross": F.col("sma_5") / (F.col("sma_20") + EPS) - 1, "bollinger_z": (c - F.col("sma_20")) / (F.col("sd_20") + EPS), "pct_from_52w_high": c / (F.col("high_252") + EPS) - 1, "pct_from_52w_low": c / (F.col("low_252") + EPS) - 1, "range_position_52w": (c - F.col("low_252")) / (F.col("high_252") - F.col("low_252") + EPS), "volume_zscore_20": (v - F.col("vma_20")) / (F.col("vsd_20") + EPS), "volume_trend_5_20": F.col("vma_5") / (F.col("vma_20") + EPS) - 1}).drop("high_252", "low_252", "vma_5", "vma_20", "vsd_20", "range2", "sd_20")


def cross_section(rows: DataFrame, x: str = "ret_5d") -> DataFrame:
    """Per date: percent rank, z-score, market and sector means, excess returns, breadth and the 1-10 score."""
    day, group, v = Window.partitionBy("date"), Window.partitionBy("date", "sector"), F.col(x)
    out = rows.withColumns({"xs_rank": percent_rank(v, "date"), "xs_z": (v - F.avg(v).over(day)) / (F.stddev_samp(v).over(day) + EPS), "market_ret": F.avg(v).over(day), "sector_ret": F.avg(v).over(group), "market_breadth": F.avg(F.when(v > 0, 1.0).otherwise(0.0)).over(day)})
    out = out.withColumns({"excess_ret": v - F.col("market_ret"), "vs_sector_ret": v - F.col("sector_ret"), "sector_rank": percent_rank(v, "date", "sector")})
    return out.withColumn("score", F.when(F.col("xs_rank").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.col("xs_rank") * 10)))).cast("int"))


def forward_return(h: int) -> Column:
    return F.lead("close", h).over(by_ticker()) / F.col("close") - 1


def return_class(r: Column) -> Column:
    """4: over 3 %; 3: over 1 %; 2: within 1 % either way; 1: down to -3 %; 0: below."""
    return F.when(r > 0.03, 4).when(r > 0.01, 3).when(r >= -0.01, 2).when(r >= -0.03, 1).when(r < -0.03, 0)


def monthly_expiry(day: Column) -> Column:
    """The last Thursday of a date's month; from September 2025 the last Tuesday."""
    last = F.last_day(day)
    return F.when(last < F.lit("2025-09-01").cast("date"), F.date_sub(F.next_day(last, "THU"), 7)).otherwise(F.date_sub(F.next_day(last, "TUE"), 7))


def days_to_expiry(day: Column) -> Column:
    """To the first expiry at or after the date: this month's or the next one's, so no as-of join is needed."""
    this, following = monthly_expiry(day), monthly_expiry(F.add_months(day, 1))
    return F.datediff(F.when(this >= day, this).otherwise(following), day)


def runs(rows: DataFrame, flag: Column) -> DataFrame:
    """``run_length``: how many rows in a row, up to this one, the flag has held."""
    rows = rows.withColumn("flag", F.coalesce(flag, F.lit(False)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("flag"), 0).otherwise(1)).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("ticker", "island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run_length", F.sum(F.col("flag").cast("int")).over(inside)).drop("flag", "island")


def within_periods(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows whose date lies in a period ``(ticker, start, stop, description)`` of their ticker, ends included."""
    return rows.join(periods, "ticker").where(F.col("date").between(F.col("start"), F.col("stop")))


def winsorised(rows: DataFrame, x: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``x`` clipped to its quantiles on each date."""
    bounds = rows.groupBy("date").agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("q"))
    return rows.join(bounds, "date").withColumn(f"{x}_w", F.when(F.col(x).isNotNull(), F.greatest(F.get("q", F.lit(0)), F.least(F.get("q", F.lit(1)), F.col(x))))).drop("q")


def winsorised_all(rows: DataFrame, names: tuple[str, ...], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """All of ``names`` clipped to their quantiles on each date: one aggregate and one join for all of them."""
    at = F.array(F.lit(low), F.lit(high))
    bounds = rows.groupBy("date").agg(*[F.percentile(x, at).alias(f"_q_{x}") for x in names])
    clipped = {x: F.when(F.col(x).isNotNull(), F.greatest(F.get(f"_q_{x}", F.lit(0)), F.least(F.get(f"_q_{x}", F.lit(1)), F.col(x)))) for x in names}
    return rows.join(bounds, "date").withColumns(clipped).drop(*[f"_q_{x}" for x in names])


def rank_ic(rows: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """Spearman correlation of ``x`` and ``y`` on each date with at least so many pairs; null where one of them is the same
    throughout. Doubled, centred ranks are whole numbers, so that products which add up to nothing give exactly 0."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select("date", percent_rank(F.col(x), "date").alias("rx"), percent_rank(F.col(y), "date").alias("ry"), F.count("*").over(Window.partitionBy("date")).alias("m"))
    whole = lambda r: F.round(2 * F.col(r) * F.col("m") - F.col("m") - 1)
    wx, wy = whole("rx"), whole("ry")
    found = ranked.groupBy("date").agg(F.count("*").alias("n"), F.sum(wx * wy).alias("xy"), F.sum(wx * wx).alias("xx"), F.sum(wy * wy).alias("yy"))
    return found.where(F.col("n") >= least).select("date", "n", F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("ic"))


def score_buckets(rows: DataFrame, y: str) -> DataFrame:
    """Outcome by score: size, win rate, mean, median, worst, best and the rate of beating the date's mean."""
    rows = rows.where(F.col(y).isNotNull() & F.col("score").isNotNull()).withColumn("excess", F.col(y) - F.avg(y).over(Window.partitionBy("date")))
    return rows.groupBy("score").agg(F.count("*").alias("n"), F.avg((F.col(y) > 0).cast("double")).alias("win_rate"), F.avg(y).alias("mean_ret"), F.percentile(y, 0.5).alias("median_ret"), F.avg((F.col("excess") > 0).cast("double")).alias("beat_market"), F.avg("excess").alias("mean_excess"), F.min(y).alias("worst"), F.max(y).alias("best"))
