"""Features of unusual price, volume and trading patterns per ``(ticker, date)``; all but the benchmark's share one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_ticker, rolling


def _lag(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(by_ticker())


def _mean(x: str, n: int) -> Column:
    return rolling(F.avg, F.col(x), n)


def padded_change(x: str, n: int) -> Column:
    """Change over ``n`` rows of the last known value."""
    last = F.last(x, ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(x, ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, -n))
    return F.try_divide(last, F.when(F.row_number().over(by_ticker()) > n, before)) - 1


def safe_corr(x: Column, y: Column, n: int, guard: Column | None = None) -> Column:
    """Correlation over the last ``n`` rows with both values; null where a side is constant."""
    w = by_ticker().rowsBetween(1 - n, 0)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    full = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w) >= n if guard is None else guard
    return F.when(full, F.try_divide(F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)))


def price_shape(bars: DataFrame) -> DataFrame:
    """Acceleration, rolling volume-weighted price, gaps, wicks and reversals within the day."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    span = F.nullif(h - lo, F.lit(0.0))
    rows = bars.withColumns({"typical": (h + lo + c) / 3, "return_1d": F.try_divide(c, _lag("close")) - 1, "gap_magnitude": F.try_divide(o - _lag("close"), _lag("close"))})
    rows = rows.withColumns({
        "price_acceleration": F.col("return_1d") - _lag("return_1d"),
        "rolling_vwap": F.try_divide(rolling(F.sum, F.col("typical") * v, 20), F.nullif(rolling(F.sum, v, 20), F.lit(0.0))),
        "intraday_reversal": F.when(c >= o, F.try_divide(h - c, span)).otherwise(F.try_divide(c - lo, span)),
        "upper_wick_ratio": F.try_divide(h - F.greatest(o, c), span), "lower_wick_ratio": F.try_divide(F.least(o, c) - lo, span),
    })
    return rows.withColumns({"price_acceleration_abs": F.abs("price_acceleration"), "vwap_deviation": F.try_divide(c - F.col("rolling_vwap"), F.col("rolling_vwap")), "gap_magnitude_abs": F.abs("gap_magnitude"), "reversal_5d_avg": _mean("intraday_reversal", 5)}).drop("typical")


def volume_shape(bars: DataFrame) -> DataFrame:
    """Volume against price, thin delivery behind rises, spikes and their counts."""
    v = F.col("volume")
    rows = bars.withColumns({"r": F.try_divide("close", _lag("close")) - 1, "dv": padded_change("volume", 1), "v20": _mean("volume", 20), "d60": rolling(F.avg, F.col("delivery_pct"), 60), "s60": rolling(F.stddev_samp, F.col("delivery_pct"), 60), "low60": rolling(lambda x: F.percentile(x, F.lit(0.3)), F.col("delivery_pct"), 60)})
    rows = rows.withColumns({
        "vol_price_sign_divergence": -F.signum("r") * F.signum("dv"), "volume_spike_flag": F.when(v > 3 * F.col("v20"), 1).otherwise(0),
        "delivery_pct_zscore": F.try_divide(F.col("delivery_pct") - F.col("d60"), F.col("s60")),
        "low_delivery_pump_flag": F.when((F.col("delivery_pct") < F.col("low60")) & (F.col("r") > 0.01), 1).otherwise(0), "delivery_pct_change": padded_change("delivery_pct", 1),
    })
    rows = rows.withColumn("vol_price_divergence", F.col("vol_price_sign_divergence") * F.abs("r") * F.abs("dv"))
    return rows.withColumns({"vol_price_div_5d": _mean("vol_price_divergence", 5), "volume_spikes_5d": rolling(F.sum, F.col("volume_spike_flag"), 5), "volume_spikes_20d": rolling(F.sum, F.col("volume_spike_flag"), 20)}).drop("r", "dv", "v20", "d60", "s60", "low60")


def circuits(bars: DataFrame, bands: DataFrame, default: float = 0.20) -> DataFrame:
    """Nearness to the ticker's price band ``bands(ticker, band)``, a flag above 0.9, and how many days in a row it holds."""
    band = F.coalesce("band", F.lit(default))
    rows = bars.join(bands, "ticker", "left").withColumns({"up": F.try_divide("high", _lag("close")) - 1, "down": 1 - F.try_divide("low", _lag("close"))})
    clip = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    rows = rows.withColumns({"upper_proximity": clip(F.col("up") / band), "lower_proximity": clip(F.col("down") / band)})
    rows = rows.withColumn("circuit_proximity", F.greatest("upper_proximity", "lower_proximity"))
    rows = rows.withColumn("near_circuit_flag", F.when(F.col("circuit_proximity") > 0.9, 1).otherwise(0))
    rows = rows.withColumn("run", F.sum(1 - F.col("near_circuit_flag")).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("ticker", "run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("consecutive_circuit_days", F.sum("near_circuit_flag").over(inside)).drop("up", "down", "band", "run")


def autocorrelations(bars: DataFrame, windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Correlation of returns with the return before, within the last rows."""
    rows = bars.withColumn("r", F.try_divide("close", _lag("close")) - 1).withColumn("before", _lag("r"))
    r, p = F.col("r"), F.col("before")
    found = {f"return_autocorr_{n}": safe_corr(r, p, n - 1, F.count(r).over(by_ticker().rowsBetween(1 - n, 0)) == n) for n in windows}
    return rows.withColumns(found).drop("r", "before")


def benchmark_residuals(rows: DataFrame, index: DataFrame, window: int = 60) -> DataFrame:
    """``beta, alpha, beta_adjusted_residual, abs_residual`` of ``ret_1d`` against ``index([ticker,] date, index_ret)``.

    The line is fitted on the ``window`` joined rows before the current one. Rows without an index return keep nulls.
    """
    joined = rows.join(index, [c for c in ("ticker", "date") if c in index.columns]).where(F.col("ret_1d").isNotNull() & F.col("index_ret").isNotNull())
    w = by_ticker().rowsBetween(-window, -1)
    full = F.count("index_ret").over(w) == window
    fit = joined.select("ticker", "date", "ret_1d", "index_ret", F.when(full, F.try_divide(F.covar_samp("ret_1d", "index_ret").over(w), F.var_samp("index_ret").over(w))).alias("beta"), F.avg("ret_1d").over(w).alias("mr"), F.avg("index_ret").over(w).alias("mi"))
    fit = fit.withColumn("alpha", F.col("mr") - F.col("beta") * F.col("mi"))
    fit = fit.withColumn("beta_adjusted_residual", F.col("ret_1d") - F.col("alpha") - F.col("beta") * F.col("index_ret"))
    fit = fit.select("ticker", "date", "beta", "alpha", "beta_adjusted_residual", F.abs("beta_adjusted_residual").alias("abs_residual"))
    return rows.join(fit, ["ticker", "date"], "left")


def chosen_benchmark(rows: DataFrame, first: DataFrame, second: DataFrame, sector: str) -> DataFrame:
    """``(ticker, date, index_ret)``: returns of the index ``first`` if it has any row, else those of ``second`` for the tickers of
    one sector, and none for the others."""
    there = first.limit(1).count() > 0
    if there:
        return rows.select("ticker", "date").join(first, "date")
    return rows.where(F.col("sector") == sector).select("ticker", "date").join(second, "date")


def momentum_family(bars: DataFrame) -> DataFrame:
    """Momenta, money flow, bands of highs and lows, ratios to averages, and volume's correlation with price."""
    h, lo, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    middle = lambda n: (rolling(F.max, h, n) + rolling(F.min, lo, n)) / 2
    rows = bars.withColumns({
        **{f"momentum_{n}d": F.try_divide(c, _lag("close", n)) - 1 for n in (5, 10, 20, 60)}, **{f"sma_{n}": _mean("close", n) for n in (5, 20, 60)},
        "flow": F.try_divide((c - lo) - (h - c), F.nullif(h - lo, F.lit(0.0))) * v, "r": F.try_divide(c, _lag("close")) - 1, "dv": padded_change("volume", 1),
        "parabolic_sar": rolling(F.min, lo, 5), "ichimoku_conversion": middle(9), "ichimoku_base": middle(26), "sd_20": rolling(F.stddev_samp, c, 20),
        "true_range": F.greatest(h - lo, F.abs(h - _lag("close")), F.abs(lo - _lag("close"))),
    })
    rows = rows.withColumns({
        **{f"price_to_sma{n}_ratio": F.try_divide(c, F.col(f"sma_{n}")) for n in (5, 20, 60)}, "sma5_to_sma20_ratio": F.try_divide("sma_5", "sma_20"),
        "chaikin_money_flow_20": F.try_divide(rolling(F.sum, F.coalesce("flow", F.lit(0.0)), 20), F.nullif(rolling(F.sum, v, 20), F.lit(0.0))),
        "vol_price_corr_20": safe_corr(F.col("r"), F.col("dv"), 20), "volume_momentum_5d": padded_change("volume", 5), "delivery_pct_trend_5d": padded_change("delivery_pct", 5),
        "atr_14_mean": _mean("true_range", 14), "bollinger_band_width": F.try_divide(4 * F.col("sd_20"), F.col("sma_20")),
    })
    rows = rows.withColumn("supertrend", F.when(c > (h + lo) / 2 - 3 * F.col("atr_14_mean"), 1).otherwise(-1))
    return rows.drop("flow", "r", "dv", "sma_5", "sma_20", "sma_60", "sd_20", "true_range")


def volatility_regimes(bars: DataFrame, n: int = 60) -> DataFrame:
    """Rank of the 20-row volatility among its last ``n`` values, spikes over twice the median, and three regimes."""
    rows = bars.withColumn("log_ret", F.log(F.try_divide("close", _lag("close")))).withColumn("vol_20", rolling(F.stddev_samp, F.col("log_ret"), 20))
    w, v = by_ticker().rowsBetween(1 - n, 0), F.col("vol_20")
    rows = rows.withColumns({"held": F.collect_list("vol_20").over(w), "middle": rolling(lambda x: F.percentile(x, F.lit(0.5)), v, n)})
    place = F.expr("(size(filter(held, x -> x < vol_20)) + (size(filter(held, x -> x = vol_20)) + 1) / 2) / size(held)")
    rows = rows.withColumn("volatility_percentile_60d", F.when(F.size("held") == n, place))
    p = F.col("volatility_percentile_60d")
    regime = F.when(p <= 0.33, 0).when(p <= 0.67, 1).when(p <= 1, 2)
    return rows.withColumns({"volatility_spike_flag": F.when(v > 2 * F.col("middle"), 1).otherwise(0), "volatility_regime": regime}).drop("log_ret", "held", "middle")


def delivery_family(bars: DataFrame, days_to_expiry: Column) -> DataFrame:
    """Delivery against its average, the pull of a near expiry, distance to the day's mean price and signed volume."""
    d, c = F.col("delivery_pct"), F.col("close")
    rows = bars.withColumns({"delivery_pct_ma20": _mean("delivery_pct", 20), "delivery_pct_std20": rolling(F.stddev_samp, d, 20), "typical": (F.col("high") + F.col("low") + c) / 3})
    return rows.withColumns({
        "delivery_spike_flag": F.when(d > F.col("delivery_pct_ma20") + 2 * F.col("delivery_pct_std20"), 1).otherwise(0), "expiry_proximity_score": F.exp(-days_to_expiry / 5), "is_expiry_day": (days_to_expiry == 0).cast("int"),
        "fno_expiry_amplification": F.coalesce(1 + F.exp(-days_to_expiry / 3), F.lit(1.0)), "vwap_distance": F.try_divide(c - F.col("typical"), F.col("typical")), "volume_delta": F.col("volume") - _lag("volume"),
    }).drop("typical")
