"""Queries of unusual patterns, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import change
from tidemark.operators import panel, signals
from tidemark.plans.rounding import roll_sql
from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.sources.bars import BARS_SQL, daily_bars

PRICE = ("return_1d", "price_acceleration", "price_acceleration_abs", "rolling_vwap", "vwap_deviation", "gap_magnitude", "gap_magnitude_abs", "intraday_reversal", "upper_wick_ratio", "lower_wick_ratio", "reversal_5d_avg")
VOLUME = ("vol_price_sign_divergence", "vol_price_divergence", "vol_price_div_5d", "delivery_pct_zscore", "delivery_pct_change")
VOLUME_COUNTS = ("low_delivery_pump_flag", "volume_spike_flag", "volume_spikes_5d", "volume_spikes_20d")
CIRCUIT = ("upper_proximity", "lower_proximity", "circuit_proximity")
AUTO = ("return_autocorr_5", "return_autocorr_20")
RESIDUAL = ("beta", "alpha", "beta_adjusted_residual", "abs_residual")
MOMENTUM = (
    "momentum_5d", "momentum_10d", "momentum_20d", "momentum_60d", "chaikin_money_flow_20", "parabolic_sar", "ichimoku_conversion", "ichimoku_base", "price_to_sma5_ratio", "price_to_sma20_ratio", "price_to_sma60_ratio",
    "sma5_to_sma20_ratio", "vol_price_corr_20", "volume_momentum_5d", "delivery_pct_trend_5d", "bollinger_band_width",
)
DELIVERY = ("delivery_pct_ma20", "delivery_pct_std20", "expiry_proximity_score", "fno_expiry_amplification", "vwap_distance", "volume_delta")
_T = "(PARTITION BY ticker ORDER BY date)"
_BANDS = "SELECT * FROM VALUES ('Brand#11', 0.05D), ('Brand#22', 0.10D), ('Brand#33', 0.50D) AS t(ticker, band)"


def price_shape_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.price_shape(daily_bars(spark, sf_dir)).select("ticker", "date", *PRICE), *PRICE)


def volume_shape_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.volume_shape(daily_bars(spark, sf_dir)).select("ticker", "date", *VOLUME, *VOLUME_COUNTS), *VOLUME)


def circuit_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.circuits(daily_bars(spark, sf_dir), spark.sql(_BANDS))
    return rounded(rows.select("ticker", "date", *CIRCUIT, "near_circuit_flag", "consecutive_circuit_days"), *CIRCUIT)


def autocorrelation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.autocorrelations(daily_bars(spark, sf_dir)).select("ticker", "date", *AUTO), *AUTO)


def benchmark_residual_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is the equal-weight mean, which is missing on every thirteenth of a month."""
    rows = daily_bars(spark, sf_dir).withColumn("ret_1d", change(F.col("close"), 1))
    index = rows.groupBy("date").agg(F.avg("ret_1d").alias("index_ret")).where(F.dayofmonth("date") != 13)
    return rounded(signals.benchmark_residuals(rows, index).select("ticker", "date", *RESIDUAL), *RESIDUAL)


def momentum_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.momentum_family(daily_bars(spark, sf_dir)).select("ticker", "date", *MOMENTUM, "supertrend"), *MOMENTUM)


def volatility_regime_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("volatility_percentile_60d",)
    return rounded(signals.volatility_regimes(daily_bars(spark, sf_dir)).select("ticker", "date", *names, "volatility_spike_flag", "volatility_regime"), *names)


def delivery_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.delivery_family(daily_bars(spark, sf_dir), panel.days_to_expiry(F.col("date")))
    return rounded(rows.select("ticker", "date", *DELIVERY, "delivery_spike_flag", "is_expiry_day"), *DELIVERY)


QUERIES = {q.__name__: q for q in (price_shape_panel, volume_shape_panel, circuit_panel, autocorrelation_panel, benchmark_residual_panel, momentum_panel, volatility_regime_panel, delivery_panel)}

_R = f"WITH {BARS_SQL}, r AS (SELECT *, close / lag(close) OVER {_T} - 1 AS ret_1d, volume / lag(volume) OVER {_T} - 1 AS dv, lag(close) OVER {_T} AS c1, row_number() OVER {_T} AS k FROM bars)"
_W = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND {})"


def _corr(x: str, y: str, n: int, guard: str) -> str:
    w = _W.format(n - 1, "CURRENT ROW")
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"CASE WHEN {guard} THEN covar_samp({a}, {b}) {w} / nullif(stddev_samp({a}) {w} * stddev_samp({b}) {w}, 0) END"


def _full(n: int) -> str:
    return f"count(ret_1d) {_W.format(n - 1, 'CURRENT ROW')} = {n}"


_DAYS = "CAST(CASE WHEN this >= date THEN this - date ELSE next - date END AS DOUBLE)"
_LAST_THURSDAY = "CAST(last_day({d}) - CAST((isodow(last_day({d})) + 3) % 7 AS INT) AS DATE)"
_W60 = _W.format(60, "1 PRECEDING")
ORACLES = {
    "price_shape_panel": f"""{_R}, a AS (SELECT *, ret_1d AS return_1d, (high + low + close) / 3 * volume AS tv, open / c1 - 1 AS gap_magnitude, CASE WHEN high > low THEN CASE WHEN close >= open THEN (high - close) / (high - low) ELSE (close - low) / (high - low) END END AS intraday_reversal,
  CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) END AS upper_wick_ratio, CASE WHEN high > low THEN (least(open, close) - low) / (high - low) END AS lower_wick_ratio FROM r),
b AS (SELECT *, return_1d - lag(return_1d) OVER {_T} AS price_acceleration, {roll_sql('sum', 'tv', 20)} / {roll_sql('sum', 'volume', 20)} AS rolling_vwap, {roll_sql('avg', 'intraday_reversal', 5)} AS reversal_5d_avg FROM a),
c AS (SELECT *, abs(price_acceleration) AS price_acceleration_abs, abs(gap_magnitude) AS gap_magnitude_abs, close / rolling_vwap - 1 AS vwap_deviation FROM b) SELECT ticker, date, {round_sql(PRICE)} FROM c""",
    "volume_shape_panel": f"""{_R}, a AS (SELECT *, -sign(ret_1d) * sign(dv) AS vol_price_sign_divergence, CASE WHEN volume > 3 * {roll_sql('avg', 'volume', 20)} THEN 1 ELSE 0 END AS volume_spike_flag,
  (delivery_pct - {roll_sql('avg', 'delivery_pct', 60)}) / nullif({roll_sql('stddev_samp', 'delivery_pct', 60)}, 0) AS delivery_pct_zscore, delivery_pct / nullif(lag(delivery_pct) OVER {_T}, 0) - 1 AS delivery_pct_change,
  CASE WHEN count(delivery_pct) {_W.format(59, 'CURRENT ROW')} = 60 AND delivery_pct < quantile_cont(delivery_pct, 0.3) {_W.format(59, 'CURRENT ROW')} AND ret_1d > 0.01 THEN 1 ELSE 0 END AS low_delivery_pump_flag FROM r),
b AS (SELECT *, vol_price_sign_divergence * abs(ret_1d) * abs(dv) AS vol_price_divergence FROM a), c AS (SELECT *, {roll_sql('avg', 'vol_price_divergence', 5)} AS vol_price_div_5d, CAST({roll_sql('sum', 'volume_spike_flag', 5)} AS BIGINT) AS volume_spikes_5d, CAST({roll_sql('sum', 'volume_spike_flag', 20)} AS BIGINT) AS volume_spikes_20d FROM b)
SELECT ticker, date, {round_sql(VOLUME)}, {', '.join(VOLUME_COUNTS)} FROM c""",
    "circuit_panel": f"""{_R}, a AS (SELECT r.ticker, date, CASE WHEN c1 IS NOT NULL THEN greatest(0, least(1, (high / c1 - 1) / coalesce(band, 0.2))) END AS upper_proximity, CASE WHEN c1 IS NOT NULL THEN greatest(0, least(1, (1 - low / c1) / coalesce(band, 0.2))) END AS lower_proximity
  FROM r LEFT JOIN (VALUES ('Brand#11', 0.05e0), ('Brand#22', 0.10e0), ('Brand#33', 0.50e0)) b(ticker, band) ON r.ticker = b.ticker),
b AS (SELECT *, greatest(upper_proximity, lower_proximity) AS circuit_proximity FROM a), c AS (SELECT *, CASE WHEN circuit_proximity > 0.9 THEN 1 ELSE 0 END AS near_circuit_flag FROM b),
d AS (SELECT *, sum(1 - near_circuit_flag) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT ticker, date, {round_sql(CIRCUIT)}, near_circuit_flag, CAST(sum(near_circuit_flag) OVER (PARTITION BY ticker, run ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consecutive_circuit_days FROM d""",
    "autocorrelation_panel": f"""{_R}, a AS (SELECT *, lag(ret_1d) OVER {_T} AS p FROM r), b AS (SELECT ticker, date, {_corr('ret_1d', 'p', 4, _full(5))} AS return_autocorr_5, {_corr('ret_1d', 'p', 19, _full(20))} AS return_autocorr_20 FROM a)
SELECT ticker, date, {round_sql(AUTO)} FROM b""",
    "benchmark_residual_panel": f"""{_R}, i AS (SELECT date, avg(ret_1d) AS m FROM r WHERE day(date) <> 13 GROUP BY date), j AS (SELECT ticker, date, ret_1d, m FROM r JOIN i USING (date) WHERE ret_1d IS NOT NULL AND m IS NOT NULL),
f AS (SELECT *, CASE WHEN count(m) {_W60} = 60 THEN covar_samp(ret_1d, m) {_W60} / nullif(var_samp(m) {_W60}, 0) END AS beta, avg(ret_1d) {_W60} AS mr, avg(m) {_W60} AS mi FROM j), g AS (SELECT *, mr - beta * mi AS alpha FROM f),
h AS (SELECT ticker, date, beta, alpha, ret_1d - alpha - beta * m AS beta_adjusted_residual, abs(ret_1d - alpha - beta * m) AS abs_residual FROM g) SELECT r.ticker, r.date, {round_sql(RESIDUAL)} FROM r LEFT JOIN h ON r.ticker = h.ticker AND r.date = h.date""",
    "momentum_panel": f"""{_R}, a AS (SELECT *, {', '.join(f'close / lag(close, {n}) OVER {_T} - 1 AS momentum_{n}d' for n in (5, 10, 20, 60))}, {', '.join(f"{roll_sql('avg', 'close', n)} AS sma_{n}" for n in (5, 20, 60))}, coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume AS flow,
  {roll_sql('min', 'low', 5)} AS parabolic_sar, ({roll_sql('max', 'high', 9)} + {roll_sql('min', 'low', 9)}) / 2 AS ichimoku_conversion, ({roll_sql('max', 'high', 26)} + {roll_sql('min', 'low', 26)}) / 2 AS ichimoku_base, {roll_sql('stddev_samp', 'close', 20)} AS sd,
  volume / lag(volume, 5) OVER {_T} - 1 AS volume_momentum_5d, delivery_pct / nullif(lag(delivery_pct, 5) OVER {_T}, 0) - 1 AS delivery_pct_trend_5d, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr FROM r),
b AS (SELECT *, {', '.join(f'close / sma_{n} AS price_to_sma{n}_ratio' for n in (5, 20, 60))}, sma_5 / sma_20 AS sma5_to_sma20_ratio, {roll_sql('sum', 'flow', 20)} / {roll_sql('sum', 'volume', 20)} AS chaikin_money_flow_20, 4 * sd / sma_20 AS bollinger_band_width,
  {_corr('ret_1d', 'dv', 20, f"count(CASE WHEN dv IS NOT NULL THEN ret_1d END) {_W.format(19, 'CURRENT ROW')} = 20")} AS vol_price_corr_20, CASE WHEN close > (high + low) / 2 - 3 * {roll_sql('avg', 'tr', 14)} THEN 1 ELSE -1 END AS supertrend FROM a) SELECT ticker, date, {round_sql(MOMENTUM)}, supertrend FROM b""",
    "volatility_regime_panel": f"""{_R}, a AS (SELECT ticker, date, k, ln(close / c1) AS lr FROM r), b AS (SELECT *, {roll_sql('stddev_samp', 'lr', 20)} AS v FROM a), m AS (SELECT *, CASE WHEN count(v) {_W.format(59, 'CURRENT ROW')} = 60 THEN quantile_cont(v, 0.5) {_W.format(59, 'CURRENT ROW')} END AS mid, list(v) {_W.format(59, 'CURRENT ROW')} AS held FROM b),
p AS (SELECT *, CASE WHEN mid IS NOT NULL THEN (len(list_filter(held, lambda x: x < v)) + (len(list_filter(held, lambda x: x = v)) + 1) / 2.0) / 60 END AS volatility_percentile_60d FROM m)
SELECT ticker, date, round(1.2345678e-7 + volatility_percentile_60d, 6) + 0.0 AS volatility_percentile_60d, CASE WHEN v > 2 * mid THEN 1 ELSE 0 END AS volatility_spike_flag, CASE WHEN volatility_percentile_60d <= 0.33 THEN 0 WHEN volatility_percentile_60d <= 0.67 THEN 1 WHEN volatility_percentile_60d <= 1 THEN 2 END AS volatility_regime FROM p""",
    "delivery_panel": f"""{_R}, e AS (SELECT *, {_LAST_THURSDAY.format(d='date')} AS this, {_LAST_THURSDAY.format(d='(date + INTERVAL 1 MONTH)')} AS next, {roll_sql('avg', 'delivery_pct', 20)} AS delivery_pct_ma20, {roll_sql('stddev_samp', 'delivery_pct', 20)} AS delivery_pct_std20, (high + low + close) / 3 AS tp, volume - lag(volume) OVER {_T} AS volume_delta FROM r),
f AS (SELECT *, exp(-{_DAYS} / 5) AS expiry_proximity_score, 1 + exp(-{_DAYS} / 3) AS fno_expiry_amplification, close / tp - 1 AS vwap_distance, CASE WHEN delivery_pct > delivery_pct_ma20 + 2 * delivery_pct_std20 THEN 1 ELSE 0 END AS delivery_spike_flag, CAST({_DAYS} = 0 AS INT) AS is_expiry_day FROM e)
SELECT ticker, date, {round_sql(DELIVERY)}, delivery_spike_flag, is_expiry_day FROM f""",
}
