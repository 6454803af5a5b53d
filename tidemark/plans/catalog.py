"""All registered panel queries with the SQL that checks them; doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import EPS, change
from tidemark.operators import panel, trend
from tidemark.operators.labels import last_rows
from tidemark.plans import books, cleaning, context, detectors, events, filters, labels, live, models, neighbours, outcomes, reasons, signals, validation
from tidemark.plans import trend as trend_sql
from tidemark.plans.rounding import roll_sql as _roll
from tidemark.plans.rounding import round_sql as _round
from tidemark.plans.rounding import rounded
from tidemark.sources.bars import BARS_SQL, daily_bars
from tidemark.streaming.bars import event_bars

# The names of the features.
FEATURES = (
    "ret_1d", "ret_2d", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "ret_60d", "log_ret_1d", "momentum_12_1", "reversal_1d", "reversal_5d", "vol_5d", "vol_20d", "vol_60d", "vol_ratio_5_20", "vol_ratio_20_60",
    "parkinson_vol_20", "px_to_sma_5", "px_to_sma_20", "px_to_sma_50", "px_to_sma_200", "sma_5_20_cross", "bollinger_z", "pct_from_52w_high", "pct_from_52w_low", "range_position_52w", "volume_ratio_20",
    "volume_zscore_20", "volume_trend_5_20", "amihud_illiq",
)
KEYS = ("ticker", "date")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir).withColumns({"ret_1d": change(F.col("close"), 1), "ret_5d": change(F.col("close"), 5), "fwd_3d": panel.forward_return(3)})


def daily_bar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(daily_bars(spark, sf_dir), "open", "high", "low", "close", "volume", "turnover", "delivery_pct", digits=8)


def price_feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.price_features(daily_bars(spark, sf_dir)).select(*KEYS, *FEATURES), *FEATURES)


XS = ("xs_rank", "xs_z", "market_ret", "sector_ret", "market_breadth", "excess_ret", "vs_sector_ret", "sector_rank")


def cross_section_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.cross_section(returns(spark, sf_dir)).select(*KEYS, *XS), *XS)


def top_ranked_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best five-day returns of the latest date; ten is the report's size.

    A ticker's last six bars are all that is needed, so windows and ranks see no more of them.
    """
    recent = last_rows(daily_bars(spark, sf_dir), 6).withColumn("ret_5d", change(F.col("close"), 5))
    latest = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.to_date(F.max("l_shipdate")).alias("date"))
    ranked = panel.cross_section(recent.join(F.broadcast(latest), "date"))  # a single row
    return rounded(ranked.select(*KEYS, "ret_5d", "xs_rank").orderBy(F.desc_nulls_last("ret_5d"), "ticker").limit(10), "ret_5d", "xs_rank")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_bars(spark, sf_dir).groupBy("ticker").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_rows"), F.avg(F.col("delivery_pct").isNotNull().cast("double")).alias("pct_delivery_available"), F.avg((F.col("volume") == 0).cast("double")).alias("pct_zero_volume"), F.avg("delivery_pct").alias("mean_delivery_pct"))
    return rounded(d, "pct_delivery_available", "pct_zero_volume", "mean_delivery_pct")


def forward_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns(spark, sf_dir).select(*KEYS, "fwd_3d", panel.return_class(F.col("fwd_3d")).alias("target")), "fwd_3d")


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).groupBy(panel.return_class(F.col("fwd_3d")).alias("target")).agg(F.count("*").alias("n"))


def expiry_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("date")
    return daily_bars(spark, sf_dir).select(*KEYS, F.weekday(d).alias("day_of_week"), F.dayofmonth(d).alias("day_of_month"), F.month(d).alias("month"), panel.days_to_expiry(d).alias("days_to_expiry")).withColumn("is_expiry_week", (F.col("days_to_expiry") <= 5).cast("int"))


def up_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.runs(returns(spark, sf_dir), F.col("ret_1d") > 0).select(*KEYS, "run_length")


def labelled_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = spark.sql("SELECT * FROM VALUES ('Brand#11', DATE'1996-01-01', DATE'1996-03-31', 'first'), ('Brand#23', DATE'1998-05-01', DATE'1998-12-31', 'second') AS t(ticker, start, stop, description)")
    return rounded(panel.within_periods(daily_bars(spark, sf_dir), periods).select(*KEYS, "description", "close"), "close")


def winsorised_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.winsorised(returns(spark, sf_dir), "ret_1d").select(*KEYS, "ret_1d_w"), "ret_1d_w")


def daily_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.rank_ic(returns(spark, sf_dir), "ret_5d", "fwd_3d"), "ic")


BUCKET = ("win_rate", "mean_ret", "median_ret", "beat_market", "mean_excess", "worst", "best")


def score_bucket_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.score_buckets(panel.cross_section(returns(spark, sf_dir)), "fwd_3d"), *BUCKET)


def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.cross_section(returns(spark, sf_dir))
    top, low = F.avg(F.when(F.col("xs_rank") >= 0.9, F.col("fwd_3d"))), F.avg(F.when(F.col("xs_rank") <= 0.1, F.col("fwd_3d")))
    return rounded(rows.groupBy("date").agg((top - low).alias("long_short")), "long_short")


def daily_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value"))
    return rounded(bars.withColumn("start", F.to_date("start")), "open", "high", "low", "close")


def oscillator_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.oscillators(daily_bars(spark, sf_dir)), *trend.OSCILLATORS)


def microstructure_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap over the day's range is shown for days that have a range."""
    rows = trend.microstructure(daily_bars(spark, sf_dir)).withColumn("gap_vs_range", F.when(F.col("high") > F.col("low"), F.col("gap_vs_range")))
    return rounded(rows.select(*KEYS, *trend_sql.MICRO), *trend_sql.MICRO)


def beta_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.market_beta(returns(spark, sf_dir)).select(*KEYS, *trend_sql.BETA), *trend_sql.BETA)


def tail_label_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.tail_labels(returns(spark, sf_dir), "fwd_3d").select(*KEYS, "label")


def rank_ic_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.newey_west(daily_rank_ic(spark, sf_dir), "ic"), "mean", "t")


def top_decile_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.period_book(panel.cross_section(returns(spark, sf_dir)), "fwd_3d").select("date", *trend_sql.BOOK), *trend_sql.BOOK)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (top_ranked_latest, daily_bar_table, price_feature_panel, cross_section_panel, quality_report, forward_classes, class_histogram, expiry_calendar, up_runs, labelled_periods, winsorised_returns, daily_rank_ic, score_bucket_table, long_short, daily_event_bars, oscillator_panel, microstructure_panel, beta_panel, tail_label_panel, rank_ic_significance, top_decile_book)}

_T = "(PARTITION BY ticker ORDER BY date)"
_RETURNS = f"""WITH {BARS_SQL}, r AS (SELECT *, close / lag(close, 1) OVER t - 1 AS ret_1d, close / lag(close, 5) OVER t - 1 AS ret_5d,
  lead(close, 3) OVER t / close - 1 AS fwd_3d FROM bars WINDOW t AS {_T})"""


def _prank(x: str, keys: str, rows: str = "") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {keys}) END"


_XS = f"""{_RETURNS}, x AS (SELECT *, {_prank('ret_5d', 'date')} AS xs_rank, (ret_5d - avg(ret_5d) OVER d) / (stddev_samp(ret_5d) OVER d + {EPS}) AS xs_z,
  avg(ret_5d) OVER d AS market_ret, avg(ret_5d) OVER g AS sector_ret, avg(CASE WHEN ret_5d > 0 THEN 1 ELSE 0 END) OVER d AS market_breadth,
  {_prank('ret_5d', 'date, sector')} AS sector_rank, ret_5d - avg(ret_5d) OVER d AS excess_ret, ret_5d - avg(ret_5d) OVER g AS vs_sector_ret
  FROM r WINDOW d AS (PARTITION BY date), g AS (PARTITION BY date, sector)), s AS (SELECT *, CASE WHEN xs_rank IS NOT NULL THEN CAST(greatest(1, least(10, ceil(xs_rank * 10))) AS INT) END AS score FROM x)"""
_CLASS = "CASE WHEN fwd_3d > 0.03 THEN 4 WHEN fwd_3d > 0.01 THEN 3 WHEN fwd_3d >= -0.01 THEN 2 WHEN fwd_3d >= -0.03 THEN 1 WHEN fwd_3d < -0.03 THEN 0 END"
_LAGS = ", ".join(f"close / lag(close, {n}) OVER {_T} - 1 AS ret_{n}d" for n in (1, 2, 3, 5, 10, 20, 60))
_SMAS = ", ".join(f"{_roll('avg', 'close', n)} AS sma_{n}" for n in (5, 20, 50, 200))
_FEATURES = f"""WITH {BARS_SQL}, a AS (SELECT *, {_LAGS}, ln(close / lag(close) OVER {_T}) AS log_ret_1d, lag(close, 21) OVER {_T} / (lag(close, 252) OVER {_T} + {EPS}) - 1 AS momentum_12_1, {_SMAS},
  {_roll('stddev_samp', 'close', 20)} AS sd_20, {_roll('max', 'high', 252, 60)} AS hi, {_roll('min', 'low', 252, 60)} AS lo, {_roll('avg', 'volume', 5)} AS v5, {_roll('avg', 'volume', 20)} AS v20, {_roll('stddev_samp', 'volume', 20)} AS vs,
  power(ln((high + {EPS}) / (low + {EPS})), 2) AS range2 FROM bars),
b AS (SELECT *, abs(ret_1d) / (close * volume + {EPS}) AS ill, {', '.join(f"{_roll('stddev_samp', 'log_ret_1d', n)} AS vol_{n}d" for n in (5, 20, 60))}, sqrt({_roll('avg', 'range2', 20)} / (4 * ln(2.0))) AS parkinson_vol_20 FROM a),
c AS (SELECT *, {_roll('avg', 'ill', 20)} * 1e9 AS amihud_illiq, volume / (v20 + {EPS}) AS volume_ratio_20, -ret_1d AS reversal_1d, -ret_5d AS reversal_5d, vol_5d / (vol_20d + {EPS}) AS vol_ratio_5_20, vol_20d / (vol_60d + {EPS}) AS vol_ratio_20_60,
  {', '.join(f'close / (sma_{n} + {EPS}) - 1 AS px_to_sma_{n}' for n in (5, 20, 50, 200))}, sma_5 / (sma_20 + {EPS}) - 1 AS sma_5_20_cross, (close - sma_20) / (sd_20 + {EPS}) AS bollinger_z, close / (hi + {EPS}) - 1 AS pct_from_52w_high,
  close / (lo + {EPS}) - 1 AS pct_from_52w_low, (close - lo) / (hi - lo + {EPS}) AS range_position_52w, (volume - v20) / (vs + {EPS}) AS volume_zscore_20, v5 / (v20 + {EPS}) - 1 AS volume_trend_5_20 FROM b)
SELECT ticker, date, {_round(FEATURES)} FROM c"""
_LAST_THURSDAY = "CAST(last_day({d}) - CAST((isodow(last_day({d})) + 3) % 7 AS INT) AS DATE)"

ORACLES: dict[str, str] = {
    "daily_bar_table": f"WITH {BARS_SQL} SELECT ticker, sector, date, n_trades, {_round(('open', 'high', 'low', 'close', 'volume', 'turnover', 'delivery_pct'), 8)} FROM bars",
    "price_feature_panel": _FEATURES,
    "cross_section_panel": f"{_XS} SELECT ticker, date, {_round(XS)} FROM s",
    "top_ranked_latest": f"{_XS} SELECT ticker, date, {_round(('ret_5d', 'xs_rank'))} FROM s WHERE date = (SELECT max(date) FROM s) ORDER BY s.ret_5d DESC NULLS LAST, ticker LIMIT 10",
    "quality_report": f"WITH {BARS_SQL} SELECT ticker, min(date) AS start_date, max(date) AS end_date, count(*) AS n_rows, avg(CAST(delivery_pct IS NOT NULL AS INT)) AS pct_delivery_available, round(avg(CAST(volume = 0 AS INT)), 6) AS pct_zero_volume, round(avg(delivery_pct), 6) AS mean_delivery_pct FROM bars GROUP BY ticker",
    "forward_classes": f"{_RETURNS} SELECT ticker, date, round(fwd_3d, 6) + 0.0 AS fwd_3d, {_CLASS} AS target FROM r",
    "class_histogram": f"{_RETURNS} SELECT {_CLASS} AS target, count(*) AS n FROM r GROUP BY 1",
    "expiry_calendar": f"""WITH {BARS_SQL}, e AS (SELECT *, {_LAST_THURSDAY.format(d='date')} AS this, {_LAST_THURSDAY.format(d='(date + INTERVAL 1 MONTH)')} AS next FROM bars),
f AS (SELECT *, CAST(CASE WHEN this >= date THEN this - date ELSE next - date END AS INT) AS days_to_expiry FROM e)
SELECT ticker, date, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(day(date) AS INT) AS day_of_month, CAST(month(date) AS INT) AS month, days_to_expiry, CAST(days_to_expiry <= 5 AS INT) AS is_expiry_week FROM f""",
    "up_runs": f"{_RETURNS}, i AS (SELECT *, coalesce(ret_1d > 0, false) AS up, sum(CASE WHEN coalesce(ret_1d > 0, false) THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT ticker, date, CAST(sum(CAST(up AS INT)) OVER (PARTITION BY ticker, island ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_length FROM i",
    "labelled_periods": f"WITH {BARS_SQL} SELECT bars.ticker, date, description, round(close, 6) + 0.0 AS close FROM bars JOIN (VALUES ('Brand#11', DATE '1996-01-01', DATE '1996-03-31', 'first'), ('Brand#23', DATE '1998-05-01', DATE '1998-12-31', 'second')) p(ticker, start, stop, description) ON bars.ticker = p.ticker AND date BETWEEN start AND stop",
    "winsorised_returns": f"{_RETURNS}, q AS (SELECT date, quantile_cont(ret_1d, 0.01) AS lo, quantile_cont(ret_1d, 0.99) AS hi FROM r GROUP BY date) SELECT ticker, date, round(CASE WHEN ret_1d IS NOT NULL THEN greatest(lo, least(hi, ret_1d)) END, 6) + 0.0 AS ret_1d_w FROM r JOIN q USING (date)",
    "daily_rank_ic": f"{_RETURNS}, b AS (SELECT * FROM r WHERE ret_5d IS NOT NULL AND fwd_3d IS NOT NULL), k AS (SELECT date, {_prank('ret_5d', 'date')} AS rx, {_prank('fwd_3d', 'date')} AS ry FROM b) SELECT date, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS ic FROM k GROUP BY date HAVING count(*) >= 10",
    "score_bucket_table": f"{_XS}, y AS (SELECT *, fwd_3d - avg(fwd_3d) OVER (PARTITION BY date) AS excess FROM s WHERE fwd_3d IS NOT NULL AND score IS NOT NULL) SELECT score, count(*) AS n, round(avg(CAST(fwd_3d > 0 AS INT)), 6) AS win_rate, round(avg(fwd_3d), 6) AS mean_ret, round(median(fwd_3d), 6) AS median_ret, round(avg(CAST(excess > 0 AS INT)), 6) AS beat_market, round(avg(excess), 6) AS mean_excess, round(min(fwd_3d), 6) AS worst, round(max(fwd_3d), 6) AS best FROM y GROUP BY score",
    "long_short": f"{_XS} SELECT date, round(avg(CASE WHEN xs_rank >= 0.9 THEN fwd_3d END) - avg(CASE WHEN xs_rank <= 0.1 THEN fwd_3d END), 6) + 0.0 AS long_short FROM s GROUP BY date",
    "daily_event_bars": "SELECT event_type, CAST(ts AS DATE) AS start, round(first(value ORDER BY ts, event_id), 6) + 0.0 AS open, round(max(value), 6) + 0.0 AS high, round(min(value), 6) + 0.0 AS low, round(last(value ORDER BY ts, event_id), 6) + 0.0 AS close, count(*) AS n FROM events GROUP BY ALL",
}
ORACLES |= {
    "oscillator_panel": trend_sql.OSCILLATOR_SQL,
    "microstructure_panel": trend_sql.MICRO_SQL,
    "beta_panel": trend_sql.beta_sql(_RETURNS),
    "tail_label_panel": trend_sql.tails_sql(_RETURNS),
    "rank_ic_significance": trend_sql.newey_west_sql(ORACLES["daily_rank_ic"]),
    "top_decile_book": trend_sql.book_sql(_XS),
}
for family in (cleaning, signals, validation, books, labels, live, models, neighbours, events, detectors, context, outcomes):
    QUERIES |= family.QUERIES
    ORACLES |= family.ORACLES
for family in (reasons, filters):
    QUERIES |= family.QUERIES
    ORACLES |= family.oracles(ORACLES)
