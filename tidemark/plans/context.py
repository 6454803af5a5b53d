"""Queries of trend strength, benchmarks, clipped features, event gaps and tilts, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import change
from tidemark.operators import panel, signals, trend, validation
from tidemark.plans import books as book_plans
from tidemark.plans import signals as signal_plans
from tidemark.plans import validation as validation_plans
from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.sources.bars import BARS_SQL, daily_bars

STRENGTH = ("di_plus", "di_minus", "adx", "trend_strength_score")
CHOICE = ("beta", "alpha", "beta_adjusted_residual", "abs_residual", "beta_adjusted_return")
CLIPPED = ("ret_1d", "ret_5d", "ret_20d", "volume", "delivery_pct", "turnover")
GAPS = ("mean_gap", "median_gap", "std_gap", "cov")
SECTOR = "Brand#1"


def trend_strength_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.directional_strength(daily_bars(spark, sf_dir)), *STRENGTH)


def benchmark_choice_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals against the index of all tickers, and, as if that were missing, against a sector's own for its tickers."""
    rows = daily_bars(spark, sf_dir).withColumns({"ret_1d": change(F.col("close"), 1), "ret_5d": change(F.col("close"), 5)})
    every = rows.groupBy("date").agg(F.avg("ret_1d").alias("index_ret"), F.avg("ret_5d").alias("index_5d"))
    own = rows.where(F.col("sector") == SECTOR).groupBy("date").agg(F.avg("ret_1d").alias("index_ret"), F.avg("ret_5d").alias("index_5d"))
    out = None
    for case, first in (("first", every), ("second", every.limit(0))):
        index = signals.chosen_benchmark(rows, first, own, SECTOR)
        found = signals.benchmark_residuals(rows, index.drop("index_5d")).join(index.select("ticker", "date", "index_5d"), ["ticker", "date"], "left")
        found = found.withColumn("beta_adjusted_return", F.col("ret_5d") - F.col("beta") * F.col("index_5d")).select(F.lit(case).alias("benchmark"), "ticker", "date", *CHOICE)
        out = found if out is None else out.unionByName(found)
    return rounded(out, *CHOICE)


def winsorised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_bars(spark, sf_dir).withColumns({f"ret_{n}d": change(F.col("close"), n) for n in (1, 5, 20)})
    return rounded(panel.winsorised_all(rows, CLIPPED).select("ticker", "date", *CLIPPED), *CLIPPED)


def event_gap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.event_gap_means(validation_plans.flagged(spark, sf_dir), validation_plans.FLAGS), *GAPS)


def beta_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more the best-ranked names move with the market than the worst."""
    return rounded(validation.tilt(book_plans.ranked(spark, sf_dir), "xs_rank", "beta"), "top", "low", "tilt")


def sector_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tickers a sector has, and how many sectors have as many."""
    sizes = daily_bars(spark, sf_dir).groupBy("sector").agg(F.count_distinct("ticker").alias("n_tickers"))
    return sizes.groupBy("n_tickers").agg(F.count("*").alias("n_sectors"))


QUERIES = {q.__name__: q for q in (trend_strength_panel, benchmark_choice_panel, winsorised_features, event_gap_means, beta_tilt, sector_sizes)}

_T = "(PARTITION BY ticker ORDER BY date)"
_A = "2e0 / 15"
_W60 = "OVER (PARTITION BY c, ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
ORACLES = {
    "trend_strength_panel": f"""WITH RECURSIVE {BARS_SQL}, s AS MATERIALIZED (SELECT ticker, date, close, (high + low) / 2 AS middle, row_number() OVER t AS k, coalesce(greatest(high - low, abs(high - lag(close) OVER t), abs(low - lag(close) OVER t)), high - low) AS span,
  coalesce(high - lag(high) OVER t, 0) AS up, coalesce(lag(low) OVER t - low, 0) AS dn FROM bars WINDOW t AS {_T}), m AS MATERIALIZED (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS rise, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS fall FROM s),
w AS (SELECT ticker, date, k, close, middle, span AS atr, CAST(rise AS DOUBLE) AS p, CAST(fall AS DOUBLE) AS q, CAST(NULL AS DOUBLE) AS adx FROM m WHERE k = 1
  UNION ALL SELECT ticker, date, k, close, middle, atr, p, q, CASE WHEN p + q > 0 AND atr > 0 THEN CASE WHEN adx IS NULL THEN 100 * abs(p - q) / (p + q) ELSE adx + (100 * abs(p - q) / (p + q) - adx) * {_A} END ELSE adx END
  FROM (SELECT m.ticker, m.date, m.k, m.close, m.middle, w.adx, w.atr + (m.span - w.atr) * {_A} AS atr, w.p + (m.rise - w.p) * {_A} AS p, w.q + (m.fall - w.q) * {_A} AS q FROM w JOIN m ON m.ticker = w.ticker AND m.k = w.k + 1)),
o AS (SELECT ticker, date, 100 * p / nullif(atr, 0) AS di_plus, 100 * q / nullif(atr, 0) AS di_minus, adx, CASE WHEN adx IS NOT NULL THEN greatest(-1, least(4, (adx - 20) / 5)) END AS trend_strength_score, CASE WHEN close > middle - 3 * atr THEN 1 ELSE -1 END AS supertrend FROM w)
SELECT ticker, date, {round_sql(STRENGTH)}, supertrend FROM o""",
    "benchmark_choice_panel": f"""{signal_plans._R}, r5 AS (SELECT *, close / lag(close, 5) OVER {_T} - 1 AS ret_5d FROM r), x AS (SELECT 'first' AS c, r5.*, avg(ret_1d) OVER (PARTITION BY date) AS m, avg(ret_5d) OVER (PARTITION BY date) AS m5 FROM r5
  UNION ALL SELECT 'second', r5.*, CASE WHEN sector = '{SECTOR}' THEN avg(CASE WHEN sector = '{SECTOR}' THEN ret_1d END) OVER (PARTITION BY date) END, CASE WHEN sector = '{SECTOR}' THEN avg(CASE WHEN sector = '{SECTOR}' THEN ret_5d END) OVER (PARTITION BY date) END FROM r5),
j AS (SELECT c, ticker, date, ret_1d, m FROM x WHERE ret_1d IS NOT NULL AND m IS NOT NULL), f AS (SELECT *, CASE WHEN count(m) {_W60} = 60 THEN covar_samp(ret_1d, m) {_W60} / nullif(var_samp(m) {_W60}, 0) END AS beta, avg(ret_1d) {_W60} AS mr, avg(m) {_W60} AS mi FROM j),
h AS (SELECT c, ticker, date, beta, mr - beta * mi AS alpha, ret_1d - (mr - beta * mi) - beta * m AS beta_adjusted_residual FROM f),
z AS (SELECT x.c AS benchmark, x.ticker, x.date, beta, alpha, beta_adjusted_residual, abs(beta_adjusted_residual) AS abs_residual, ret_5d - beta * m5 AS beta_adjusted_return FROM x LEFT JOIN h ON h.c = x.c AND h.ticker = x.ticker AND h.date = x.date)
SELECT benchmark, ticker, date, {round_sql(CHOICE)} FROM z""",
    "winsorised_features": f"""WITH {BARS_SQL}, r AS (SELECT *, {', '.join(f'close / lag(close, {n}) OVER {_T} - 1 AS ret_{n}d' for n in (1, 5, 20))} FROM bars),
q AS (SELECT date, {', '.join(f'quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}' for c in CLIPPED)} FROM r GROUP BY date),
w AS (SELECT ticker, r.date, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN greatest(lo_{c}, least(hi_{c}, {c})) END AS {c}' for c in CLIPPED)} FROM r JOIN q ON q.date = r.date) SELECT ticker, date, {round_sql(CLIPPED)} FROM w""",
    "event_gap_means": f"""{validation_plans._R}, u AS ({' UNION ALL '.join(f"SELECT '{x}' AS flag, ticker, date FROM f WHERE {x} = 1" for x in validation_plans.FLAGS)}), e AS (SELECT *, date - lag(date) OVER (PARTITION BY flag, ticker ORDER BY date) AS gap FROM u),
g AS (SELECT flag, ticker, count(*) AS n, avg(gap) AS mean_gap, median(gap) AS median_gap, stddev_samp(gap) AS std_gap, sum(count(*)) OVER (PARTITION BY flag) AS total FROM e GROUP BY flag, ticker),
m AS (SELECT flag, count(*) AS n_tickers, avg(mean_gap) AS mean_gap, avg(median_gap) AS median_gap, avg(std_gap) AS std_gap, avg(std_gap / nullif(mean_gap, 0)) AS cov FROM g WHERE n >= 3 AND total >= 10 GROUP BY flag) SELECT flag, n_tickers, {round_sql(GAPS)} FROM m""",
    "beta_tilt": f"{book_plans._X}, t AS (SELECT avg(beta) FILTER (xs_rank >= 0.9) AS top, avg(beta) FILTER (xs_rank <= 0.1) AS low FROM x), u AS (SELECT *, top - low AS tilt FROM t) SELECT {round_sql(('top', 'low', 'tilt'))} FROM u",
    "sector_sizes": f"WITH {BARS_SQL}, s AS (SELECT sector, count(DISTINCT ticker) AS n_tickers FROM bars GROUP BY sector) SELECT n_tickers, count(*) AS n_sectors FROM s GROUP BY n_tickers",
}
