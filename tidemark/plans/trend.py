"""Queries of smoothed, market-relative and strategy series, with the SQL that checks them."""

from __future__ import annotations

from tidemark.functions.windows import EPS
from tidemark.operators.trend import OSCILLATORS
from tidemark.plans.rounding import roll_sql, round_sql
from tidemark.sources.bars import BARS_SQL

# The names of the features.
MICRO = (
    "overnight_gap", "intraday_ret", "close_position_in_range", "daily_range_pct", "gap_vs_range", "dollar_volume", "signed_volume_20", "delivery_pct_ma20", "delivery_pct_z20", "delivery_pct_chg", "delivery_pct_trend",
    "delivery_volume_conviction", "avg_trade_size", "avg_trade_size_z20", "n_trades_z20", "turnover_z20",
)
BETA = ("beta_60d", "idio_vol_60d")
BOOK = ("book", "market", "equity", "drawdown")
_T = "(PARTITION BY ticker ORDER BY date)"


def _z(x: str) -> str:
    return f"({x} - {roll_sql('avg', x, 20)}) / ({roll_sql('stddev_samp', x, 20)} + {EPS}) AS {x}_z"


def _ewm(x: str, old: str, n: int) -> str:
    return f"coalesce({old} + ({x} - {old}) / {n}, {x}, {old})"


OSCILLATOR_SQL = f"""WITH RECURSIVE {BARS_SQL}, s AS MATERIALIZED (SELECT ticker, date, close, row_number() OVER t AS k, close - lag(close) OVER t AS d, high - lag(high) OVER t AS up, lag(low) OVER t - low AS dn,
  greatest(high - low, abs(high - lag(close) OVER t), abs(low - lag(close) OVER t)) AS span FROM bars WINDOW t AS {_T}),
m AS MATERIALIZED (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS rise, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS fall, greatest(d, 0) + 0 * d AS gain, -least(d, 0) + 0 * d AS loss FROM s),
w AS (SELECT ticker, date, k, close, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS sig, span AS atr, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS adx, gain AS g14, loss AS l14, gain AS g2, loss AS l2 FROM m WHERE k = 1
  UNION ALL SELECT ticker, date, k, close, e12, e26, sig * 0.8e0 + (e12 - e26) * 0.2e0, atr, p, q, adx + (100 * abs(100 * p / (atr + {EPS}) - 100 * q / (atr + {EPS})) / (100 * p / (atr + {EPS}) + 100 * q / (atr + {EPS}) + {EPS}) - adx) / 14, g14, l14, g2, l2
  FROM (SELECT m.ticker, m.date, m.k, m.close, w.e12 * 11e0 / 13 + m.close * 2e0 / 13 AS e12, w.e26 * 25e0 / 27 + m.close * 2e0 / 27 AS e26, w.sig, w.adx, {_ewm('m.span', 'w.atr', 14)} AS atr, {_ewm('m.rise', 'w.p', 14)} AS p, {_ewm('m.fall', 'w.q', 14)} AS q,
    {_ewm('m.gain', 'w.g14', 14)} AS g14, {_ewm('m.loss', 'w.l14', 14)} AS l14, {_ewm('m.gain', 'w.g2', 2)} AS g2, {_ewm('m.loss', 'w.l2', 2)} AS l2 FROM w JOIN m ON m.ticker = w.ticker AND m.k = w.k + 1)),
o AS (SELECT ticker, date, (e12 - e26 - sig) / (close + {EPS}) AS macd_hist, 100 * p / (atr + {EPS}) AS di_plus_14, 100 * q / (atr + {EPS}) AS di_minus_14, adx AS adx_14, atr AS atr_14, atr / (close + {EPS}) AS atr_pct,
  100 - 100 / (1 + g14 / (l14 + {EPS})) AS rsi_14, 100 - 100 / (1 + g2 / (l2 + {EPS})) AS rsi_2 FROM w)
SELECT ticker, date, {round_sql(OSCILLATORS)} FROM o"""

MICRO_SQL = f"""WITH {BARS_SQL}, a AS (SELECT *, lag(close) OVER {_T} AS before, volume / ({roll_sql('avg', 'volume', 20)} + {EPS}) AS vr, volume / (n_trades + {EPS}) AS trade, {roll_sql('avg', 'delivery_pct', 20)} AS delivery_pct_ma20, {roll_sql('avg', 'delivery_pct', 5)} AS d5 FROM bars),
b AS (SELECT *, open / (before + {EPS}) - 1 AS overnight_gap, close / (open + {EPS}) - 1 AS intraday_ret, (close - low) / (high - low + {EPS}) AS close_position_in_range, (high - low) / (close + {EPS}) AS daily_range_pct, ln(1 + close * volume) AS dollar_volume, sign(close / before - 1) * vr AS sv,
  {_z('delivery_pct')}, {_z('trade')}, {_z('n_trades')}, {_z('turnover')}, delivery_pct - lag(delivery_pct) OVER {_T} AS delivery_pct_chg, d5 / (delivery_pct_ma20 + {EPS}) AS delivery_pct_trend, delivery_pct * vr AS delivery_volume_conviction, ln(1 + trade) AS avg_trade_size FROM a),
c AS (SELECT *, CASE WHEN high > low THEN overnight_gap / (daily_range_pct + {EPS}) END AS gap_vs_range, {roll_sql('avg', 'sv', 20)} AS signed_volume_20, delivery_pct_z AS delivery_pct_z20, trade_z AS avg_trade_size_z20, n_trades_z AS n_trades_z20, turnover_z AS turnover_z20 FROM b)
SELECT ticker, date, {round_sql(MICRO)} FROM c"""


_W60 = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
#: Beta over rows with ``ret_1d`` and the date's mean return ``market``.
MARKET_BETA = f"CASE WHEN count(CASE WHEN market IS NOT NULL THEN ret_1d END) {_W60} >= 60 THEN covar_samp(ret_1d, market) {_W60} END / ({roll_sql('var_samp', 'market', 60)} + {EPS})"


def beta_sql(returns: str) -> str:
    return f"""{returns}, m AS (SELECT *, avg(ret_1d) OVER (PARTITION BY date) AS market FROM r), b AS (SELECT *, {MARKET_BETA} AS beta_60d FROM m),
e AS (SELECT *, ret_1d - beta_60d * market AS rest FROM b), f AS (SELECT *, {roll_sql('stddev_samp', 'rest', 60)} AS idio_vol_60d FROM e) SELECT ticker, date, {round_sql(BETA)} FROM f"""


def tails_sql(returns: str) -> str:
    return f"{returns}, q AS (SELECT date, quantile_cont(fwd_3d, 0.3) AS lo, quantile_cont(fwd_3d, 0.7) AS hi FROM r GROUP BY date) SELECT ticker, date, CASE WHEN fwd_3d <= lo THEN 0 WHEN fwd_3d >= hi THEN 1 END AS label FROM r JOIN q USING (date)"


def newey_west_sql(ic: str) -> str:
    return f"""WITH i AS ({ic}), e AS (SELECT date, ic, ic - avg(ic) OVER () AS e FROM i WHERE ic IS NOT NULL), g AS (SELECT ic, e * e AS g0, e * lag(e, 1) OVER (ORDER BY date) AS g1, e * lag(e, 2) OVER (ORDER BY date) AS g2 FROM e)
SELECT count(*) AS n, round(avg(ic), 6) + 0.0 AS mean, round(CASE WHEN count(*) >= 3 THEN avg(ic) / sqrt(greatest((sum(g0) + 2 * (2e0 / 3) * coalesce(sum(g1), 0) + 2 * (1e0 / 3) * coalesce(sum(g2), 0)) / count(*), 1e-16) / count(*)) END, 6) + 0.0 AS t FROM g"""


def book_sql(cross: str) -> str:
    past = "OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""{cross}, d AS (SELECT date, avg(CASE WHEN xs_rank >= 0.9 THEN fwd_3d END) AS book, avg(fwd_3d) AS market FROM s WHERE fwd_3d IS NOT NULL GROUP BY date), k AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS k FROM d),
e AS (SELECT *, product(1 + book) {past} AS equity FROM k WHERE k % 3 = 0 AND book IS NOT NULL), f AS (SELECT *, equity / greatest(1, max(equity) {past}) - 1 AS drawdown FROM e) SELECT date, {round_sql(BOOK)} FROM f"""
