"""Queries of books and regimes, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import by_ticker, change, percent_rank, rolling
from tidemark.operators import books, panel, trend
from tidemark.plans.rounding import roll_sql
from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.plans.trend import MARKET_BETA
from tidemark.sources.bars import BARS_SQL, daily_bars

HOLD = 10
HOLDS = (1, 2, 3, 5, 7, 10, 15, 20, 30)
_T = "(PARTITION BY ticker ORDER BY date)"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each session with the rank of the five-day return, a volatility, a trend and a market beta; sessions are dates."""
    c = F.col("close")
    rows = daily_bars(spark, sf_dir).select("ticker", "sector", "date", "close", "turnover").withColumns({"ret_1d": change(c, 1), "ret_5d": change(c, 5), "trend": c / rolling(F.avg, c, 50) - 1, **{f"fwd_{h}d": panel.forward_return(h) for h in HOLDS}})
    rows = trend.market_beta(rows.withColumn("vol", rolling(F.stddev_samp, F.col("ret_1d"), 20))).withColumnRenamed("beta_60d", "beta").drop("idio_vol_60d")
    return books.on_sessions(rows.withColumn("xs_rank", percent_rank(F.col("ret_5d"), "date")))


_PRANK = "CASE WHEN ret_5d IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY ret_5d NULLS LAST) + (count(*) OVER (PARTITION BY date, ret_5d) - 1) / 2.0) / count(ret_5d) OVER (PARTITION BY date) END"
_X = f"""WITH {BARS_SQL}, a AS (SELECT ticker, sector, date, close, turnover, close / lag(close) OVER {_T} - 1 AS ret_1d, close / lag(close, 5) OVER {_T} - 1 AS ret_5d, close / {roll_sql('avg', 'close', 50)} - 1 AS trend, {', '.join(f'lead(close, {h}) OVER {_T} / close - 1 AS fwd_{h}d' for h in HOLDS)} FROM bars),
am AS (SELECT *, avg(ret_1d) OVER (PARTITION BY date) AS market FROM a), x AS MATERIALIZED (SELECT * EXCLUDE (market), {_PRANK} AS xs_rank, {roll_sql('stddev_samp', 'ret_1d', 20)} AS vol, {MARKET_BETA} AS beta, dense_rank() OVER (ORDER BY date) - 1 AS i FROM am),
mv AS MATERIALIZED (SELECT ticker, lead(i) OVER {_T} - 1 AS s, lead(close) OVER {_T} / close - 1 AS move FROM x), d AS MATERIALIZED (SELECT DISTINCT i, date FROM x)"""
#: A book's positions (i, ticker, w) as SQL over x.
_TOP = "SELECT i, ticker, 1e0 / count(*) OVER (PARTITION BY i) AS w FROM x WHERE xs_rank >= 0.9"
_SIDES = "n AS (SELECT *, count(*) FILTER (xs_rank >= 0.9) OVER v AS nl, count(*) FILTER (xs_rank <= 0.1) OVER v AS ns, count(*) OVER v AS n FROM x WINDOW v AS (PARTITION BY i)), q AS (SELECT *, CASE WHEN xs_rank >= 0.9 THEN 1e0 / nl ELSE 0 END AS lw, CASE WHEN xs_rank <= 0.1 THEN 1e0 / ns ELSE 0 END AS sw FROM n)"


def _named(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, days in parts.items():
        days = days.select(F.lit(name).alias("book"), "i", "date", "ret")
        out = days if out is None else out.unionByName(days)
    return out


def _series(parts: dict[str, str]) -> str:
    """Daily returns of each book, given SQL of its held rows (ticker, s, w)."""
    return " UNION ALL ".join(f"SELECT '{name}' AS book, d.i, d.date, coalesce(r.ret, 0) AS ret FROM d LEFT JOIN (SELECT h.s, sum(w * move) AS ret FROM ({held}) h JOIN mv ON mv.ticker = h.ticker AND mv.s = h.s GROUP BY h.s) r ON r.s = d.i" for name, held in parts.items())


def _held(positions: str, tranches: bool = False, grid: bool = False) -> str:
    return f"SELECT p.i, p.ticker, p.i + k.range AS s, p.w{f' / {HOLD}' if tranches else ''} AS w FROM ({positions}) p, range({HOLD}) k{f' WHERE p.i % {HOLD} = 0' if grid else ''}"


def _top() -> Column:
    return F.col("xs_rank") >= books.TOP


def _construction(x: DataFrame) -> dict[str, DataFrame]:
    top = books.equal_weights(x, _top())
    return {
        "single": books.daily_returns(books.held(books.on_grid(top, HOLD), HOLD), x),
        "tranches": books.daily_returns(books.held(top, HOLD, True), x),
        "inverse_vol": books.daily_returns(books.held(books.inverse_weights(x, _top(), "vol"), HOLD, True), x),
        "decay_exit": books.daily_returns(books.decayed(top, x, HOLD), x),
    }


def construction_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_named(_construction(ranked(spark, sf_dir))), "ret")


def hedged_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranked(spark, sf_dir)
    return rounded(_named({kind: books.daily_returns(books.held(books.hedged(x, kind), HOLD, True), x) for kind in ("dollar", "beta", "market")}), "ret")


def _overlays(x: DataFrame) -> dict[str, DataFrame]:
    grid = books.on_grid(x, HOLD)
    single = books.held(books.equal_weights(grid, _top()), HOLD)
    positions = {"trend": books.with_fallback(grid, F.col("trend") > 0, _top()), "persistence": books.on_grid(books.persistent(x, HOLD), HOLD), "rank_momentum": books.on_grid(books.improving(x), HOLD), "sector_cap": books.sector_capped(grid), "sector_pairs": books.sector_pairs(grid)}
    return {name: books.daily_returns(books.held(p, HOLD), x) for name, p in positions.items()} | {"stop_loss": books.daily_returns(books.stopped(single, x), x)}


def overlay_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_named(_overlays(ranked(spark, sf_dir))), "ret")


def scaled_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single book with its volatility held to a target, and blends of it with the dollar-neutral one."""
    x = ranked(spark, sf_dir)
    single = _construction(x)["single"]
    hedge = books.daily_returns(books.held(books.hedged(x, "dollar"), HOLD, True), x).select("i", F.col("ret").alias("hedge"))
    blends = {f"blend_{int(b * 100)}": single.join(hedge, "i").withColumn("ret", b * F.col("ret") + (1 - b) * F.col("hedge")) for b in (0.25, 0.5, 0.75)}
    return rounded(_named({"vol_target": books.vol_targeted(single), **blends}), "ret")


SUMMARY = ("log_growth", "net_log_growth", "mean_net", "sharpe", "max_drawdown", "win_rate", "t")


def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _construction(ranked(spark, sf_dir))
    return rounded(books.summary(_named({k: found[k] for k in ("single", "tranches")}), F.lit(2 * 10 / 1e4 / HOLD)), *SUMMARY)


PERIODS = ("book", "market", "net")


def period_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(books.period_sweep(ranked(spark, sf_dir), HOLDS), *PERIODS)


def period_books_by_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(books.period_sweep(ranked(spark, sf_dir), HOLDS, vol="vol"), *PERIODS)


SWEEP = ("net_log_growth", "annual_log_growth", "mean_book", "mean_market", "win_rate", "beat_market", "worst", "best", "max_drawdown")


def holding_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(books.sweep_summary(books.period_sweep(ranked(spark, sf_dir), HOLDS)), *SWEEP)


def top_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.top_runs(ranked(spark, sf_dir)).groupBy("length").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("n_tickers"))


def signal_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizons of 1 to 30 days: mean rank correlation, its t, the peak, and when half of that is left."""
    return rounded(books.decay_curve(ranked(spark, sf_dir)), "mean_ic", "t", "of_peak")


#: First sessions and least ranks of the books that are only refilled; their size.
STARTS, KEEPS, BOOK = (0, 5), (0.75, 0.9), 10


def _percent(df: DataFrame) -> DataFrame:
    """``keep`` in percent, a whole number."""
    return df.withColumn("keep", F.round(F.col("keep") * 100).cast("int"))


def partial_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each book at each review, and how many came or went."""
    found = books.refilled(ranked(spark, sf_dir), HOLD, STARTS, KEEPS, BOOK)
    return _percent(found).select("start", "keep", "i", F.array_join(F.array_sort("names"), " ").alias("names"), "changed")


def partial_rebalance_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns of those books, equally weighted between reviews."""
    x = ranked(spark, sf_dir)
    found = books.refilled(x, HOLD, STARTS, KEEPS, BOOK).select("start", "keep", "i", F.size("names").alias("n"), F.explode("names").alias("ticker"))
    positions = books.held(found.withColumn("weight", 1.0 / F.col("n")).select("i", "ticker", "weight", "start", "keep"), HOLD, keys=("start", "keep"))
    return rounded(books.daily_returns(positions, x, keys=("start", "keep")).transform(_percent), "ret")


REGIME = ("trend_20", "vol_20", "breadth_20", "fall")


def market_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(books.regimes(ranked(spark, sf_dir)), *REGIME)


def regime_filtered_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top names' mean outcome on dates after calm and after wild sessions, cut at the median volatility."""
    x = ranked(spark, sf_dir)
    days = x.where(_top() & F.col("fwd_3d").isNotNull()).groupBy("date").agg(F.avg("fwd_3d").alias("book"))
    known = books.regimes(x).where("vol_20 is not null")
    cut = known.agg(F.percentile("vol_20", 0.5).alias("cut"))
    found = days.join(known, "date").crossJoin(F.broadcast(cut)).groupBy((F.col("vol_20") > F.col("cut")).alias("wild"))
    return rounded(found.agg(F.count("*").alias("n"), F.avg("book").alias("mean_book"), F.avg((F.col("book") > 0).cast("double")).alias("win_rate")), "mean_book", "win_rate")


def book_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(books.capacity(ranked(spark, sf_dir)), "p10", "positions", "capacity", digits=2)


def best_of_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best ranks of each date; three is the feature."""
    x = ranked(spark, sf_dir).where("xs_rank is not null")
    return x.withColumn("place", F.row_number().over(by_ticker_of_date())).where("place <= 3").select("ticker", "date", "place")


def by_ticker_of_date():
    from pyspark.sql import Window

    return Window.partitionBy("date").orderBy(F.desc("xs_rank"), "ticker")


def entries_and_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rebalance: names that stay, come and go, as sorted lists, and the turnover."""
    from pyspark.sql import Window

    grid = books.on_grid(ranked(spark, sf_dir), HOLD).where(_top()).groupBy("i").agg(F.array_sort(F.collect_list("ticker")).alias("names"))
    before = F.coalesce(F.lag("names").over(Window.orderBy("i")), F.array().cast("array<string>"))  # a row per rebalance
    rows = grid.withColumn("before", before)
    come, gone = F.array_except("names", "before"), F.array_except("before", "names")
    return rows.select("i", F.array_join(F.array_intersect("names", "before"), " ").alias("stay"), F.array_join(come, " ").alias("come"), F.array_join(gone, " ").alias("gone"), ((F.size(come) + F.size(gone)) / (2.0 * F.size("names"))).alias("turnover"))


QUERIES = {
    q.__name__: q
    for q in (
        construction_books, hedged_books, overlay_books, scaled_books, book_summary, period_books, period_books_by_volatility, holding_sweep, top_run_lengths, signal_decay, market_regimes, regime_filtered_book, book_capacity,
        partial_rebalance, partial_rebalance_book, best_of_date, entries_and_exits,
    )
}

_DECAY = f"""SELECT p.i, p.ticker, k.s, p.w / {HOLD} AS w FROM ({_TOP}) p JOIN (SELECT i AS s FROM d UNION SELECT max(i) + range FROM d, range(1, 61) GROUP BY range) k ON k.s >= p.i AND k.s < p.i + 60
  LEFT JOIN x y ON y.ticker = p.ticker AND y.i >= p.i AND y.i <= k.s AND y.xs_rank < 0.667 GROUP BY ALL HAVING count(y.i) = 0 OR k.s = p.i"""
_CONSTRUCTION = {"single": _held(_TOP, grid=True), "tranches": _held(_TOP, True), "inverse_vol": _held("SELECT i, ticker, (1 / vol) / sum(1 / vol) OVER (PARTITION BY i) AS w FROM x WHERE xs_rank >= 0.9 AND vol > 0", True), "decay_exit": _DECAY}
_DOLLAR = "SELECT i, ticker, lw - sw AS w FROM q WHERE nl > 0 AND ns > 0 AND lw - sw <> 0"
_HEDGED = {
    "dollar": _held(_DOLLAR, True),
    "beta": _held("SELECT i, ticker, lw - sw * greatest(0.3, least(3, coalesce(coalesce(sum(beta * lw) OVER v, 0) / nullif(coalesce(sum(beta * sw) OVER v, 0), 0), 1))) AS w FROM q WHERE nl > 0 AND ns > 0 WINDOW v AS (PARTITION BY i)", True),
    "market": _held("SELECT i, ticker, lw - 1e0 / n AS w FROM q WHERE nl > 0", True),
}
_FALLBACK = "SELECT i, ticker, 1e0 / count(*) OVER (PARTITION BY i) AS w FROM ({marked}) WHERE xs_rank >= 0.9 AND (strict OR NOT has)"
_MARKED = "SELECT *, bool_or(strict AND coalesce(xs_rank >= 0.9, false)) OVER (PARTITION BY i) AS has FROM ({rows})"
_OVERLAYS = {
    "trend": _held(_FALLBACK.format(marked=_MARKED.format(rows="SELECT *, coalesce(trend > 0, false) AS strict FROM x")), grid=True),
    "persistence": _held(_FALLBACK.format(marked=_MARKED.format(rows=f"SELECT x.*, coalesce(b.xs_rank >= 0.9, false) AS strict FROM x LEFT JOIN x b ON b.ticker = x.ticker AND b.i = x.i - {HOLD}")), grid=True),
    "rank_momentum": _held("""SELECT i, ticker, 1e0 / count(*) OVER (PARTITION BY i) AS w FROM (SELECT x.i, x.ticker, row_number() OVER (PARTITION BY x.i ORDER BY x.xs_rank - b.xs_rank DESC, x.ticker) AS k, count(*) OVER (PARTITION BY x.i) AS n
      FROM x JOIN x b ON b.ticker = x.ticker AND b.i = x.i - 5 WHERE x.xs_rank - b.xs_rank IS NOT NULL) WHERE k <= greatest(floor(n * 0.1), 1)""", grid=True),
    "sector_cap": _held("SELECT i, ticker, w / sum(w) OVER (PARTITION BY i) AS w FROM (SELECT i, ticker, CASE WHEN t > 0.4 THEN w * 0.4 / t ELSE w END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY i, sector) AS t FROM (SELECT *, 1e0 / count(*) OVER (PARTITION BY i) AS w FROM x WHERE xs_rank >= 0.9)))", grid=True),
    "sector_pairs": _held("""SELECT i, ticker, side * 2e0 / count(*) OVER (PARTITION BY i) AS w FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY i, sector ORDER BY xs_rank DESC, ticker) = 1 THEN 1 WHEN row_number() OVER (PARTITION BY i, sector ORDER BY xs_rank, ticker) = 1 THEN -1 END AS side,
      count(*) OVER (PARTITION BY i, sector) AS n FROM x WHERE xs_rank IS NOT NULL) WHERE n >= 2 AND side IS NOT NULL""", grid=True),
    "stop_loss": f"SELECT h.s, h.ticker, h.w FROM ({_held(_TOP, grid=True)}) h JOIN x e ON e.ticker = h.ticker AND e.i = h.i LEFT JOIN x y ON y.ticker = h.ticker AND y.i = h.s WHERE y.close IS NULL OR y.close / e.close - 1 > -0.1",
}
_LEVER = "CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w * sqrt(252e0) END"


def _sweep(mean: str) -> str:
    longs = " UNION ALL ".join(f"SELECT {h} AS hold, date, xs_rank, vol, fwd_{h}d AS ret FROM x WHERE fwd_{h}d IS NOT NULL" for h in HOLDS)
    return f"""{_X}, o AS ({longs}), g AS (SELECT hold, date, {mean} AS book, avg(ret) AS market FROM o GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY hold ORDER BY date) - 1 AS k FROM g),
p AS (SELECT hold, date, book, market, book - 40 / 1e4 AS net FROM k WHERE k % hold = 0 AND book IS NOT NULL)"""


_MEAN = "avg(ret) FILTER (xs_rank >= 0.9)"
_LAGS = ", ".join(f"e * lag(e, {k}) OVER o AS g{k}" for k in range(1, 6))
_TOTAL = " + ".join(f"{2 * (1 - k / 6)!r}::DOUBLE * coalesce(sum(g{k}), 0)" for k in range(1, 6))
_LEADS = " UNION ALL ".join(f"SELECT {h} AS h, date, xs_rank, lead(close, {h}) OVER {_T} / close - 1 AS ret FROM x" for h in range(1, 31))


def _rank_of(x: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0"


_REGIMES = f"""{_X}, dy AS (SELECT date, avg(ret_1d) AS market, avg(CASE WHEN ret_5d > 0 THEN 1 ELSE 0 END) AS up FROM x GROUP BY date), w20 AS (SELECT *, CASE WHEN count(market) OVER w = 20 THEN sum(market) OVER w END AS t, CASE WHEN count(market) OVER w = 20 THEN stddev_samp(market) OVER w END AS v,
  CASE WHEN count(up) OVER w = 20 THEN avg(up) OVER w END AS b, sum(market) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS lv FROM dy WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
fl AS (SELECT *, lv - max(lv) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS fa FROM w20), rg AS (SELECT date, lag(t) OVER (ORDER BY date) AS trend_20, lag(v) OVER (ORDER BY date) AS vol_20, lag(b) OVER (ORDER BY date) AS breadth_20, lag(fa) OVER (ORDER BY date) AS fall FROM fl)"""
_NAMES = f"""{_X}, g AS (SELECT i, list_sort(list(ticker)) AS names FROM x WHERE xs_rank >= 0.9 AND i % {HOLD} = 0 GROUP BY i), b AS (SELECT *, coalesce(lag(names) OVER (ORDER BY i), []) AS before FROM g),
c AS (SELECT *, list_filter(names, lambda t: NOT list_contains(before, t)) AS come, list_filter(before, lambda t: NOT list_contains(names, t)) AS gone FROM b)"""
_DECAY_LAGS = ", ".join(f"e * lag(e, {k}) OVER o AS g{k}" for k in range(1, 30))
_DECAY_TOTAL = " + ".join(f"CASE WHEN {k} <= greatest(h - 1, 1) THEN 2 * (1 - {k} / (greatest(h - 1, 1) + 1e0)) ELSE 0 END * coalesce(sum(g{k}), 0)" for k in range(1, 30))
_PARTIAL = f"""ck AS (SELECT start, i, list(ticker ORDER BY xs_rank DESC, ticker) AS names, coalesce(list(ticker) FILTER (xs_rank >= 0.75), []) AS strong, coalesce(list(ticker) FILTER (xs_rank >= 0.9), []) AS best
  FROM x, (VALUES {', '.join(f'({start})' for start in STARTS)}) s(start) WHERE i % {HOLD} = start AND xs_rank IS NOT NULL GROUP BY start, i),
st AS (SELECT start, keep, i, row_number() OVER (PARTITION BY start, keep ORDER BY i) AS k, names, CASE WHEN keep = 0.75 THEN strong ELSE best END AS strong FROM ck, (VALUES {', '.join(f'({keep}e0)' for keep in KEEPS)}) t(keep)),
b AS (WITH RECURSIVE f(start, keep, k, i, names, changed) AS (SELECT DISTINCT start, keep, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT) FROM st UNION ALL
  SELECT start, keep, k, i, list_concat(stay, come), CAST(len(list_filter(before, lambda t: NOT list_contains(stay, t) AND NOT list_contains(come, t))) + len(list_filter(come, lambda t: NOT list_contains(before, t))) AS BIGINT) FROM (SELECT *, list_filter(names, lambda t: NOT list_contains(stay, t))[1:{BOOK} - len(stay)] AS come FROM (
    SELECT st.start, st.keep, st.k, st.i, st.names, f.names AS before, list_filter(f.names, lambda t: list_contains(st.strong, t)) AS stay FROM f JOIN st ON st.start = f.start AND st.keep = f.keep AND st.k = f.k + 1))) SELECT * FROM f)"""
ORACLES = {
    "construction_books": f"{_X}, o AS ({_series(_CONSTRUCTION)}) SELECT book, CAST(i AS INT) AS i, date, round(1.2345678e-7 + ret, 6) + 0.0 AS ret FROM o",
    "hedged_books": f"{_X}, {_SIDES}, o AS ({_series(_HEDGED)}) SELECT book, CAST(i AS INT) AS i, date, round(1.2345678e-7 + ret, 6) + 0.0 AS ret FROM o",
    "overlay_books": f"{_X}, o AS ({_series(_OVERLAYS)}) SELECT book, CAST(i AS INT) AS i, date, round(1.2345678e-7 + ret, 6) + 0.0 AS ret FROM o",
    "scaled_books": f"""{_X}, {_SIDES}, sr AS ({_series({'single': _CONSTRUCTION['single']})}), hg AS ({_series({'dollar': _HEDGED['dollar']})}), v AS (SELECT *, {_LEVER} AS vol FROM sr WINDOW w AS (ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
l AS (SELECT *, CASE WHEN lag(vol) OVER (ORDER BY i) IS NULL THEN 1 WHEN lag(vol) OVER (ORDER BY i) <= 0.1 THEN 2 ELSE greatest(0.3, 0.2 / lag(vol) OVER (ORDER BY i)) END AS lever FROM v), o AS (SELECT 'vol_target' AS book, i, date, ret * lever AS ret FROM l
  {' '.join(f"UNION ALL SELECT 'blend_{int(b * 100)}', sr.i, sr.date, {b} * sr.ret + {1 - b} * hg.ret FROM sr JOIN hg ON sr.i = hg.i" for b in (0.25, 0.5, 0.75))}) SELECT book, CAST(i AS INT) AS i, date, round(1.2345678e-7 + ret, 6) + 0.0 AS ret FROM o""",
    "book_summary": f"""{_X}, sr AS ({_series({k: _CONSTRUCTION[k] for k in ('single', 'tranches')})}), n AS (SELECT *, ret - {2 * 10 / 1e4 / HOLD!r} AS net FROM sr), e AS (SELECT *, net - avg(net) OVER (PARTITION BY book) AS e, sum(ln(greatest(1 + net, 1e-6))) OVER (PARTITION BY book ORDER BY i ROWS UNBOUNDED PRECEDING) AS lv FROM n),
g AS (SELECT *, {_LAGS}, exp(lv - max(lv) OVER (PARTITION BY book ORDER BY i ROWS UNBOUNDED PRECEDING)) - 1 AS fall FROM e WINDOW o AS (PARTITION BY book ORDER BY i)),
s AS (SELECT book, count(*) AS n_days, sum(ln(greatest(1 + ret, 1e-6))) AS log_growth, sum(ln(greatest(1 + net, 1e-6))) AS net_log_growth, avg(net) AS mean_net, avg(net) / (stddev_samp(net) + 1e-12) * sqrt(252e0) AS sharpe, min(fall) AS max_drawdown, avg(CAST(net > 0 AS INT)) AS win_rate,
  avg(net) / sqrt(greatest((sum(e * e) + {_TOTAL}) / count(*), 1e-16) / count(*)) AS t FROM g GROUP BY book) SELECT book, n_days, {round_sql(SUMMARY)} FROM s""",
    "period_books": f"{_sweep(_MEAN)} SELECT hold, date, {round_sql(PERIODS)} FROM p",
    "period_books_by_volatility": f"{_sweep('sum(ret / vol) FILTER (xs_rank >= 0.9) / nullif(sum(1 / vol) FILTER (xs_rank >= 0.9), 0)')} SELECT hold, date, {round_sql(PERIODS)} FROM p",
    "holding_sweep": f"""{_sweep(_MEAN)}, l AS (SELECT *, sum(ln(greatest(1 + net, 1e-6))) OVER w AS lv FROM p WINDOW w AS (PARTITION BY hold ORDER BY date ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, exp(lv - greatest(0, max(lv) OVER (PARTITION BY hold ORDER BY date ROWS UNBOUNDED PRECEDING))) - 1 AS fall FROM l),
s AS (SELECT hold, count(*) AS n, sum(ln(greatest(1 + net, 1e-6))) AS net_log_growth, avg(book) AS mean_book, avg(market) AS mean_market, avg(CAST(book > 0 AS INT)) AS win_rate, avg(CAST(book > market AS INT)) AS beat_market, min(book) AS worst, max(book) AS best, min(fall) AS max_drawdown FROM f GROUP BY hold),
z AS (SELECT *, net_log_growth * 252 / (n * hold) AS annual_log_growth FROM s) SELECT hold, n, {round_sql(SWEEP)} FROM z""",
    "top_run_lengths": f"{_X}, t AS (SELECT ticker, i - row_number() OVER {_T} AS run FROM x WHERE xs_rank >= 0.9), l AS (SELECT ticker, count(*) AS length FROM t GROUP BY ticker, run) SELECT length, count(*) AS n, count(DISTINCT ticker) AS n_tickers FROM l GROUP BY length",
    "signal_decay": f"""{_X}, u AS ({_LEADS}), v AS (SELECT h, date, {_rank_of('xs_rank', 'h, date')} AS a, {_rank_of('ret', 'h, date')} AS b FROM u WHERE ret IS NOT NULL AND xs_rank IS NOT NULL), c AS (SELECT h, date, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM v GROUP BY ALL HAVING count(*) >= 10),
e AS (SELECT h, date, ic, ic - avg(ic) OVER (PARTITION BY h) AS e FROM c WHERE ic IS NOT NULL), g AS (SELECT *, {_DECAY_LAGS} FROM e WINDOW o AS (PARTITION BY h ORDER BY date)),
m AS (SELECT h, count(*) AS n_days, avg(ic) AS mean_ic, avg(ic) / sqrt(greatest((sum(e * e) + {_DECAY_TOTAL}) / count(*), 1e-16) / count(*)) AS t FROM g GROUP BY h HAVING count(*) >= 30),
k AS (SELECT arg_max(h, mean_ic) AS peak_h, max(mean_ic) AS top FROM m), f AS (SELECT min(h) AS half_life FROM m, k WHERE h > peak_h AND mean_ic <= top / 2)
SELECT h, n_days, round(1.2345678e-7 + mean_ic, 6) + 0.0 AS mean_ic, round(1.2345678e-7 + t, 6) + 0.0 AS t, round(1.2345678e-7 + mean_ic / top, 6) + 0.0 AS of_peak, peak_h, half_life FROM m, k, f""",
    "partial_rebalance": f"""{_X}, {_PARTIAL} SELECT CAST(start AS INTEGER) AS start, CAST(round(keep * 100) AS INTEGER) AS keep, CAST(i AS INTEGER) AS i, array_to_string(list_sort(names), ' ') AS names, changed FROM b WHERE k > 0""",
    "partial_rebalance_book": f"""{_X}, {_PARTIAL}, h AS (SELECT start, keep, unnest(names) AS ticker, i, len(names) AS n FROM b WHERE k > 0), r AS (SELECT start, keep, h.i + j.range AS s, sum(move / n) AS ret FROM h, range({HOLD}) j, mv WHERE mv.ticker = h.ticker AND mv.s = h.i + j.range GROUP BY ALL),
t AS (SELECT DISTINCT start, keep FROM b WHERE k > 0) SELECT CAST(t.start AS INTEGER) AS start, CAST(round(t.keep * 100) AS INTEGER) AS keep, CAST(d.i AS INT) AS i, d.date, round(1.2345678e-7 + coalesce(ret, 0), 6) + 0.0 AS ret FROM t CROSS JOIN d LEFT JOIN r ON r.start = t.start AND r.keep = t.keep AND r.s = d.i""",
    "market_regimes": f"{_REGIMES} SELECT date, {round_sql(REGIME)} FROM rg",
    "regime_filtered_book": f"""{_REGIMES}, bk AS (SELECT date, avg(fwd_3d) AS book FROM x WHERE xs_rank >= 0.9 AND fwd_3d IS NOT NULL GROUP BY date), ct AS (SELECT median(vol_20) AS cut FROM rg WHERE vol_20 IS NOT NULL)
SELECT vol_20 > cut AS wild, count(*) AS n, round(1.2345678e-7 + avg(book), 6) + 0.0 AS mean_book, round(1.2345678e-7 + avg(CAST(book > 0 AS INT)), 6) + 0.0 AS win_rate FROM bk JOIN rg USING (date), ct WHERE vol_20 IS NOT NULL GROUP BY 1""",
    "book_capacity": f"""{_X}, v AS (SELECT *, {roll_sql('avg', 'turnover', 20)} AS adv FROM x), c AS (SELECT quantile_cont(adv, 0.1) AS p10, count(*) / count(DISTINCT date) AS positions FROM v WHERE xs_rank >= 0.9)
SELECT round(1.2345678e-7 + p10, 2) + 0.0 AS p10, round(1.2345678e-7 + positions, 2) + 0.0 AS positions, CAST(share AS DOUBLE) AS share, round(1.2345678e-7 + p10 * share * positions, 2) + 0.0 AS capacity FROM c, (VALUES (0.05), (0.1)) s(share)""",
    "best_of_date": f"{_X} SELECT ticker, date, CAST(row_number() OVER (PARTITION BY date ORDER BY xs_rank DESC, ticker) AS INT) AS place FROM x WHERE xs_rank IS NOT NULL QUALIFY place <= 3",
    "entries_and_exits": f"""{_NAMES} SELECT CAST(i AS INT) AS i, array_to_string(list_filter(names, lambda t: list_contains(before, t)), ' ') AS stay, array_to_string(come, ' ') AS come, array_to_string(gone, ' ') AS gone, (len(come) + len(gone)) / (2e0 * len(names)) AS turnover FROM c""",
}
