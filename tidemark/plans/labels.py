"""Queries of labels, folds, neutralised scores, joins and whole cross-sections, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import EPS, by_ticker, change, percent_rank, rolling
from tidemark.operators import labels, panel, trend, validation
from tidemark.operators.cleaning import number
from tidemark.plans.rounding import roll_sql
from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.plans.trend import MARKET_BETA, MICRO_SQL, OSCILLATOR_SQL
from tidemark.sources.bars import BARS_SQL, daily_bars

HORIZONS = (1, 3, 5)
_T = "(PARTITION BY ticker ORDER BY date)"
_R = f"""WITH {BARS_SQL}, r AS (SELECT *, close / lag(close) OVER {_T} - 1 AS ret_1d, close / lag(close, 5) OVER {_T} - 1 AS ret_5d, close / lag(close, 20) OVER {_T} - 1 AS ret_20d, {', '.join(f'lead(close, {h}) OVER {_T} / close - 1 AS fwd_{h}d' for h in HORIZONS)} FROM bars),
vm AS (SELECT *, avg(ret_1d) OVER (PARTITION BY date) AS market FROM r), v AS MATERIALIZED (SELECT * EXCLUDE (market), {roll_sql('stddev_samp', 'ret_1d', 20)} AS vol, {MARKET_BETA} AS beta FROM vm)"""


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("close")
    rows = daily_bars(spark, sf_dir).withColumns({"ret_1d": change(c, 1), "ret_5d": change(c, 5), "ret_20d": change(c, 20), **{f"fwd_{h}d": panel.forward_return(h) for h in HORIZONS}})
    rows = trend.market_beta(rows.withColumn("vol", rolling(F.stddev_samp, F.col("ret_1d"), 20)))
    return rows.withColumnRenamed("beta_60d", "beta").drop("idio_vol_60d")


def target_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.with_targets(daily_bars(spark, sf_dir), HORIZONS)
    return rounded(found.select("ticker", "date", *[f"{x}_{h}d" for h in HORIZONS for x in ("fwd", "target", "label")]), *[f"fwd_{h}d" for h in HORIZONS])


def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound target, and one that was shifted by a row too few."""
    rows = rows_of(spark, sf_dir)
    sound = labels.leaks(rows, "fwd_3d", 3).withColumn("target", F.lit("sound"))
    return sound.unionByName(labels.leaks(rows.withColumn("wrong", F.lead("close", 2).over(by_ticker())), "wrong", 3).withColumn("target", F.lit("wrong")))


def barrier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.triple_barrier(rows_of(spark, sf_dir), "vol").select("ticker", "date", "barrier")


def label_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.uniqueness_weights(daily_bars(spark, sf_dir), 3).select("ticker", "date", "uniqueness"), "uniqueness")


def fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.walk_forward(daily_bars(spark, sf_dir), folds=6, purge=3)
    return found.groupBy("fold", "role").agg(F.count("*").alias("n"), F.count_distinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def neutral_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients from the first half of the dates, applied to all."""
    rows = rows_of(spark, sf_dir).withColumn("score", percent_rank(F.col("ret_5d"), "date"))
    fit = labels.neutralise_fit(rows.where("date < date'1996-07-01'"), "score", "beta")
    return rounded(labels.neutralise(rows, fit, "score", "beta").select("ticker", "date", "neutral"), "neutral")


def neutral_scores_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit for each date; dates on which beta doesn't vary within a sector have a slope of 0."""
    rows = rows_of(spark, sf_dir).withColumn("score", percent_rank(F.col("ret_5d"), "date"))
    fit = labels.neutralise_fit(rows, "score", "beta", "date")
    return rounded(labels.neutralise(rows, fit, "score", "beta", "date").select("ticker", "date", "neutral"), "neutral")


def ensemble_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.rank_average(rows_of(spark, sf_dir), ("ret_5d", "volume", "delivery_pct")).withColumn("score", F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.col("ensemble") * 10))).cast("int"))
    return rounded(rows.select("ticker", "date", "ensemble", F.when(F.col("ensemble").isNotNull(), labels.score_label(F.col("score"))).alias("label")), "ensemble")


COMBINED = ("ret_1d", "ret_5d", "delivery_pct", "volume")


def signed_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir)
    slopes = validation.fama_macbeth(rows, COMBINED, "fwd_3d")
    return rounded(labels.signed_combination(rows, slopes, COMBINED).select("ticker", "date", "combined"), "combined")


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery rows of a part of the days, as padded strings."""
    bars = daily_bars(spark, sf_dir).where(F.dayofmonth("date") % 3 != 0)
    return bars.select(F.concat(F.lit(" "), "ticker", F.lit(".NS ")).alias("symbol"), "date", F.when(F.dayofmonth("date") % 5 == 0, "-").otherwise(F.col("volume").cast("long").cast("string")).alias("quantity"))


def bars_with_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the delivery table and a sector dimension; missing sectors are "Other", missing bands 0.2."""
    delivery = _quantities(spark, sf_dir).select(F.replace(F.upper(F.trim("symbol")), F.lit(".NS"), F.lit("")).alias("symbol"), "date", number(F.col("quantity")).alias("quantity"))
    rows = daily_bars(spark, sf_dir).select("ticker", F.upper("ticker").alias("symbol"), "date", "close").join(delivery, ["symbol", "date"], "left")
    sectors = spark.sql("SELECT * FROM VALUES ('Brand#11', 'Energy', 0.1D), ('Brand#25', 'Metals', 0.05D) AS t(ticker, sector, band)")
    return rounded(labels.with_dimension(rows, sectors, "ticker", {"sector": "Other", "band": 0.2}).drop("symbol"), "close", "quantity", "band")


def near_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir).withColumn("flag", F.when(F.col("volume") > 100, 1).otherwise(0))
    return labels.near_event(rows, "flag", 5).select("ticker", "date", "flag", "near")


def latest_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir).withColumns({"before": F.lag("close").over(by_ticker()), "rank": percent_rank(F.col("ret_5d"), "date")})
    latest = labels.last_rows(rows.select("ticker", "date", "close", "before", "rank"), 1)
    quotes = latest.where("ticker < 'Brand#33'").select("ticker", (F.col("close") * 1.01).alias("quote"))
    predictions = latest.where("ticker > 'Brand#22'").select("ticker", F.ceil(F.col("rank") * 10).cast("int").alias("score"))
    found = labels.universe(latest.drop("rank", "back"), quotes, predictions)
    return rounded(found.select("ticker", "date", "price", "live", "change_pct", "score", "label"), "price", "change_pct")


def last_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven rows of each ticker; seven is the least that callers may ask for."""
    return rounded(labels.last_rows(daily_bars(spark, sf_dir).select("ticker", "date", "close"), 7), "close")


def interest_before_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as option rows near each month's expiry."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.expr("l_partkey = p_partkey"))
    options = lines.select(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("open_interest"))
    months = spark.sql("SELECT explode(sequence(date'1995-01-15', date'1996-12-15', interval 1 month)) AS month")
    found = labels.before_expiry(options, months.select(panel.monthly_expiry(F.col("month")).alias("expiry")), 5)
    return rounded(found.groupBy("expiry", "symbol").agg(F.count("*").alias("n"), F.sum("open_interest").alias("open_interest")), "open_interest")


BASE = ("ret_1d", "ret_5d", "ret_20d", "momentum_12_1", "momentum_60d", "vol_20d", "volume_ratio_20", "delivery_pct", "range_position_52w", "amihud_illiq", "rsi_14", "delivery_pct_z20")
WHOLE = tuple(f"xs_{k}_{c}" for k in ("rank", "z") for c in BASE) + ("market_ret_1d", "market_ret_5d", "excess_ret_1d", "excess_ret_5d", "sector_ret_1d", "sector_ret_5d", "vs_sector_ret_1d", "vs_sector_ret_5d", "sector_rank_abs_ret", "sector_rank_volume")


def whole_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and z-scores of all base columns on each date, returns against the market and the sector, and ranks within it."""
    bars = daily_bars(spark, sf_dir)
    rows = panel.price_features(bars).withColumn("momentum_60d", F.col("ret_60d"))
    for name, more in (("rsi_14", trend.oscillators(bars)), ("delivery_pct_z20", trend.microstructure(bars))):
        rows = rows.join(more.select("ticker", "date", F.round(name, 6).alias(name)), ["ticker", "date"], "left")
    day, group = Window.partitionBy("date"), Window.partitionBy("date", "sector")
    out = rows.withColumns({f"xs_rank_{c}": percent_rank(F.col(c), "date") for c in BASE} | {f"xs_z_{c}": (F.col(c) - F.avg(c).over(day)) / (F.stddev_samp(c).over(day) + EPS) for c in BASE})
    out = out.withColumns({f"{k}_ret_{n}d": F.avg(f"ret_{n}d").over(w) for n in (1, 5) for k, w in (("market", day), ("sector", group))})
    out = out.withColumns({f"{k}_ret_{n}d": F.col(f"ret_{n}d") - F.col(f"{m}_ret_{n}d") for n in (1, 5) for k, m in (("excess", "market"), ("vs_sector", "sector"))})
    out = out.withColumns({"sector_rank_abs_ret": percent_rank(F.abs("ret_1d"), "date", "sector"), "sector_rank_volume": percent_rank(F.col("volume_ratio_20"), "date", "sector")})
    # z-scores of a date whose values are all but equal are noise over EPS; they are shown where the deviation carries
    shown = {f"xs_z_{c}": F.when(F.stddev_samp(c).over(day) > 1e-6 * F.abs(F.avg(c).over(day)), F.col(f"xs_z_{c}")) for c in BASE}
    return rounded(out.withColumns(shown).select("ticker", "date", *WHOLE), *WHOLE)


MORE = ("momentum_120d", "vol_of_vol", "sma_20_50_cross", "stock_vs_sector_return_5d", "stock_vs_index_return_5d")


def more_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.price_features(daily_bars(spark, sf_dir)).withColumns({"momentum_120d": change(F.col("close"), 120), "vol_of_vol": rolling(F.stddev_samp, F.col("vol_20d"), 60), "sma_20_50_cross": F.col("sma_20") / (F.col("sma_50") + EPS) - 1})
    index = rows.groupBy("date").agg(F.avg("ret_5d").alias("index_5d")).where(F.dayofmonth("date") != 13)
    sector = rows.groupBy("date", "sector").agg(F.avg("ret_5d").alias("sector_5d"))
    joined = rows.join(index, "date", "left").join(sector, ["date", "sector"], "left").withColumns({"stock_vs_sector_return_5d": F.col("ret_5d") - F.col("sector_5d"), "stock_vs_index_return_5d": F.col("ret_5d") - F.col("index_5d")})
    return rounded(joined.select("ticker", "date", *MORE), *MORE)


def reason_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, lo, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    rows = daily_bars(spark, sf_dir).withColumn("volume_zscore_20", (F.col("volume") - rolling(F.avg, F.col("volume"), 20)) / rolling(F.stddev_samp, F.col("volume"), 20))
    rows = rows.withColumns({"intraday_reversal": F.when(c >= o, F.try_divide(h - c, h - lo)).otherwise(F.try_divide(c - lo, h - lo)), "circuit_proximity": F.try_divide(h, lo) - 1})
    return labels.explanations(rows).select("ticker", "date", "reasons")


def signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("ret_1d", "ret_5d", "delivery_pct", "vol")
    return rounded(labels.strongest_signals(rows_of(spark, sf_dir), names, heavy=("delivery_pct",)), "value")


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties to columns and back, binned values, and a wide table of counts by type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.to_date("ts").alias("date"), "value")
    band = F.when(F.col("value") <= 10, "low").when(F.col("value") <= 50, "middle").otherwise("high")
    found = events.withColumn("band", band).groupBy("date").pivot("band", ["low", "middle", "high"]).agg(F.count(F.lit(1))).na.fill(0)
    return found.withColumn("as_json", F.to_json(F.struct("low", "middle", "high"))).withColumn("read_back", F.from_json("as_json", "low long, middle long, high long")["high"])


def session_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of two tickers: in either, in both, in the first alone; and each ticker's first date."""
    bars = daily_bars(spark, sf_dir).select("ticker", "date")
    a, b = (bars.where(F.col("ticker") == t).select("date") for t in ("Brand#11", "Brand#22"))
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "first_alone": a.exceptAll(b)}
    out = bars.groupBy("ticker").agg(F.min("date").alias("date")).select(F.concat(F.lit("first of "), "ticker").alias("part"), "date")
    for name, rows in parts.items():
        out = out.unionByName(rows.select(F.lit(name).alias("part"), "date"))
    return out.groupBy("part").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


QUERIES = {
    q.__name__: q
    for q in (
        target_panel, leak_report, barrier_labels, label_uniqueness, fold_table, neutral_scores, neutral_scores_by_date, ensemble_ranks, signed_signal, bars_with_delivery, near_spikes, latest_universe, last_days,
        interest_before_expiry, whole_cross_section, more_windows, reason_table, signal_table, event_properties, session_sets,
    )
}


def _prank(x: str, keys: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {keys}) END"


def _class(r: str) -> str:
    return f"CASE WHEN {r} > 0.03 THEN 4 WHEN {r} > 0.01 THEN 3 WHEN {r} >= -0.01 THEN 2 WHEN {r} >= -0.03 THEN 1 WHEN {r} < -0.03 THEN 0 END"


def _name(r: str) -> str:
    return f"CASE {_class(r)} WHEN 0 THEN 'STRONG SELL' WHEN 1 THEN 'SELL' WHEN 3 THEN 'BUY' WHEN 4 THEN 'STRONG BUY' ELSE 'HOLD' END"


_BAND = "CASE WHEN {s} >= 8 THEN 'STRONG BUY' WHEN {s} >= 6 THEN 'BUY' WHEN {s} >= 4 THEN 'HOLD' WHEN {s} >= 2 THEN 'SELL' WHEN {s} >= 0 THEN 'STRONG SELL' ELSE 'HOLD' END"
_AHEAD = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"


def _neutral(keys: str, where: str) -> str:
    on, part = ("USING (date, sector)", "PARTITION BY date") if keys else ("USING (sector)", "")
    return f"""{_R}, s AS (SELECT *, {_prank('ret_5d', 'date')} AS score FROM v), m AS (SELECT {keys} sector, count(*) AS n, avg(score) AS my, avg(beta) AS mb, covar_pop(score, beta) AS c, var_pop(beta) AS vb FROM s WHERE score IS NOT NULL AND beta IS NOT NULL {where} GROUP BY ALL),
k AS (SELECT {keys} sector, my, mb, coalesce(sum(n * c) OVER ({part}) / nullif(sum(n * vb) OVER ({part}), 0), 0) AS b FROM m), j AS (SELECT s.ticker, s.date, score, score - (my - b * mb) - b * beta AS rest FROM s LEFT JOIN k {on}),
o AS (SELECT ticker, date, CASE WHEN count(rest) OVER (PARTITION BY date) >= 0.5 * count(*) OVER (PARTITION BY date) THEN coalesce(rest, score) ELSE score END AS neutral FROM j) SELECT ticker, date, round(1.2345678e-7 + neutral, 6) + 0.0 AS neutral FROM o"""


_LAST_THURSDAY = "CAST(last_day({d}) - CAST((isodow(last_day({d})) + 3) % 7 AS INT) AS DATE)"
_F = f"""WITH {BARS_SQL}, a AS (SELECT *, {', '.join(f'close / lag(close, {n}) OVER {_T} - 1 AS ret_{n}d' for n in (1, 5, 20))}, close / lag(close, 60) OVER {_T} - 1 AS momentum_60d, ln(close / lag(close) OVER {_T}) AS lr, lag(close, 21) OVER {_T} / (lag(close, 252) OVER {_T} + {EPS}) - 1 AS momentum_12_1,
  volume / ({roll_sql('avg', 'volume', 20)} + {EPS}) AS volume_ratio_20, {roll_sql('max', 'high', 252, 60)} AS hi, {roll_sql('min', 'low', 252, 60)} AS lo, close / lag(close, 120) OVER {_T} - 1 AS momentum_120d, {roll_sql('avg', 'close', 20)} / ({roll_sql('avg', 'close', 50)} + {EPS}) - 1 AS sma_20_50_cross FROM bars),
b AS (SELECT *, abs(ret_1d) / (close * volume + {EPS}) AS ill, {roll_sql('stddev_samp', 'lr', 20)} AS vol_20d, (close - lo) / (hi - lo + {EPS}) AS range_position_52w FROM a), c AS MATERIALIZED (SELECT *, {roll_sql('avg', 'ill', 20)} * 1e9 AS amihud_illiq FROM b)"""
_XS_COLUMNS = ", ".join(f"{_prank(c, 'date')} AS xs_rank_{c}, CASE WHEN stddev_samp({c}) OVER d > 1e-6 * abs(avg({c}) OVER d) THEN ({c} - avg({c}) OVER d) / (stddev_samp({c}) OVER d + {EPS}) END AS xs_z_{c}" for c in BASE)
_FM = " UNION ALL ".join(f"SELECT '{c}' AS feature, date, {c} AS x, fwd_3d AS y FROM v WHERE {c} IS NOT NULL AND fwd_3d IS NOT NULL" for c in COMBINED)
_SIGNED = " + ".join(f"coalesce((SELECT g FROM sg WHERE feature = '{c}') * ({c} - avg({c}) OVER d) / nullif(stddev_samp({c}) OVER d, 0), 0)" for c in COMBINED)
_SIGNALS = " UNION ALL ".join(f"SELECT ticker, date, {i} AS pos, '{c}' AS feature, {c} AS value, abs({c}) * {1.15 if c == 'delivery_pct' else 1}::DOUBLE AS w FROM v WHERE {c} IS NOT NULL" for i, c in enumerate(("ret_1d", "ret_5d", "delivery_pct", "vol")))
ORACLES = {
    "target_panel": f"{_R} SELECT ticker, date, {', '.join(f'round(1.2345678e-7 + fwd_{h}d, 6) + 0.0 AS fwd_{h}d, {_class(f'fwd_{h}d')} AS target_{h}d, {_name(f'fwd_{h}d')} AS label_{h}d' for h in HORIZONS)} FROM r",
    "leak_report": f"""{_R}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k, lead(close, 2) OVER {_T} AS wrong FROM r)
SELECT ticker, count(fwd_3d) AS n_leaks, count(*) AS n_last, 'sound' AS target FROM k WHERE k <= 3 GROUP BY ticker UNION ALL SELECT ticker, count(wrong), count(*), 'wrong' FROM k WHERE k <= 3 GROUP BY ticker""",
    "barrier_labels": f"""{_R}, b AS (SELECT *, max(close) {_AHEAD} / close - 1 >= vol * sqrt(3e0) AS up, min(close) {_AHEAD} / close - 1 <= -vol * sqrt(3e0) AS down FROM v)
SELECT ticker, date, CASE WHEN fwd_3d IS NOT NULL AND vol IS NOT NULL THEN CASE WHEN up AND down THEN CAST(fwd_3d > 0 AS INT) WHEN up THEN 1 WHEN down THEN 0 END END AS barrier FROM b""",
    "label_uniqueness": f"WITH {BARS_SQL}, k AS (SELECT ticker, date, least(row_number() OVER {_T} - 1, 3) + 1 AS n FROM bars) SELECT ticker, date, round(1.2345678e-7 + 1 / avg(n) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 6) + 0.0 AS uniqueness FROM k",
    "fold_table": f"""WITH {BARS_SQL}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM bars)), n AS (SELECT count(*) AS n, count(*) // 8 AS len FROM d), f AS (SELECT CAST(range AS INT) AS fold, n - (6 - range) * len AS stop, len FROM n, range(6) WHERE n - (6 - range) * len >= 300)
SELECT fold, CASE WHEN k < stop - 3 THEN 'train' ELSE 'test' END AS role, count(*) AS n, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM bars JOIN d USING (date), f WHERE k < stop - 3 OR (k >= stop AND k < stop + len) GROUP BY ALL""",
    "neutral_scores": _neutral("", "AND date < DATE '1996-07-01'"),
    "neutral_scores_by_date": _neutral("date,", ""),
    "ensemble_ranks": f"{_R}, e AS (SELECT ticker, date, ({' + '.join(_prank(c, 'date') for c in ('ret_5d', 'volume', 'delivery_pct'))}) / 3 AS e FROM r) SELECT ticker, date, round(1.2345678e-7 + e, 6) + 0.0 AS ensemble, CASE WHEN e IS NOT NULL THEN {_BAND.format(s='greatest(1, least(10, ceil(e * 10)))')} END AS label FROM e",
    "signed_signal": f"{_R}, u AS ({_FM}), s AS (SELECT feature, date, covar_samp(x, y) / stddev_samp(x) AS slope FROM u GROUP BY ALL HAVING count(*) >= 15 AND stddev_samp(x) > 0), sg AS (SELECT feature, sign(avg(slope)) AS g FROM s GROUP BY feature HAVING count(*) >= 30) SELECT ticker, date, round(1.2345678e-7 + {_SIGNED}, 6) + 0.0 AS combined FROM v WINDOW d AS (PARTITION BY date)",
    "bars_with_delivery": f"""WITH {BARS_SQL} SELECT ticker, date, round(1.2345678e-7 + close, 6) + 0.0 AS close, round(1.2345678e-7 + CASE WHEN day(date) % 3 <> 0 AND day(date) % 5 <> 0 THEN floor(volume) END, 6) + 0.0 AS quantity,
  CASE ticker WHEN 'Brand#11' THEN 'Energy' WHEN 'Brand#25' THEN 'Metals' ELSE 'Other' END AS sector, CASE ticker WHEN 'Brand#11' THEN 0.1e0 WHEN 'Brand#25' THEN 0.05e0 ELSE 0.2e0 END AS band FROM bars""",
    "near_spikes": f"{_R}, f AS (SELECT ticker, date, CASE WHEN volume > 100 THEN 1 ELSE 0 END AS flag FROM r) SELECT ticker, date, flag, max(flag) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 5 DAY FOLLOWING) AS near FROM f",
    "latest_universe": f"""{_R}, l AS (SELECT ticker, date, close, lag(close) OVER {_T} AS before, {_prank('ret_5d', 'date')} AS rk FROM r QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
u AS (SELECT *, CASE WHEN ticker < 'Brand#33' THEN close * 1.01e0 END AS quote, CASE WHEN ticker > 'Brand#22' THEN CAST(ceil(rk * 10) AS INT) END AS score FROM l)
SELECT ticker, date, round(1.2345678e-7 + coalesce(quote, close), 6) + 0.0 AS price, quote IS NOT NULL AS live, round(1.2345678e-7 + coalesce(quote, close) / before * 100 - 100, 6) + 0.0 AS change_pct, score, {_BAND.format(s='coalesce(score, 5)')} AS label FROM u""",
    "last_days": f"WITH {BARS_SQL} SELECT ticker, date, round(1.2345678e-7 + close, 6) + 0.0 AS close, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS INT) AS back FROM bars QUALIFY back <= 7",
    "interest_before_expiry": f"""WITH m AS (SELECT CAST(range AS DATE) AS mo FROM range(DATE '1995-01-15', DATE '1996-12-16', INTERVAL 1 MONTH)), e AS (SELECT {_LAST_THURSDAY.format(d='mo')} AS expiry FROM m),
o AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT expiry, symbol, count(*) AS n, round(1.2345678e-7 + sum(q), 6) + 0.0 AS open_interest FROM o JOIN e ON date >= expiry - 10 AND date <= expiry AND isodow(date) < 6 GROUP BY ALL""",
    "whole_cross_section": f"""{_F}, x AS (SELECT *, {_XS_COLUMNS}, {', '.join(f'avg(ret_{n}d) OVER d AS market_ret_{n}d, ret_{n}d - avg(ret_{n}d) OVER d AS excess_ret_{n}d, avg(ret_{n}d) OVER g AS sector_ret_{n}d, ret_{n}d - avg(ret_{n}d) OVER g AS vs_sector_ret_{n}d' for n in (1, 5))},
  {_prank('abs(ret_1d)', 'date, sector')} AS sector_rank_abs_ret, {_prank('volume_ratio_20', 'date, sector')} AS sector_rank_volume FROM (SELECT c.*, rsi_14, delivery_pct_z20 FROM c LEFT JOIN ({OSCILLATOR_SQL}) o ON o.ticker = c.ticker AND o.date = c.date LEFT JOIN ({MICRO_SQL}) m ON m.ticker = c.ticker AND m.date = c.date) WINDOW d AS (PARTITION BY date), g AS (PARTITION BY date, sector)) SELECT ticker, date, {round_sql(WHOLE)} FROM x""",
    "more_windows": f"""{_F}, w AS (SELECT *, {roll_sql('stddev_samp', 'vol_20d', 60)} AS vol_of_vol, ret_5d - avg(ret_5d) OVER (PARTITION BY date, sector) AS stock_vs_sector_return_5d, CASE WHEN day(date) <> 13 THEN ret_5d - avg(ret_5d) OVER (PARTITION BY date) END AS stock_vs_index_return_5d FROM c) SELECT ticker, date, {round_sql(MORE)} FROM w""",
    "reason_table": f"""WITH {BARS_SQL}, z AS (SELECT *, (volume - {roll_sql('avg', 'volume', 20)}) / nullif({roll_sql('stddev_samp', 'volume', 20)}, 0) AS z, CASE WHEN high > low THEN CASE WHEN close >= open THEN (high - close) / (high - low) ELSE (close - low) / (high - low) END END AS rv, high / low - 1 AS cp FROM bars),
t AS (SELECT ticker, date, concat_ws(' ', CASE WHEN z > 2 THEN 'Volume is ' || CAST(round(z, 1) AS VARCHAR) || ' deviations above its mean.' END, CASE WHEN delivery_pct < 0.3 THEN 'Delivery fell to ' || CAST(round(delivery_pct * 100, 1) AS VARCHAR) || ' %.' END,
  CASE WHEN rv > 0.6 THEN 'The price reversed within the day.' END, CASE WHEN cp > 0.9 THEN 'The price closed near its band.' END) AS said FROM z) SELECT ticker, date, CASE WHEN said = '' THEN 'No single measure stands out.' ELSE said END AS reasons FROM t""",
    "signal_table": f"{_R}, u AS ({_SIGNALS}) SELECT ticker, date, CAST(row_number() OVER (PARTITION BY ticker, date ORDER BY w DESC, pos) AS INT) AS place, feature, round(1.2345678e-7 + value, 6) + 0.0 AS value, CASE WHEN value > 0 THEN 'up' ELSE 'down' END AS direction FROM u QUALIFY place <= 3",
    "event_properties": """WITH p AS (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (value <= 10) AS low, count(*) FILTER (value > 10 AND value <= 50) AS middle, count(*) FILTER (value > 50 OR value IS NULL) AS high FROM events GROUP BY 1)
SELECT *, '{"low":' || low || ',"middle":' || middle || ',"high":' || high || '}' AS as_json, high AS read_back FROM p""",
    "session_sets": f"""WITH {BARS_SQL}, a AS (SELECT date FROM bars WHERE ticker = 'Brand#11'), b AS (SELECT date FROM bars WHERE ticker = 'Brand#22'), u AS (SELECT 'first of ' || ticker AS part, min(date) AS date FROM bars GROUP BY ticker UNION ALL SELECT 'union', date FROM (SELECT * FROM a UNION SELECT * FROM b)
  UNION ALL SELECT 'both', date FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first_alone', date FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) SELECT part, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM u GROUP BY part""",
}
