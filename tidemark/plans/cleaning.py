"""Queries of parsing, cleaning and data quality, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import change
from tidemark.operators import cleaning
from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.sources.bars import BARS_SQL, daily_bars

CLEAN = ("close", "volume", "typical_price", "price_range", "range_pct")
SCALED = ("ret_5d", "volume", "delivery_pct")
_T = "(PARTITION BY ticker ORDER BY date)"


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with repeated rows and holes: every tenth day comes twice, closes and volumes are missing on some days."""
    day = F.dayofmonth("date")
    bars = daily_bars(spark, sf_dir).select("ticker", "date", "open", "high", "low", "close", "volume")
    twice = bars.where(day % 10 == 0).withColumns({"close": F.col("close") * 2, "ingest": F.lit(2)})
    return bars.withColumns({"close": F.when(day % 6 != 0, F.col("close")), "volume": F.when(day % 7 != 0, F.col("volume")), "ingest": F.lit(1)}).unionByName(twice)


_HOLED = f"""WITH {BARS_SQL}, raw AS (SELECT ticker, date, open, high, low, CASE WHEN day(date) % 6 <> 0 THEN close END AS close, CASE WHEN day(date) % 7 <> 0 THEN volume END AS volume, 1 AS ingest FROM bars
  UNION ALL SELECT ticker, date, open, high, low, close * 2, volume, 2 FROM bars WHERE day(date) % 10 = 0)"""


def cleaned_bar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.cleaned_bars(_holed(spark, sf_dir))
    return rounded(rows.select("ticker", "date", *CLEAN, "volume_missing", "weekday", "month", "year"), *CLEAN)


def bar_profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.bar_profile(_holed(spark, sf_dir).where("ingest = 1"))


def parsed_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange files as strings, with padded headers and values, dashes, other series and repeated keys."""
    bars = daily_bars(spark, sf_dir)
    k = F.dayofmonth("date")
    raw = bars.select(
        F.concat(F.lit(" "), "ticker", F.lit(" ")).alias(" SYMBOL"), F.when(k % 11 == 0, F.lit(" GB")).otherwise(F.lit(" EQ")).alias(" SERIES"), F.date_format("date", " dd-MMM-yyyy").alias(" DATE"),
        F.when(k % 5 == 0, F.lit(" - ")).otherwise(F.concat(F.lit(" "), F.col("volume").cast("long").cast("string"))).alias(" TTL_TRD_QNTY"),
        F.when(k % 3 == 0, F.lit("-")).otherwise(F.floor(F.col("volume") / 2).cast("string")).alias(" DELIV_QTY"), F.lit(" 40 ").alias(" DELIV_PER"), F.lit(1).alias("row_no"),
    )
    again = raw.where(k % 4 == 0).withColumns({"row_no": F.lit(2), " DELIV_PER": F.lit("90")})
    return rounded(cleaning.parsed_microstructure(raw.unionByName(again)), "traded_qty", "delivered_qty", "delivered_share")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("date")
    rows = daily_bars(spark, sf_dir).withColumn("ret_5d", change(F.col("close"), 5))
    return rows.withColumns({"volume": F.when(day % 9 == 0, float("inf")).otherwise(F.col("volume")), "delivery_pct": F.when(day % 4 != 0, F.col("delivery_pct"))})


_FEATURES = f"""WITH {BARS_SQL}, r AS (SELECT ticker, date, sector, close / lag(close, 5) OVER {_T} - 1 AS ret_5d, CASE WHEN day(date) % 9 <> 0 THEN volume END AS volume, CASE WHEN day(date) % 4 <> 0 THEN delivery_pct END AS delivery_pct,
  row_number() OVER {_T} AS k FROM bars)"""


def imputed_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.standardised(cleaning.imputed(cleaning.warmed(_features(spark, sf_dir)), SCALED), SCALED)
    return rounded(rows.select("ticker", "date", *SCALED), *SCALED)


def imputed_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("ret_5d", "delivery_pct")
    return rounded(cleaning.imputed_by_date(_features(spark, sf_dir), names).select("ticker", "date", *names), *names)


def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir).withColumn("volume", cleaning.finite("volume"))
    names = tuple(c for c in cleaning.numeric_features(rows, prefixes=("turn", "n_")) if c not in ("open", "high", "low"))
    if empty := cleaning.empty_features(rows, names):
        raise ValueError(f"features without values: {empty}")
    return rounded(cleaning.feature_statistics(rows, names), "mean", "std", "min", "q25", "q50", "q75", "max", "missing_share")


QUERIES = {q.__name__: q for q in (cleaned_bar_table, bar_profile_table, parsed_delivery, imputed_standardised, imputed_per_date, feature_summary)}

ORACLES = {
    "cleaned_bar_table": f"""{_HOLED}, o AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY ingest) = 1),
f AS (SELECT ticker, date, high, low, coalesce(close, lag(close, 1) OVER {_T}, lag(close, 2) OVER {_T}) AS close, coalesce(volume, 0) AS volume, CAST(volume IS NULL AS INT) AS volume_missing FROM o),
g AS (SELECT *, (high + low + close) / 3 AS typical_price, high - low AS price_range, (high - low) / close AS range_pct FROM f WHERE close IS NOT NULL)
SELECT ticker, date, {round_sql(CLEAN)}, volume_missing, CAST(isodow(date) - 1 AS INT) AS weekday, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year FROM g""",
    "bar_profile_table": f"""{_HOLED}, g AS (SELECT *, date - lag(date) OVER {_T} AS gap FROM raw WHERE ingest = 1)
SELECT ticker, count(*) AS n_rows, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS n_missing_price, count(*) FILTER (volume = 0) AS n_zero_volume, CAST(max(gap) AS INT) AS max_gap_days FROM g GROUP BY ticker""",
    "parsed_delivery": f"""WITH {BARS_SQL}, t AS (SELECT ticker AS symbol, date, CASE WHEN day(date) % 5 <> 0 THEN floor(volume) END AS traded_qty, CASE WHEN day(date) % 3 <> 0 THEN floor(volume / 2) END AS delivered_qty FROM bars WHERE day(date) % 11 <> 0),
u AS (SELECT *, coalesce(delivered_qty / traded_qty, 0.4) AS delivered_share FROM t) SELECT symbol, date, {round_sql(('traded_qty', 'delivered_qty', 'delivered_share'))} FROM u""",
    "imputed_standardised": f"""{_FEATURES}, w AS (SELECT * FROM r WHERE k > 30), m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in SCALED)} FROM w), i AS (SELECT ticker, date, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in SCALED)} FROM w, m),
s AS (SELECT {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}' for c in SCALED)} FROM i), z AS (SELECT ticker, date, {', '.join(f'({c} - a_{c}) / coalesce(nullif(s_{c}, 0), 1) AS {c}' for c in SCALED)} FROM i, s) SELECT ticker, date, {round_sql(SCALED)} FROM z""",
    "imputed_per_date": f"""{_FEATURES}, m AS (SELECT date, median(ret_5d) AS m1, median(delivery_pct) AS m2 FROM r GROUP BY date)
SELECT ticker, date, round(1.2345678e-7 + coalesce(ret_5d, m1, 0), 6) + 0.0 AS ret_5d, round(1.2345678e-7 + coalesce(delivery_pct, m2, 0), 6) + 0.0 AS delivery_pct FROM r JOIN m USING (date)""",
    "feature_summary": f"""WITH {BARS_SQL}, r AS (SELECT close, CASE WHEN day(date) % 9 <> 0 THEN volume END AS volume, CASE WHEN day(date) % 4 <> 0 THEN delivery_pct END AS delivery_pct, close / lag(close, 5) OVER {_T} - 1 AS ret_5d FROM bars),
u AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS value FROM r" for c in ('close', 'volume', 'delivery_pct', 'ret_5d'))}),
g AS (SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS max, count(*) - count(value) AS n_missing, avg(CAST(value IS NULL AS INT)) AS missing_share FROM u GROUP BY feature)
SELECT feature, n, n_missing, {round_sql(('mean', 'std', 'min', 'q25', 'q50', 'q75', 'max', 'missing_share'))} FROM g""",
}
