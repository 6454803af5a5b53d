"""Queries of as-of joins against tables of dates, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import order
from tidemark.sources.bars import BARS_SQL, daily_bars


def _peaks(bars: DataFrame) -> DataFrame:
    """``ticker, peak``: the day of most turnover of each ticker and month, the first of equals; a calendar per ticker."""
    best = Window.partitionBy("ticker", F.trunc("date", "month")).orderBy(F.desc("turnover"), "date")
    return bars.withColumn("n", F.row_number().over(best)).where("n = 1").select("ticker", F.col("date").alias("peak"))


def _with_days(rows: DataFrame) -> DataFrame:
    days = F.datediff("peak", "date")
    return rows.select("ticker", "date", "peak", days.alias("days_to_peak"), (days <= 5).cast("int").alias("is_peak_week"))


def next_peak_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to the next peak of the ticker's own calendar, 0 on the day; past the last one days since it, negative."""
    bars = daily_bars(spark, sf_dir)
    return _with_days(order.next_event(bars.select("ticker", "date"), _peaks(bars), "ticker", "date", "peak", clip=True))


def next_customer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every shipped line the next order of the same customer at or after the day of shipping; grows with the tables."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("next_order"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("shipped"))
    rows = lines.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return order.next_event(rows, orders, "o_custkey", "shipped", "next_order").withColumn("wait", F.datediff("next_order", "shipped"))


QUERIES = {q.__name__: q for q in (next_peak_day, next_customer_order)}
ORACLES = {
    "next_peak_day": f"""WITH {BARS_SQL}, p AS (SELECT ticker, date AS peak FROM bars QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY turnover DESC, date) = 1), l AS (SELECT ticker, max(peak) AS last FROM p GROUP BY ticker),
n AS (SELECT b.ticker, b.date, p.peak FROM bars b ASOF LEFT JOIN p ON b.ticker = p.ticker AND b.date <= p.peak), d AS (SELECT n.ticker, date, coalesce(peak, last) AS peak FROM n JOIN l ON l.ticker = n.ticker)
SELECT ticker, date, peak, CAST(peak - date AS INTEGER) AS days_to_peak, CAST(peak - date <= 5 AS INTEGER) AS is_peak_week FROM d""",
    "next_customer_order": """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), d AS (SELECT DISTINCT o_custkey, day FROM o),
s AS (SELECT o.o_custkey, l_orderkey AS o_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS shipped FROM lineitem JOIN o ON o_orderkey = l_orderkey)
SELECT s.*, d.day AS next_order, CAST(d.day - shipped AS INTEGER) AS wait FROM s ASOF LEFT JOIN d ON s.o_custkey = d.o_custkey AND s.shipped <= d.day""",
}
