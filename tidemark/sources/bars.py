"""Daily bars per ticker from trade-like rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, sector, date, open, high, low, close, volume, n_trades, turnover, delivery_pct``.

    Five columns of ``lineitem`` are read; partial aggregates combine before the one shuffle. ``part`` is joined as
    Spark sees fit: it is broadcast only below the session's threshold.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", F.to_date("l_shipdate").alias("date"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    rows = lines.join(part, "l_partkey").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
    bars = rows.groupBy("ticker", "date").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("l_quantity").alias("volume"), F.count("*").alias("n_trades"), F.sum("l_extendedprice").alias("turnover"),
        (F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("delivery_pct"),
    )
    return bars.select("ticker", F.substring("ticker", 1, 7).alias("sector"), "date", "open", "high", "low", "close", "volume", "n_trades", "turnover", "delivery_pct")


BARS_SQL = """bars AS (
  SELECT p_brand AS ticker, substr(p_brand, 1, 7) AS sector, CAST(l_shipdate AS DATE) AS date,
    first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price) AS close,
    sum(l_quantity) AS volume, count(*) AS n_trades, sum(l_extendedprice) AS turnover,
    sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS delivery_pct
  FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL)"""
