"""Queries of quotes, bars and sessions over ``events``, as tables; streams run the same plans. SQL checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.streaming import quotes
from tidemark.streaming.bars import event_bars


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def quote_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each user as a quote, against the mean of all earlier days, and whether it is from the last six hours."""
    events = _events(spark, sf_dir).select(F.col("user_id").alias("ticker"), "ts", F.col("event_id").alias("quote_id"), F.col("value").alias("price"))
    closes = events.where("ts < timestamp'2024-01-20'").groupBy("ticker").agg(F.avg("price").alias("prior"))
    now = events.agg(F.max("ts").alias("now"))
    found = quotes.with_change(quotes.latest_quotes(events), closes).crossJoin(F.broadcast(now))
    return rounded(quotes.freshness(found, F.col("now"), 360).select("ticker", "price", "ts", "n", "change_pct", "live"), "price", "change_pct")


def five_minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(_events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "5 minutes")
    return rounded(bars.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")), "open", "high", "low", "close")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events less than six hours apart."""
    found = quotes.sessions_of(_events(spark, sf_dir).select("user_id", "ts", "value"), "6 hours")
    return rounded(found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n", "total"), "total")


def sliding_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over two days, begun anew each day."""
    events = _events(spark, sf_dir).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    found = events.groupBy("event_type", F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rounded(found.select("event_type", F.to_date("w.start").alias("date"), "n", "mean"), "mean")


QUERIES = {q.__name__: q for q in (quote_table, five_minute_bars, user_sessions, sliding_means)}

ORACLES = {
    "quote_table": f"""WITH l AS (SELECT user_id AS ticker, last(value ORDER BY ts, event_id) AS price, max(ts) AS ts, count(*) AS n FROM events GROUP BY 1), p AS (SELECT user_id AS ticker, avg(value) AS prior FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1),
q AS (SELECT l.ticker, price, ts, n, price / nullif(prior, 0) * 100 - 100 AS change_pct, ts >= (SELECT max(ts) FROM events) - INTERVAL 360 MINUTE AS live FROM l LEFT JOIN p ON l.ticker = p.ticker) SELECT ticker, ts, n, live, {round_sql(('price', 'change_pct'))} FROM q""",
    "five_minute_bars": f"""WITH b AS (SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, start, n, {round_sql(('open', 'high', 'low', 'close'))} FROM b""",
    "user_sessions": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
a AS (SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k) SELECT user_id, start, n, {round_sql(('total',))} FROM a""",
    "sliding_means": f"""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, value FROM events), w AS (SELECT event_type, day AS date, value FROM d UNION ALL SELECT event_type, day - 1, value FROM d), a AS (SELECT event_type, date, count(*) AS n, avg(value) AS mean FROM w GROUP BY ALL) SELECT event_type, date, n, {round_sql(('mean',))} FROM a""",
}
