"""Queries of nearest neighbours and local outliers, with the SQL that checks them: all pairs, written by the definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import change
from tidemark.operators import neighbours
from tidemark.plans.rounding import OFF_TIES
from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.sources.bars import BARS_SQL, daily_bars
from tidemark.sources.staging import staged

WEEKLY = ("ret", "span", "volume", "n_trades", "delivery")
CUSTOMER = ("balance", "n_orders", "mean_price", "max_price")
KS = (10, 20, 50)
FACTORS = tuple(f"lof_{k}" for k in KS)


def standard(rows: DataFrame, *names: str) -> DataFrame:
    """Columns less their mean over their deviation, to six digits, so that engines agree on them to the last bit."""
    stats = rows.agg(*[how(n).alias(f"{n}_{name}") for n in names for name, how in (("mean", F.avg), ("sd", F.stddev_pop))])
    scaled = rows.join(F.broadcast(stats))  # a row
    return rounded(scaled.withColumns({n: F.coalesce(F.try_divide(F.col(n) - F.col(f"{n}_mean"), F.col(f"{n}_sd")), F.lit(0.0)) for n in names}), *names).drop(*stats.columns)


def standard_sql(names: tuple[str, ...]) -> str:
    return ", ".join(f"round(coalesce(({n} - avg({n}) OVER ()) / nullif(stddev_pop({n}) OVER (), 0), 0) + {OFF_TIES}, 6) + 0.0 AS {n}" for n in names)


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir).groupBy("ticker", F.date_trunc("week", "date").cast("date").alias("week"))
    return bars.agg(
        (F.max_by("close", "date") / F.min_by("open", "date") - 1).alias("ret"), (F.max("high") / F.min("low") - 1).alias("span"),
        F.sum("volume").cast("double").alias("volume"), F.sum("n_trades").cast("double").alias("n_trades"), F.avg("delivery_pct").alias("delivery"),
    )


def weekly_outlier_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local outlier factors of all weeks of all tickers by 10, 20 and 50 neighbours."""
    rows = standard(weekly_bars(spark, sf_dir), *WEEKLY)
    return rounded(neighbours.outlier_factors(rows, WEEKLY, KS).select("ticker", "week", *FACTORS), *FACTORS, digits=5)


def customer_outlier_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local outlier factors of all customers by balance and orders; grows with the tables."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey"))
    orders = orders.agg(F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_acctbal").alias("balance")).join(orders, "c_custkey", "left").fillna(0.0)
    return rounded(neighbours.outlier_factors(standard(staged(rows), *CUSTOMER), CUSTOMER, KS).select("c_custkey", *FACTORS), *FACTORS, digits=5)


def nearest_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest earlier pattern in a ticker's whole history."""
    rows = daily_bars(spark, sf_dir).withColumn("ret_1d", change(F.col("close"), 1))
    return rounded(neighbours.nearest_pattern(rows).select("ticker", "date", "pattern_similarity_score"), "pattern_similarity_score")


QUERIES = {q.__name__: q for q in (weekly_outlier_factors, customer_outlier_factors, nearest_patterns)}


def _factors_sql(names: tuple[str, ...]) -> str:
    """Factors of ``v(id, *names)`` by all pairs: neighbours by distance, then by values, as ``id`` numbers them."""
    d2 = " + ".join(f"(a.{n} - b.{n}) * (a.{n} - b.{n})" for n in names)
    first = f"p AS (SELECT a.id, unnest(min(struct_pack(d2 := {d2}, o := b.id), {max(KS)})) AS e FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id), n AS (SELECT id, e.o AS o, sqrt(e.d2) AS d, row_number() OVER (PARTITION BY id ORDER BY e.d2, e.o) AS pos FROM p)"
    steps = "".join(
        f""", k{k} AS (SELECT * FROM n WHERE pos <= {k}), h{k} AS (SELECT id AS o, max(d) AS reach FROM k{k} GROUP BY id), d{k} AS (SELECT id, 1 / (avg(greatest(d, reach)) + 1e-10) AS density FROM k{k} JOIN h{k} USING (o) GROUP BY id),
f{k} AS (SELECT k{k}.id, avg(t.density) / any_value(m.density) AS lof_{k} FROM k{k} JOIN d{k} t ON t.id = k{k}.o JOIN d{k} m ON m.id = k{k}.id GROUP BY k{k}.id)"""
        for k in KS
    )
    return first + steps


_FOUND = " ".join(f"LEFT JOIN f{k} ON f{k}.id = v.id" for k in KS)
ORACLES = {
    "weekly_outlier_factors": f"""WITH {BARS_SQL}, w AS (SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS week, arg_max(close, date) / arg_min(open, date) - 1 AS ret, max(high) / min(low) - 1 AS span, CAST(sum(volume) AS DOUBLE) AS volume,
  CAST(sum(n_trades) AS DOUBLE) AS n_trades, avg(delivery_pct) AS delivery FROM bars GROUP BY ALL), z AS (SELECT ticker, week, {standard_sql(WEEKLY)} FROM w), v AS (SELECT *, row_number() OVER (ORDER BY {', '.join(WEEKLY)}) AS id FROM z),
{_factors_sql(WEEKLY)} SELECT ticker, week, {round_sql(FACTORS, 5)} FROM v {_FOUND}""",
    "customer_outlier_factors": f"""WITH o AS (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price, max(o_totalprice) AS max_price FROM orders GROUP BY o_custkey),
c AS (SELECT c_custkey, c_acctbal AS balance, coalesce(n_orders, 0) AS n_orders, coalesce(mean_price, 0) AS mean_price, coalesce(max_price, 0) AS max_price FROM customer LEFT JOIN o ON o_custkey = c_custkey),
z AS (SELECT c_custkey, {standard_sql(CUSTOMER)} FROM c), v AS (SELECT *, row_number() OVER (ORDER BY {', '.join(CUSTOMER)}) AS id FROM z), {_factors_sql(CUSTOMER)} SELECT c_custkey, {round_sql(FACTORS, 5)} FROM v {_FOUND}""",
    "nearest_patterns": f"""WITH {BARS_SQL}, r AS (SELECT ticker, date, coalesce(close / lag(close) OVER w - 1, 0) AS x, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
p AS (SELECT ticker, date, i - 10 AS p, list(x) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS pattern FROM r QUALIFY i >= 10),
n AS (SELECT a.ticker, a.date, min(list_distance(a.pattern, b.pattern)) AS d FROM p a JOIN p b ON a.ticker = b.ticker AND b.p < a.p - 5 WHERE a.p >= 20 GROUP BY ALL)
SELECT r.ticker, r.date, round(d + {OFF_TIES}, 6) + 0.0 AS pattern_similarity_score FROM r LEFT JOIN n ON n.ticker = r.ticker AND n.date = r.date""",
}
