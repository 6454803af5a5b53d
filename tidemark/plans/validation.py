"""Queries of validation reports, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import change
from tidemark.operators import panel, validation
from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.sources.bars import BARS_SQL, daily_bars

FLAGS = ("flag_a", "flag_b", "flag_c")
SCORES = ("score_a", "score_b", "score_c", "score_d")
_T = "(PARTITION BY ticker ORDER BY date)"
_R = f"""WITH {BARS_SQL}, r AS (SELECT *, close / lag(close) OVER {_T} - 1 AS ret_1d, close / lag(close, 5) OVER {_T} - 1 AS ret_5d, lead(close, 3) OVER {_T} / close - 1 AS fwd_3d, lead(close, 5) OVER {_T} / close - 1 AS fwd_5d FROM bars),
f AS (SELECT *, CASE WHEN volume > 60 THEN 1 ELSE 0 END AS flag_a, CASE WHEN abs(ret_1d) > 0.5 THEN 1 ELSE 0 END AS flag_b, CASE WHEN delivery_pct < 0.2 THEN 1 ELSE 0 END AS flag_c,
  volume AS score_a, abs(ret_1d) AS score_b, -delivery_pct AS score_c, 1e0 AS score_d, CASE WHEN day(date) >= 25 THEN 1 ELSE 0 END AS expiry_week FROM r)"""


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("close")
    rows = daily_bars(spark, sf_dir).withColumns({"ret_1d": change(c, 1), "ret_5d": change(c, 5), "fwd_3d": panel.forward_return(3), "fwd_5d": panel.forward_return(5)})
    flag = lambda x: F.when(x, 1).otherwise(0)
    return rows.withColumns({
        "flag_a": flag(F.col("volume") > 60), "flag_b": flag(F.abs("ret_1d") > 0.5), "flag_c": flag(F.col("delivery_pct") < 0.2),
        "score_a": F.col("volume"), "score_b": F.abs("ret_1d"), "score_c": -F.col("delivery_pct"), "score_d": F.lit(1.0), "expiry_week": flag(F.dayofmonth("date") >= 25),
    })


def flag_rates_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tuple(f"{f}_rate" for f in FLAGS)
    return rounded(validation.flag_rates(flagged(spark, sf_dir), FLAGS, "ticker"), *names)


def flag_rates_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers without a category in the dimension are "Other"."""
    categories = spark.sql("SELECT * FROM VALUES ('Brand#1', 'large'), ('Brand#2', 'large'), ('Brand#3', 'mid') AS t(sector, category)")
    rows = flagged(spark, sf_dir).join(categories, "sector", "left").withColumn("category", F.coalesce("category", F.lit("Other")))
    return rounded(validation.flag_rates(rows, FLAGS, "category"), *[f"{f}_rate" for f in FLAGS])


def flags_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flagged(spark, sf_dir).groupBy(F.month("date").alias("month")).agg(F.avg("flag_a").alias("mean"), F.sum("flag_a").alias("sum"), F.count("*").alias("n"))
    return rounded(found, "mean")


def effect_size_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features of the largest effect; ten is the report's size."""
    found = validation.effect_sizes(flagged(spark, sf_dir), "flag_a", ("ret_1d", "ret_5d", "delivery_pct", "n_trades", "close"))
    return rounded(found.orderBy(F.desc(F.abs("cohens_d")), "feature").limit(10), "flagged_mean", "other_mean", "cohens_d")


def flag_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.jaccard(flagged(spark, sf_dir), FLAGS), "jaccard")


def score_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.spearman_matrix(flagged(spark, sf_dir), SCORES), "rho")


def high_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validation.agreement(flagged(spark, sf_dir), FLAGS, SCORES).where("agreement_count >= 2")
    found = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("combined_score").alias("mean_score"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return rounded(found, "mean_score")


def agreement_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.agreement(flagged(spark, sf_dir), FLAGS, SCORES).groupBy("agreement_count", "consensus").agg(F.count("*").alias("n"), F.avg("combined_score").alias("mean_score"))
    return rounded(found, "mean_score")


GAPS = ("mean_gap", "median_gap", "std_gap", "cov")


def event_gap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.event_gaps(flagged(spark, sf_dir), "flag_a"), *GAPS)


def expiry_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.two_proportions(flagged(spark, sf_dir), "flag_b", "expiry_week"), "rate1", "rate0", "ratio", "z", "p_value")


def expiry_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.rank_sum(flagged(spark, sf_dir), "delivery_pct", "expiry_week"), "u", "z", "p_less", "auc")


def heaviest_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as options: the symbol is the brand, the strike a rounded price, the open interest a quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.expr("l_partkey = p_partkey"))
    options = lines.select(F.col("p_brand").alias("symbol"), F.date_trunc("month", "l_shipdate").cast("date").alias("date"), (F.floor(F.col("p_retailprice") / 50) * 50).alias("strike"), F.col("l_quantity").alias("open_interest"))
    return rounded(validation.heaviest_strike(options), "open_interest")


def balanced_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir).withColumn("target", panel.return_class(F.col("fwd_3d")))
    return rounded(validation.class_weights(rows.where("target <> 3"), "target"), "weight")


def decile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.deciles(flagged(spark, sf_dir), "ret_5d", "fwd_3d"), "mean_ret")


MOMENTS = ("mean", "std", "sharpe", "skew", "kurtosis", "p5", "p50", "p75", "p90", "p95", "cvar", "psr", "dsr")


def market_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = flagged(spark, sf_dir).groupBy("date").agg(F.avg("ret_1d").alias("market"))
    return rounded(validation.moments(days, "market", trials=12), *MOMENTS)


def breadth_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = flagged(spark, sf_dir).groupBy("date").agg(F.avg("ret_1d").alias("market"), F.avg(F.when(F.col("ret_5d") > 0, 1.0).otherwise(0.0)).alias("breadth"))
    return rounded(validation.split_halves(days, "breadth", "market"), "low_half", "high_half", "difference", "corr")


def fama_macbeth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.fama_macbeth(flagged(spark, sf_dir), ("ret_1d", "ret_5d", "delivery_pct", "volume"), "fwd_3d"), "mean_slope", "t")


def rules() -> dict:
    """Named predicates of a row; the SQL has the same ones."""
    return {"rising": F.col("ret_5d") > 0.1, "thin_delivery": F.col("delivery_pct") < 0.3, "heavy": F.col("volume") > 60, "heavy_and_rising": (F.col("volume") > 60) & (F.col("ret_1d") > 0), "flat": F.abs("ret_1d") < 0.05}


def rule_outcome_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.rule_outcomes(flagged(spark, sf_dir), rules(), ("fwd_3d", "fwd_5d")), "per_day", "win_rate", "mean_ret", "median_ret")


def inverse_volatility_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each date's mean outcome weighted by the inverse of the day's range."""
    rows = flagged(spark, sf_dir).where("fwd_3d is not null and high > low").withColumn("vol", F.col("high") / F.col("low") - 1)
    found = rows.groupBy("date").agg(F.count_distinct("ticker").alias("n_tickers"), (F.sum(F.col("fwd_3d") / F.col("vol")) / F.sum(1 / F.col("vol"))).alias("weighted_ret"))
    return rounded(found, "weighted_ret")


QUERIES = {
    q.__name__: q
    for q in (
        flag_rates_by_ticker, flag_rates_by_category, flags_by_month, effect_size_table, flag_jaccard, score_spearman, high_confidence, agreement_table, event_gap_table, expiry_proportions, expiry_rank_sum,
        heaviest_strikes, balanced_class_weights, decile_returns, market_moments, breadth_halves, fama_macbeth_table, rule_outcome_table, inverse_volatility_returns,
    )
}


def _tail(z: str) -> str:
    t = f"(1 / (1 + 0.2316419e0 * {z}))"
    return f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) * ((((1.330274429e0 * {t} - 1.821255978e0) * {t} + 1.781477937e0) * {t} - 0.356563782e0) * {t} + 0.319381530e0) * {t}"


def _below(z: str) -> str:
    return f"CASE WHEN {z} >= 0 THEN 1 - {_tail(f'abs({z})')} ELSE {_tail(f'abs({z})')} END"


_RATES = ", ".join(f"round(1.2345678e-7 + avg({f}), 6) + 0.0 AS {f}_rate" for f in FLAGS)
_EFFECTS = " UNION ALL ".join(f"SELECT '{c}' AS feature, flag_a AS y, CAST({c} AS DOUBLE) AS v FROM f" for c in ("ret_1d", "ret_5d", "delivery_pct", "n_trades", "close"))
_JACCARD = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, coalesce(count(*) FILTER ({a} = 1 AND {b} = 1) / nullif(count(*) FILTER ({a} = 1 OR {b} = 1), 0), {int(a == b)}) AS jaccard FROM f" for a in FLAGS for b in FLAGS)
_RANKS = ", ".join(f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS {s}" for s in SCORES)
_RHO = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0) AS rho FROM k" for a in SCORES for b in SCORES)
_AGREE = f"""{_R}, b AS (SELECT {', '.join(f'min({s}) AS lo_{s}, max({s}) AS hi_{s}' for s in SCORES)} FROM f), g AS (SELECT f.*, flag_a + flag_b + flag_c AS agreement_count, CAST(flag_a + flag_b + flag_c >= 2 AS INT) AS consensus,
  ({' + '.join(f'CASE WHEN hi_{s} > lo_{s} THEN ({s} - lo_{s}) / (hi_{s} - lo_{s}) ELSE 0 END' for s in SCORES)}) / 4 AS combined_score FROM f, b)"""
_CLASS = "CASE WHEN fwd_3d > 0.03 THEN 4 WHEN fwd_3d > 0.01 THEN 3 WHEN fwd_3d >= -0.01 THEN 2 WHEN fwd_3d >= -0.03 THEN 1 WHEN fwd_3d < -0.03 THEN 0 END"
_RULES = {"rising": "ret_5d > 0.1", "thin_delivery": "delivery_pct < 0.3", "heavy": "volume > 60", "heavy_and_rising": "volume > 60 AND ret_1d > 0", "flat": "abs(ret_1d) < 0.05"}
_HITS = " UNION ALL ".join(f"SELECT '{n}' AS rule, date, '{h}' AS horizon, {h} AS ret FROM f WHERE ({p}) AND {h} IS NOT NULL" for n, p in _RULES.items() for h in ("fwd_3d", "fwd_5d"))
_FM = " UNION ALL ".join(f"SELECT '{c}' AS feature, date, {c} AS x, fwd_3d AS y FROM f WHERE {c} IS NOT NULL AND fwd_3d IS NOT NULL" for c in ("ret_1d", "ret_5d", "delivery_pct", "volume"))
ORACLES = {
    "flag_rates_by_ticker": f"{_R} SELECT ticker, count(*) AS n, {_RATES} FROM f GROUP BY ticker",
    "flag_rates_by_category": f"{_R} SELECT CASE WHEN sector IN ('Brand#1', 'Brand#2') THEN 'large' WHEN sector = 'Brand#3' THEN 'mid' ELSE 'Other' END AS category, count(*) AS n, {_RATES} FROM f GROUP BY 1",
    "flags_by_month": f"{_R} SELECT CAST(month(date) AS INT) AS month, round(1.2345678e-7 + avg(flag_a), 6) + 0.0 AS mean, CAST(sum(flag_a) AS BIGINT) AS sum, count(*) AS n FROM f GROUP BY 1",
    "effect_size_table": f"""{_R}, u AS ({_EFFECTS}), g AS (SELECT feature, avg(v) FILTER (y = 1) AS flagged_mean, avg(v) FILTER (y = 0) AS other_mean, sqrt((var_samp(v) FILTER (y = 1) + var_samp(v) FILTER (y = 0)) / 2) AS sd FROM u GROUP BY feature)
SELECT feature, round(1.2345678e-7 + flagged_mean, 6) + 0.0 AS flagged_mean, round(1.2345678e-7 + other_mean, 6) + 0.0 AS other_mean, round(1.2345678e-7 + (flagged_mean - other_mean) / nullif(sd, 0), 6) + 0.0 AS cohens_d FROM g""",
    "flag_jaccard": f"{_R}, j AS ({_JACCARD}) SELECT a, b, round(1.2345678e-7 + jaccard, 6) + 0.0 AS jaccard FROM j",
    "score_spearman": f"{_R}, k AS (SELECT {_RANKS} FROM f WHERE score_b IS NOT NULL), m AS ({_RHO}) SELECT a, b, round(1.2345678e-7 + rho, 6) + 0.0 AS rho FROM m",
    "high_confidence": f"{_AGREE} SELECT ticker, count(*) AS n, round(1.2345678e-7 + avg(combined_score), 6) + 0.0 AS mean_score, min(date) AS first_date, max(date) AS last_date FROM g WHERE agreement_count >= 2 GROUP BY ticker",
    "agreement_table": f"{_AGREE} SELECT agreement_count, consensus, count(*) AS n, round(1.2345678e-7 + avg(combined_score), 6) + 0.0 AS mean_score FROM g GROUP BY ALL",
    "event_gap_table": f"""{_R}, e AS (SELECT ticker, date, date - lag(date) OVER {_T} AS gap FROM f WHERE flag_a = 1), g AS (SELECT ticker, count(*) AS n, avg(gap) AS mean_gap, median(gap) AS median_gap, CAST(min(gap) AS INT) AS min_gap, CAST(max(gap) AS INT) AS max_gap, stddev_samp(gap) AS std_gap, sum(count(*)) OVER () AS total FROM e GROUP BY ticker),
h AS (SELECT *, std_gap / nullif(mean_gap, 0) AS cov FROM g WHERE n >= 3 AND total >= 10) SELECT ticker, n, min_gap, max_gap, {round_sql(GAPS)} FROM h""",
    "expiry_proportions": f"""{_R}, c AS (SELECT count(*) FILTER (expiry_week = 1) AS n1, count(*) FILTER (expiry_week = 0) AS n0, count(*) FILTER (expiry_week = 1 AND flag_b = 1) AS x1, count(*) FILTER (expiry_week = 0 AND flag_b = 1) AS x0 FROM f),
d AS (SELECT *, x1 / n1 AS rate1, x0 / n0 AS rate0, (x1 + x0) / (n1 + n0) AS p FROM c), e AS (SELECT *, rate1 / rate0 AS ratio, (rate1 - rate0) / sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) AS z FROM d), g AS (SELECT *, 2 * {_tail('abs(z)')} AS p_value FROM e)
SELECT n1, n0, x1, x0, {round_sql(('rate1', 'rate0', 'ratio', 'z', 'p_value'))} FROM g""",
    "expiry_rank_sum": f"""{_R}, v AS (SELECT delivery_pct AS x, count(*) FILTER (expiry_week = 1) AS k1, count(*) AS k FROM f GROUP BY 1), w AS (SELECT *, coalesce(sum(k) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS rk FROM v),
s AS (SELECT CAST(sum(k1) AS BIGINT) AS n1, CAST(sum(k - k1) AS BIGINT) AS n0, sum(CAST(rk * k1 AS DOUBLE)) AS r1, sum(CAST(k AS DOUBLE) ** 3 - k) AS ties FROM w), u AS (SELECT *, r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS u, n1 + n0 AS n FROM s),
z AS (SELECT *, (u - CAST(n1 AS DOUBLE) * n0 / 2 + 0.5) / sqrt(CAST(n1 AS DOUBLE) * n0 / 12 * ((n + 1) - ties / (CAST(n AS DOUBLE) * (n - 1)))) AS z FROM u), p AS (SELECT *, {_below('z')} AS p_less, u / (CAST(n1 AS DOUBLE) * n0) AS auc FROM z) SELECT n1, n0, {round_sql(('u', 'z', 'p_less', 'auc'))} FROM p""",
    "heaviest_strikes": """WITH o AS (SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(floor(p_retailprice / 50) * 50 AS BIGINT) AS strike, sum(l_quantity) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT symbol, date, strike, round(1.2345678e-7 + t, 6) + 0.0 AS open_interest FROM o QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY t DESC, strike) = 1""",
    "balanced_class_weights": f"""{_R}, c AS (SELECT {_CLASS} AS class, count(*) AS n FROM f WHERE fwd_3d IS NOT NULL GROUP BY 1), e AS (SELECT CAST(range AS INT) AS class, coalesce(n, 0) AS n FROM range(5) LEFT JOIN c ON c.class = range AND c.class <> 3),
w AS (SELECT *, sum(n) OVER () / nullif(n * count(*) FILTER (n > 0) OVER (), 0) AS raw FROM e) SELECT class, n, round(1.2345678e-7 + coalesce(raw, 0) / avg(raw) OVER (), 6) + 0.0 AS weight FROM w""",
    "decile_returns": f"""{_R}, b AS (SELECT fwd_3d, row_number() OVER (ORDER BY ret_5d, date, ticker) AS rn, count(*) OVER () AS n FROM f WHERE ret_5d IS NOT NULL AND fwd_3d IS NOT NULL)
SELECT CAST(greatest(ceil((rn - 1) * 10e0 / (n - 1) - 1e-9) - 1, 0) AS INT) AS decile, count(*) AS n, round(1.2345678e-7 + avg(fwd_3d), 6) + 0.0 AS mean_ret FROM b GROUP BY 1""",
    "market_moments": f"""{_R}, d AS (SELECT avg(ret_1d) AS x FROM f GROUP BY date HAVING avg(ret_1d) IS NOT NULL), m AS (SELECT avg(x) AS mu FROM d),
s AS (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, avg((x - mu) ** 3) / stddev_pop(x) ** 3 AS skew, avg((x - mu) ** 4) / stddev_pop(x) ** 4 AS kurtosis, {', '.join(f'quantile_cont(x, {p / 100}) AS p{p}' for p in (5, 50, 75, 90, 95))} FROM d, m),
c AS (SELECT avg(x) AS cvar FROM d, s WHERE x <= p5), q AS (SELECT *, mean / std AS sharpe FROM s, c), z AS (SELECT *, sharpe / sqrt((1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe ** 2) / (n - 1)) AS z1 FROM q), y AS (SELECT *, z1 - {validation.expected_best(12)!r} AS z2 FROM z),
o AS (SELECT *, {_below('z1')} AS psr, {_below('z2')} AS dsr FROM y) SELECT n, {round_sql(MOMENTS)} FROM o""",
    "breadth_halves": f"""{_R}, d AS (SELECT avg(ret_1d) AS y, avg(CASE WHEN ret_5d > 0 THEN 1 ELSE 0 END) AS x FROM f GROUP BY date HAVING avg(ret_1d) IS NOT NULL), c AS (SELECT median(x) AS cut FROM d),
h AS (SELECT count(*) AS n, avg(y) FILTER (x <= cut) AS low_half, avg(y) FILTER (x > cut) AS high_half, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS corr FROM d, c) SELECT n, round(1.2345678e-7 + low_half, 6) + 0.0 AS low_half, round(1.2345678e-7 + high_half, 6) + 0.0 AS high_half, round(1.2345678e-7 + high_half - low_half, 6) + 0.0 AS difference, round(1.2345678e-7 + corr, 6) + 0.0 AS corr FROM h""",
    "fama_macbeth_table": f"""{_R}, u AS ({_FM}), s AS (SELECT feature, date, covar_samp(x, y) / stddev_samp(x) AS slope FROM u GROUP BY ALL HAVING count(*) >= 15 AND stddev_samp(x) > 0), e AS (SELECT *, slope - avg(slope) OVER (PARTITION BY feature) AS e FROM s),
g AS (SELECT *, e * lag(e, 1) OVER w AS g1, e * lag(e, 2) OVER w AS g2 FROM e WINDOW w AS (PARTITION BY feature ORDER BY date)), t AS (SELECT feature, count(*) AS n_days, avg(slope) AS mean_slope, sum(e * e) + 4e0 / 3 * coalesce(sum(g1), 0) + 2e0 / 3 * coalesce(sum(g2), 0) AS total FROM g GROUP BY feature HAVING count(*) >= 30)
SELECT feature, n_days, round(1.2345678e-7 + mean_slope, 6) + 0.0 AS mean_slope, round(1.2345678e-7 + mean_slope / sqrt(greatest(total / n_days, 1e-16) / n_days), 6) + 0.0 AS t FROM t""",
    "rule_outcome_table": f"""{_R}, h AS ({_HITS}) SELECT rule, horizon, count(*) AS n, round(1.2345678e-7 + count(*) / count(DISTINCT date), 6) + 0.0 AS per_day, round(1.2345678e-7 + avg(CAST(ret > 0 AS INT)), 6) + 0.0 AS win_rate, round(1.2345678e-7 + avg(ret), 6) + 0.0 AS mean_ret, round(1.2345678e-7 + median(ret), 6) + 0.0 AS median_ret FROM h GROUP BY ALL HAVING count(*) >= 30""",
    "inverse_volatility_returns": f"{_R} SELECT date, count(DISTINCT ticker) AS n_tickers, round(1.2345678e-7 + sum(fwd_3d / (high / low - 1)) / sum(1 / (high / low - 1)), 6) + 0.0 AS weighted_ret FROM f WHERE fwd_3d IS NOT NULL AND high > low GROUP BY date",
}
