"""Queries of filters on the best-ranked names: what each adds on the first half of the dates, and what is left on the second.
The SQL reads other queries' SQL, so it is made from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import filters, order
from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.sources.staging import staged

#: Sessions that a name is held, and the least rank.
HOLD, TOP = 10, 0.9
FEATURES = ("px_to_sma_20", "px_to_sma_50", "vol_20d", "range_position_52w", "volume_ratio_20", "vol_ratio_5_20", "ret_5d")
SHOWN = ("per_day", "win", "mean", "median")
# Names and thresholds of the filters, as SQL that both engines read; MEDIAN is the first half's.
RULES = {
    "uptrend: px > 20d SMA": "px_to_sma_20 > 0",
    "uptrend: px > 50d SMA": "px_to_sma_50 > 0",
    "strong trend: ADX > 25": "adx_14 > 25",
    "not overbought: RSI < 70": "rsi_14 < 70",
    "oversold: RSI < 40": "rsi_14 < 40",
    "high delivery: z > 0": "delivery_pct_z20 > 0",
    "high delivery: pct > 60%": "delivery_pct > 0.60",
    "low vol (bottom half)": "vol_20d < MEDIAN",
    "high vol (top half)": "vol_20d > MEDIAN",
    "low beta < 1": "beta_60d < 1.0",
    "not near 52w high": "range_position_52w < 0.8",
    "near 52w high": "range_position_52w > 0.8",
    "volume confirm: >1.2x avg": "volume_ratio_20 > 1.2",
    "calm regime: vol_ratio < 1": "vol_ratio_5_20 < 1.0",
    "broad market: breadth > 0.5": "market_breadth > 0.5",
}


def _top(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    """Best-ranked rows with an outcome after HOLD sessions, their half of the dates, and the filters."""
    from tidemark.plans import catalog

    q, keys = catalog.QUERIES, ["ticker", "date"]
    bars = catalog.daily_bars(spark, sf_dir).select(*keys, F.round("delivery_pct", 6).alias("delivery_pct"), F.round(catalog.panel.forward_return(HOLD), 6).alias("fwd"))
    rows = q["price_feature_panel"](spark, sf_dir).select(*keys, *FEATURES).join(bars, keys)
    for name, columns in (("oscillator_panel", ("adx_14", "rsi_14")), ("microstructure_panel", ("delivery_pct_z20",)), ("beta_panel", ("beta_60d",)), ("cross_section_panel", ("xs_rank", "market_breadth"))):
        rows = rows.join(q[name](spark, sf_dir).select(*keys, *columns), keys)
    rows = filters.halves(rows)
    top = staged(rows.where((F.col("xs_rank") >= TOP) & F.col("fwd").isNotNull()))
    median = order.exact_quantiles(top.where("half = 'A'"), ("vol_20d",), (0.5,))["vol_20d"][0]
    return top, {name: F.expr(rule.replace("MEDIAN", repr(median) if median is not None else "NULL")) for name, rule in RULES.items()}


def filter_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filter on the first half: rows, hit rate, outcomes, and how much the hit rate is above that of all top rows."""
    top, rules = _top(spark, sf_dir)
    return rounded(filters.lifts(top.where("half = 'A'"), rules, "fwd"), *SHOWN, "lift")


def best_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three filters of most lift on the first half, one, two and three together, on both halves; three is the report's size."""
    top, rules = _top(spark, sf_dir)
    return rounded(filters.combined(top, rules, "fwd", 3), *SHOWN)


QUERIES = {q.__name__: q for q in (filter_lift, best_filters)}


def oracles(others: dict[str, str]) -> dict[str, str]:
    """``others`` has the SQL of the panels that the filters read."""
    sub = lambda name: f"({others[name]})"
    rules = ", ".join(f"struct_pack(rule := '{n}', held := {r.replace('MEDIAN', 'cut')})" for n, r in RULES.items())
    base = f"""WITH f AS {sub('price_feature_panel')}, o AS {sub('oscillator_panel')}, m AS {sub('microstructure_panel')}, b AS {sub('beta_panel')}, c AS {sub('cross_section_panel')}, d AS {sub('daily_bar_table')},
y AS (SELECT ticker, date, round(delivery_pct, 6) AS delivery_pct, round(lead(close, {HOLD}) OVER (PARTITION BY ticker ORDER BY date) / close - 1, 6) AS fwd FROM d),
x AS (SELECT * FROM f JOIN o USING (ticker, date) JOIN m USING (ticker, date) JOIN b USING (ticker, date) JOIN c USING (ticker, date) JOIN y USING (ticker, date)),
k AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM x)), mid AS (SELECT date AS mid FROM k WHERE i = n // 2),
t AS (SELECT x.*, CASE WHEN date < mid THEN 'A' ELSE 'B' END AS half FROM x, mid WHERE xs_rank >= {TOP} AND fwd IS NOT NULL), cut AS (SELECT median(vol_20d) AS cut FROM t WHERE half = 'A'),
r AS (SELECT ticker, date, half, fwd, u.rule AS rule FROM (SELECT t.ticker, t.date, half, fwd, unnest([{rules}]) AS u FROM t, cut) WHERE u.held)"""
    stats = "count(*) AS n, count(*) / CAST(count(DISTINCT date) AS DOUBLE) AS per_day, avg(CAST(fwd > 0 AS INT)) AS win, avg(fwd) AS mean, median(fwd) AS median"
    return {
        "filter_lift": f"""{base}, z AS (SELECT avg(CAST(fwd > 0 AS INT)) AS whole FROM t WHERE half = 'A'), g AS (SELECT rule, {stats} FROM r WHERE half = 'A' GROUP BY rule HAVING count(*) >= 30), l AS (SELECT *, win - whole AS lift FROM g, z)
SELECT rule, n, {round_sql((*SHOWN, 'lift'))} FROM l""",
        "best_filters": f"""{base}, g AS (SELECT rule, avg(CAST(fwd > 0 AS INT)) AS win FROM r WHERE half = 'A' GROUP BY rule HAVING count(*) >= 30), best AS (SELECT rule, row_number() OVER (ORDER BY round(win, 12) DESC, rule) AS place FROM g QUALIFY place <= 3),
h AS (SELECT ticker, date, half, fwd, list(place) AS places FROM r JOIN best USING (rule) GROUP BY ALL), w AS (SELECT size, half, date, fwd FROM h, range(1, 4) s(size) WHERE len(list_filter(places, lambda p: p <= size)) = size
  UNION ALL SELECT 0, half, date, fwd FROM t), v AS (SELECT size, half, {stats} FROM w GROUP BY size, half HAVING count(*) >= 30),
nm AS (SELECT size, string_agg(rule, ' + ' ORDER BY place) AS rules FROM best, range(1, 4) s(size) WHERE place <= size GROUP BY size)
SELECT CAST(v.size AS INTEGER) AS size, coalesce(rules, '') AS rules, half, n, {round_sql(SHOWN)} FROM v LEFT JOIN nm ON nm.size = v.size""",
    }
