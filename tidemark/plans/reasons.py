"""Queries of reasons, with the SQL that checks them. The SQL reads other queries' SQL, so it is made from that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import percent_rank
from tidemark.operators import labels, reasons
from tidemark.operators import panel as panel_operators
from tidemark.plans.rounding import OFF_TIES
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.sources.bars import BARS_SQL, daily_bars

NAMES = ("ret_5d", "px_to_sma_20", "bollinger_z", "vol_20d", "volume_ratio_20", "delivery_pct", "ret_1d", "pct_from_52w_high")
FROM_FEATURES = tuple(n for n in NAMES if n != "delivery_pct")
PARTS = tuple(f"part_{n}" for n in NAMES)


def reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row's score is what it is: the features farthest from the day's mean, in words, for the label of its score."""
    rows = panel_operators.price_features(daily_bars(spark, sf_dir))
    rows = rows.select("ticker", "date", *[(F.round(n, 6) if n != "delivery_pct" else F.round(F.col(n) + OFF_TIES, 6)).alias(n) for n in NAMES])
    day = Window.partitionBy("date")
    parts = {p: F.round(F.try_divide(F.col(n) - F.avg(n).over(day), F.nullif(F.round(F.stddev_samp(n).over(day), 9), F.lit(0.0))), 6) for n, p in zip(NAMES, PARTS, strict=True)}
    rows = rows.withColumns(parts).withColumn("score", F.ceil(percent_rank(F.col("ret_5d"), "date") * 10 - 1e-9))
    rows = rows.withColumns({n: F.col(n) + OFF_TIES for n in NAMES}).withColumn("label", labels.score_label(F.col("score")))
    found = reasons.with_reasons(rows, NAMES, PARTS, F.col("label"))
    return found.select("ticker", "date", "label", F.size("signals").alias("n_signals"), "reason")


QUERIES = {"reason_texts": reason_texts}


def _said(name: str) -> str:
    text = reasons.TABLE[name][1]
    turned, signed, digits, unit = reasons._NUMBER.search(text).groups()
    shown = f"%{signed}.{digits}f" + ("%%" if unit == "%" else "")
    return f"printf('{reasons._NUMBER.sub(shown, text)}', {'-' if turned else ''}v{' * 100' if unit == '%' else ''})"


def oracles(others: dict[str, str]) -> dict[str, str]:
    """``others`` has the SQL of the feature panel."""
    prank = "(rank() OVER (PARTITION BY date ORDER BY ret_5d NULLS LAST) + (count(*) OVER (PARTITION BY date, ret_5d) - 1) / 2.0) / count(ret_5d) OVER (PARTITION BY date)"
    part = lambda n: f"round(({n} - avg({n}) OVER d) / nullif(round(stddev_samp({n}) OVER d, 9), 0), 6)"
    every = ", ".join(f"struct_pack(pos := {i}, feature := '{n}', v := {n} + {OFF_TIES}, part := part_{n}, w := abs(part_{n}) * {reasons.FAVOUR if n.startswith(reasons.FAVOURED) else 1.0}e0)" for i, n in enumerate(NAMES))
    said = " ".join(f"WHEN '{n}' THEN {_said(n)}" for n in NAMES)
    return {
        "reason_texts": f"""WITH {BARS_SQL}, f AS ({others['price_feature_panel']}), x AS (SELECT f.ticker, f.date, {', '.join(FROM_FEATURES)}, round(b.delivery_pct + {OFF_TIES}, 6) AS delivery_pct FROM f JOIN bars b ON b.ticker = f.ticker AND b.date = f.date),
p AS (SELECT *, {', '.join(f'{part(n)} AS part_{n}' for n in NAMES)}, CASE WHEN ret_5d IS NOT NULL THEN ceil({prank} * 10 - 1e-9) END AS score FROM x WINDOW d AS (PARTITION BY date)),
l AS (SELECT *, CASE WHEN score >= 8 THEN 'STRONG BUY' WHEN score >= 6 THEN 'BUY' WHEN score >= 4 THEN 'HOLD' WHEN score >= 2 THEN 'SELL' WHEN score >= 0 THEN 'STRONG SELL' ELSE 'HOLD' END AS label FROM p),
z AS (SELECT ticker, date, label, unnest([{every}]) AS u FROM l), s AS (SELECT ticker, date, label, u.pos AS pos, u.feature AS feature, u.v AS v, u.part AS part, u.w AS w FROM z WHERE u.v IS NOT NULL AND u.part IS NOT NULL AND isfinite(u.part)
  QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY u.w DESC, u.pos) <= 3),
t AS (SELECT *, CASE feature {said} END AS said, (part > 0) = (label IN ('STRONG BUY', 'BUY')) AS supports FROM s),
g AS (SELECT ticker, date, count(*) AS n, string_agg(said, '; ' ORDER BY w DESC, pos) FILTER (supports) AS pro, arg_min(said, struct_pack(a := -w, b := pos)) FILTER (NOT supports) AS con, string_agg(said, '; ' ORDER BY w DESC, pos) AS whole FROM t GROUP BY ALL),
r AS (SELECT ticker, date, n, CASE WHEN pro IS NOT NULL AND con IS NOT NULL AND length(pro || '. Offset by ' || con || '.') <= {reasons.MOST_CHARS} THEN pro || '. Offset by ' || con || '.' ELSE coalesce(pro, whole) || '.' END AS reason FROM g)
SELECT l.ticker, l.date, label, CAST(coalesce(n, 0) AS INTEGER) AS n_signals, CASE WHEN n IS NULL THEN '{reasons.NOTHING}' WHEN length(reason) > {reasons.MOST_CHARS} THEN rtrim(reason[1:{reasons.MOST_CHARS - 1}], ' ;,') || '.' ELSE reason END AS reason
FROM l LEFT JOIN r ON r.ticker = l.ticker AND r.date = l.date"""
    }
