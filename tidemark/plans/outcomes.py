"""Queries of what became of scores, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import percent_rank
from tidemark.operators import books, labels, outcomes, panel
from tidemark.plans import books as book_plans
from tidemark.plans import labels as label_plans
from tidemark.plans.books import HOLDS
from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.sources.staging import staged

BY_SCORE = ("win_rate", "mean_ret", "beat_market", "mean_excess", "worst", "best")
SPREAD = ("top_mean", "top_win_rate", "bottom_mean", "bottom_win_rate", "spread")
COSTS = (0, 5, 10, 20)
FORMS = ("raw", "per_date", "pooled_fold", "pooled_train")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.col("xs_rank") * 10))).cast("int")
    score = F.when(F.col("xs_rank").isNotNull(), score)
    return outcomes.outcomes(book_plans.ranked(spark, sf_dir).withColumn("score", score), HOLDS)


def outcomes_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score at every holding period, against the market of the same horizon."""
    return rounded(outcomes.by_score(_long(spark, sf_dir)), *BY_SCORE)


def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the top score and the bottom one part their outcomes, and what costs leave of the top."""
    found = outcomes.spread(_long(spark, sf_dir))
    found = found.withColumns({f"net_{bps}bps": F.col("top_mean") - bps / 1e4 for bps in COSTS})
    return rounded(found, *SPREAD, *[f"net_{bps}bps" for bps in COSTS])


def top_score_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top score's mean return as one value a date, with a t of its own lag for each holding period."""
    days = _long(spark, sf_dir).where("score = 10").groupBy("hold", "date").agg(F.avg("ret").alias("ret"))
    lag = F.greatest(F.col("hold") - 1, F.lit(1))
    return rounded(outcomes.significance(days, "ret", ("hold",), lag, max(HOLDS) - 1), "mean", "naive_t", "t", digits=5)


def followed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of the top names followed on every session: entries a holding period apart, and twice as often."""
    x = staged(book_plans.ranked(spark, sf_dir))
    plan = spark.createDataFrame([(h, e) for h in HOLDS for e in sorted({h, (h + 1) // 2})], "hold int, every int")
    entries = books.sessions(x).select("i").join(F.broadcast(plan), F.col("i") % F.col("every") == 0)
    on = outcomes.latest_entries(x, books.equal_weights(x, F.col("xs_rank") >= 0.9), entries)
    days = books.daily_returns(on, x, ("hold", "every"))
    return rounded(outcomes.followed(days, ("hold", "every")), "log_growth", "max_drawdown", digits=5)


def neutral_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores made free of beta and sector in four forms, by their rank correlation with what follows, per fold."""
    rows = label_plans.rows_of(spark, sf_dir).select("ticker", "sector", "date", "beta", "ret_5d", "fwd_3d")
    rows = rows.withColumn("score", percent_rank(F.col("ret_5d"), "date"))
    parts = staged(labels.walk_forward(rows, 6, 3))
    train, test = parts.where("role = 'train'"), parts.where("role = 'test'")
    by_date = labels.neutralise(test, labels.neutralise_fit(test, "score", "beta", "date"), "score", "beta", "date")
    forms = {
        "raw": test.withColumn("neutral", F.col("score")),
        "per_date": by_date.withColumn("neutral", F.round(F.col("neutral") + 1.2345678e-7, 9)),
        "pooled_fold": outcomes.pooled_neutral(test, labels.neutralise_fit(test, "score", "beta", "fold"), "score", "beta", "fold"),
        "pooled_train": outcomes.pooled_neutral(test, labels.neutralise_fit(train, "score", "beta", "fold"), "score", "beta", "fold"),
    }
    found = None
    for name, form in forms.items():
        ics = panel.rank_ic(form, "neutral", "fwd_3d").join(test.select("date", "fold").distinct(), "date").withColumn("form", F.lit(name))
        found = ics if found is None else found.unionByName(ics)
    return rounded(outcomes.significance(found, "ic", ("form", "fold"), F.lit(2), 2, 3).drop("naive_t"), "mean", "t", digits=5)


QUERIES = {q.__name__: q for q in (outcomes_by_score, score_spread, top_score_significance, followed_books, neutral_forms)}

_LONG = " UNION ALL ".join(f"SELECT date, ticker, xs_rank, {h} AS hold, fwd_{h}d AS ret FROM x WHERE fwd_{h}d IS NOT NULL" for h in HOLDS)
_O = f"""{book_plans._X}, u AS ({_LONG}),
o AS (SELECT *, ret - avg(ret) OVER (PARTITION BY date, hold) AS excess, CASE WHEN xs_rank IS NOT NULL THEN CAST(greatest(1, least(10, ceil(xs_rank * 10))) AS INT) END AS score FROM u)"""
_NETS = ", ".join(f"round(top_mean - {bps} / 1e4 + 1.2345678e-7, 6) + 0.0 AS net_{bps}bps" for bps in COSTS)
_SIDE = "count(*) FILTER (score = {s}) AS {n}_n, avg(ret) FILTER (score = {s}) AS {n}_mean, avg(CAST(ret > 0 AS INT)) FILTER (score = {s}) AS {n}_win_rate"


def _significance(series: str, keys: str, lag: str, most: int, least: int) -> str:
    """Lagged products by joining the numbered dates of a group to themselves."""
    return f"""sr AS ({series}), sn AS (SELECT {keys}, x, {lag} AS lag, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS k, x - avg(x) OVER (PARTITION BY {keys}) AS e FROM sr WHERE x IS NOT NULL),
sp AS (SELECT {keys}, sum((CASE WHEN a.k = b.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / (a.lag + 1e0)) END) * a.e * b.e) AS total FROM sn a JOIN sn b USING ({keys}) WHERE a.k - b.k BETWEEN 0 AND least(a.lag, {most}) GROUP BY ALL),
sm AS (SELECT {keys}, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM sn GROUP BY ALL),
st AS (SELECT *, mean / (sd + 1e-12) * sqrt(n) AS naive_t, mean / sqrt(greatest(total / n, 1e-16) / n) AS t FROM sm JOIN sp USING ({keys}) WHERE n >= {least})"""


_PLAN = ", ".join(f"({h}, {e})" for h in HOLDS for e in sorted({h, (h + 1) // 2}))
_PR = "(rank() OVER (PARTITION BY {k} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {k})"


def _fit(name: str, rows: str, keys: str) -> str:
    """``name(keys, sector, a, b)``: the slope within sectors by centred sums, and an intercept for each sector."""
    return f"""{name}c AS (SELECT *, score - avg(score) OVER w AS ds, beta - avg(beta) OVER w AS db, avg(score) OVER w AS ms, avg(beta) OVER w AS mb FROM {rows} WHERE score IS NOT NULL AND beta IS NOT NULL WINDOW w AS (PARTITION BY {keys}, sector)),
{name}b AS (SELECT {keys}, coalesce(sum(ds * db) / nullif(sum(db * db), 0), 0) AS b FROM {name}c GROUP BY ALL), {name} AS (SELECT {keys}, sector, any_value(ms - b * mb) AS a, any_value(b) AS b FROM {name}c JOIN {name}b USING ({keys}) GROUP BY {keys}, sector)"""


_FOLDS = f"""{label_plans._R}, s AS (SELECT ticker, sector, date, beta, fwd_3d, {label_plans._prank('ret_5d', 'date')} AS score FROM v), dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM s)), nn AS (SELECT count(*) AS n, count(*) // 8 AS len FROM dn),
ff AS (SELECT CAST(range AS INT) AS fold, n - (6 - range) * len AS stop, len FROM nn, range(6) WHERE n - (6 - range) * len >= 300), te AS MATERIALIZED (SELECT s.*, fold FROM s JOIN dn USING (date), ff WHERE k >= stop AND k < stop + len), tr AS (SELECT s.*, fold FROM s JOIN dn USING (date), ff WHERE k < stop - 3)"""
_REST = "round(coalesce(score - a - b * beta, score) + 1.2345678e-7, 9)"
_ENOUGH = "count(score - a - b * beta) OVER (PARTITION BY date) >= 0.5 * count(*) OVER (PARTITION BY date)"
_NEUTRAL = f"""{_FOLDS}, {_fit('fd', 'te', 'date')}, {_fit('fp', 'te', 'fold')}, {_fit('ft', 'tr', 'fold')},
fm AS (SELECT 'raw' AS form, fold, date, fwd_3d, score AS p FROM te
 UNION ALL SELECT 'per_date', fold, date, fwd_3d, round(CASE WHEN {_ENOUGH} THEN coalesce(score - a - b * beta, score) ELSE score END + 1.2345678e-7, 9) FROM te LEFT JOIN fd USING (date, sector)
 UNION ALL SELECT 'pooled_fold', fold, date, fwd_3d, {_REST} FROM te LEFT JOIN fp USING (fold, sector)
 UNION ALL SELECT 'pooled_train', fold, date, fwd_3d, {_REST} FROM te LEFT JOIN ft USING (fold, sector)),
rk AS (SELECT form, fold, date, {_PR.format(k='form, date', x='p')} AS rx, {_PR.format(k='form, date', x='fwd_3d')} AS ry FROM fm WHERE p IS NOT NULL AND fwd_3d IS NOT NULL)"""
_IC = "SELECT form, fold, date, CASE WHEN isfinite(corr(rx, ry)) THEN corr(rx, ry) END AS x FROM rk GROUP BY ALL HAVING count(*) >= 10"

ORACLES = {
    "outcomes_by_score": f"""{_O}, g AS (SELECT hold, score, count(*) AS n, avg(CAST(ret > 0 AS INT)) AS win_rate, avg(ret) AS mean_ret, avg(CAST(excess > 0 AS INT)) AS beat_market, avg(excess) AS mean_excess, min(ret) AS worst, max(ret) AS best
FROM o WHERE score IS NOT NULL GROUP BY ALL) SELECT hold, score, n, {round_sql(BY_SCORE)} FROM g""",
    "score_spread": f"""{_O}, g AS (SELECT hold, {_SIDE.format(s=10, n='top')}, {_SIDE.format(s=1, n='bottom')} FROM o GROUP BY hold), h AS (SELECT *, top_mean - bottom_mean AS spread FROM g WHERE top_n > 0 AND bottom_n > 0)
SELECT hold, top_n, bottom_n, {round_sql(SPREAD)}, {_NETS} FROM h""",
    "top_score_significance": f"""{_O}, {_significance('SELECT hold, date, avg(ret) AS x FROM o WHERE score = 10 GROUP BY ALL', 'hold', 'greatest(hold - 1, 1)', max(HOLDS) - 1, 10)} SELECT hold, n, {round_sql(('mean', 'naive_t', 't'), 5)} FROM st""",
    "followed_books": f"""{book_plans._X}, pl(hold, every) AS (VALUES {_PLAN}), pk AS ({book_plans._TOP}), en AS (SELECT hold, every, d.i AS s, max(e.i) AS i FROM d, pl, (SELECT DISTINCT i FROM pk) e WHERE e.i % every = 0 AND e.i <= d.i AND e.i > d.i - hold GROUP BY ALL),
rr AS (SELECT hold, every, s, sum(w * move) AS ret FROM en JOIN pk USING (i) JOIN mv USING (ticker, s) GROUP BY ALL), dd AS (SELECT pl.hold, pl.every, d.i, coalesce(rr.ret, 0) AS ret FROM d CROSS JOIN pl LEFT JOIN rr ON rr.hold = pl.hold AND rr.every = pl.every AND rr.s = d.i),
lv AS (SELECT *, sum(ln(greatest(1 + ret, 1e-6))) OVER w AS level FROM dd WINDOW w AS (PARTITION BY hold, every ORDER BY i ROWS UNBOUNDED PRECEDING)), fl AS (SELECT *, exp(level - greatest(0, max(level) OVER (PARTITION BY hold, every ORDER BY i ROWS UNBOUNDED PRECEDING))) - 1 AS fall FROM lv),
gg AS (SELECT hold, every, arg_max(level, i) AS log_growth, min(fall) AS max_drawdown, count(*) FILTER (ret <> 0) AS n_moved FROM fl GROUP BY ALL) SELECT hold, every, n_moved, {round_sql(('log_growth', 'max_drawdown'), 5)} FROM gg""",
    "neutral_forms": f"""{_NEUTRAL}, {_significance(_IC, 'form, fold', '2', 2, 3)} SELECT form, fold, n, {round_sql(('mean', 't'), 5)} FROM st""",
}
