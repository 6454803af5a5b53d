"""Queries of models and resampling, and a summary of a ranking's quality. SQL checks what it can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import books, labels, models, panel, training, trend, validation
from tidemark.plans import labels as label_plans
from tidemark.plans.books import HOLD, ranked
from tidemark.plans.rounding import round_off_ties_sql as round_sql
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.sources.staging import staged

NAMES = ("ret_1d", "ret_5d", "vol", "delivery_pct")


def walk_forward_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six folds by two tails, fitted together on a staged panel; the members' mean rank on each date."""
    rows = label_plans.rows_of(spark, sf_dir).select("ticker", "date", "fwd_3d", *NAMES)
    return rounded(training.walk_forward_ensemble(rows, NAMES, "fwd_3d"), "p")


def meta_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_plans.rows_of(spark, sf_dir).select("ticker", "date", "fwd_3d", *NAMES)
    found = training.meta_labelled(rows, NAMES, "fwd_3d")
    return rounded(found, "primary", "confidence", "p")


def config_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations side by side: as they are, features clipped by date, scores free of beta and sectors, blended with a rank."""
    rows = staged(label_plans.rows_of(spark, sf_dir).select("ticker", "sector", "date", "beta", "fwd_3d", *NAMES))
    plain = staged(training.walk_forward_ensemble(rows, NAMES, "fwd_3d"))
    clipped = training.walk_forward_ensemble(panel.winsorised_all(rows, NAMES), NAMES, "fwd_3d")
    scored = plain.join(rows.select("ticker", "date", "sector", "beta"), ["ticker", "date"])
    fit = labels.neutralise_fit(scored, "p", "beta", "date")
    free = labels.neutralise(scored, fit, "p", "beta", "date").select("ticker", "date", F.col("neutral").alias("p"))
    mixed = models.blended(plain, rows.select("ticker", "date", F.col("delivery_pct").alias("q")))
    found = training.compared({"plain": plain, "clipped": clipped, "neutral": free, "blended": mixed}, rows, "fwd_3d")
    return rounded(found, "mean_ic", "t", "beta_tilt", digits=5)


def _last_block(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The last of six folds: rows to learn from, and those to score."""
    rows = label_plans.rows_of(spark, sf_dir).select("ticker", "date", "fwd_3d", *NAMES)
    parts = staged(labels.walk_forward(training.with_tails(rows, "fwd_3d"), 6, 3).where("fold = 5"))
    return parts.where("role = 'train'"), parts.where("role = 'test'")


def score_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for two tails by three seeds: margins of the last block, and each feature's part in them."""
    train, test = _last_block(spark, sf_dir)
    models = training.fitted_trees(train, NAMES, tuple(f"label_{round(100 * q)}" for q in training.TAILS))
    parts = [f"part_{n}" for n in NAMES]
    found = training.Attribution(models, NAMES).explained(test).select("ticker", "date", "margin", *parts)
    return rounded(found, "margin", *parts)


def pattern_cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.pattern_clusters(label_plans.rows_of(spark, sf_dir).select("ticker", "date", "ret_1d"))


def bootstrap_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred paths of the single book, in blocks of twenty sessions."""
    x = ranked(spark, sf_dir)
    top = books.equal_weights(books.on_grid(x, HOLD), F.col("xs_rank") >= books.TOP)
    found = models.block_bootstrap(books.daily_returns(books.held(top, HOLD), x), sims=200, block=20)
    return rounded(found, "max_drawdown", "log_growth", "mean_ret")


SUMMARY = ("mean_ic", "positive_share", "t", "deflated_t", "auc", "long_short")


def ranking_summary(spark: SparkSession, sf_dir: str, trials: int = 20) -> DataFrame:
    """Rank correlation of the five-day return with what follows, its t before and after a haircut for the best of so many
    trials, the AUC of the tails, and top less bottom tenth."""
    rows = label_plans.rows_of(spark, sf_dir)
    ics = panel.rank_ic(rows, "ret_5d", "fwd_3d").where(F.col("ic").isNotNull() & ~F.isnan("ic"))
    stats = trend.newey_west(ics, "ic").select("t")
    shares = ics.agg(F.count("*").alias("n_days"), F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"))
    auc = validation.rank_sum(trend.tail_labels(rows.where("ret_5d is not null"), "fwd_3d"), "ret_5d", "label").select("auc")
    scored = panel.cross_section(rows.select("ticker", "sector", "date", "ret_5d", "fwd_3d"))
    ends = scored.groupBy("date").agg((F.avg(F.when(F.col("xs_rank") >= 0.9, F.col("fwd_3d"))) - F.avg(F.when(F.col("xs_rank") <= 0.1, F.col("fwd_3d")))).alias("x")).agg(F.avg("x").alias("long_short"))
    found = shares.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(auc)).crossJoin(F.broadcast(ends))  # a row each
    return rounded(found.withColumn("deflated_t", F.col("t") - validation.expected_best(trials)).select("n_days", *SUMMARY), *SUMMARY)


QUERIES = {q.__name__: q for q in (walk_forward_linear, meta_labels, config_comparison, score_contributions, pattern_cluster_table, bootstrap_paths, ranking_summary)}

_PRANK = label_plans._prank
ORACLES = {
    "ranking_summary": f"""{label_plans._R}, b AS (SELECT * FROM r WHERE ret_5d IS NOT NULL AND fwd_3d IS NOT NULL), k AS (SELECT date, {_PRANK('ret_5d', 'date')} AS rx, {_PRANK('fwd_3d', 'date')} AS ry, count(*) OVER (PARTITION BY date) AS m FROM b),
ic AS (SELECT date, CASE WHEN sum(round(2 * rx * m - m - 1) * round(2 * ry * m - m - 1)) = 0 THEN 0 ELSE corr(rx, ry) END AS ic FROM k GROUP BY date HAVING count(*) >= 10 AND corr(rx, ry) IS NOT NULL AND NOT isnan(corr(rx, ry))),
e AS (SELECT date, ic, ic - avg(ic) OVER () AS e FROM ic), g AS (SELECT ic, e * e AS g0, e * lag(e, 1) OVER (ORDER BY date) AS g1, e * lag(e, 2) OVER (ORDER BY date) AS g2 FROM e),
s AS (SELECT count(*) AS n_days, avg(ic) AS mean_ic, avg(CAST(ic > 0 AS INT)) AS positive_share, CASE WHEN count(*) >= 3 THEN avg(ic) / sqrt(greatest((sum(g0) + 2 * (2e0 / 3) * coalesce(sum(g1), 0) + 2 * (1e0 / 3) * coalesce(sum(g2), 0)) / count(*), 1e-16) / count(*)) END AS t FROM g),
q AS (SELECT date, quantile_cont(fwd_3d, 0.3) AS lo, quantile_cont(fwd_3d, 0.7) AS hi FROM r WHERE ret_5d IS NOT NULL GROUP BY date), y AS (SELECT ret_5d AS x, CASE WHEN fwd_3d <= lo THEN 0 WHEN fwd_3d >= hi THEN 1 END AS y FROM r JOIN q USING (date) WHERE ret_5d IS NOT NULL),
m AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM y WHERE y IS NOT NULL), u AS (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)) AS auc FROM m),
x AS (SELECT date, fwd_3d, {_PRANK('ret_5d', 'date')} AS xr FROM r), w AS (SELECT avg(x) AS long_short FROM (SELECT avg(fwd_3d) FILTER (xr >= 0.9) - avg(fwd_3d) FILTER (xr <= 0.1) AS x FROM x GROUP BY date)),
o AS (SELECT *, t - {validation.expected_best(20)!r} AS deflated_t FROM s, u, w) SELECT n_days, {round_sql(SUMMARY)} FROM o""",
}
