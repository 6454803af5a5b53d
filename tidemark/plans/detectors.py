"""Queries of detectors. Random trees and boundaries are beyond SQL; tests hold them against plain walks and solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import percent_rank
from tidemark.operators import detectors, neighbours, reconstruction, validation
from tidemark.operators.order import exact_quantiles
from tidemark.plans.neighbours import KS, WEEKLY, standard, weekly_bars
from tidemark.plans.rounding import rounded_off_ties as rounded
from tidemark.sources.staging import staged

SHARES = (0.01, 0.02, 0.05, 0.1)


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out evenly, since walking trees costs far more than reading."""
    rows = standard(weekly_bars(spark, sf_dir), *WEEKLY)
    return staged(rows.repartition(spark.sparkContext.defaultParallelism, "ticker", "week"))


def weekly_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation scores of all weeks by 200 trees, flags at four shares, and the score's rank within its week."""
    found = detectors.isolation_scores(_weeks(spark, sf_dir), WEEKLY, SHARES).withColumn("week_rank", percent_rank(F.col("isolation"), "week"))
    return rounded(found.select("ticker", "week", "isolation", "week_rank", *[f"flag_{round(100 * p)}" for p in SHARES]), "isolation", "week_rank", digits=8)


def weekly_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which weeks lie outside a boundary round 95 % of them."""
    found = detectors.boundary_scores(_weeks(spark, sf_dir), WEEKLY)
    return rounded(found.select("ticker", "week", "boundary", "outside"), "boundary", digits=4)


def detector_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three detectors at 5 %, how many agree, whether two do, and the mean of their scaled scores."""
    rows = detectors.isolation_scores(_weeks(spark, sf_dir), WEEKLY, (0.05,)).withColumnRenamed("flag_5", "isolated")
    rows = detectors.boundary_scores(rows, WEEKLY)
    rows = neighbours.outlier_factors(rows, WEEKLY).withColumn("sparse", -F.col("lof_20"))
    rows = detectors.flagged(rows, "sparse", (0.05,)).withColumnRenamed("flag_5", "sparse_flag")
    rows = staged(rows.withColumns({"a": -F.col("isolation"), "b": -F.col("boundary"), "c": F.col("lof_20")}))
    found = validation.agreement(rows, ("isolated", "outside", "sparse_flag"), ("a", "b", "c"))
    return rounded(found.select("ticker", "week", "isolated", "outside", "sparse_flag", "agreement_count", "consensus", "combined_score"), "combined_score", digits=4)


def weekly_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far weeks lie from what three axes of ordinary weeks rebuild, column by column, and flags at two and three deviations."""
    found = reconstruction.reconstruction_scores(_weeks(spark, sf_dir), WEEKLY, 3)
    errors = [f"error_{n}" for n in WEEKLY]
    return rounded(found.select("ticker", "week", "rebuilt_error", *errors, "flag_2sigma", "flag_3sigma"), "rebuilt_error", *errors)


def detector_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four detectors at all their settings: how many weeks each one flags, and their share."""
    rows = detectors.isolation_scores(_weeks(spark, sf_dir), WEEKLY, SHARES)
    rows = rows.withColumnsRenamed({f"flag_{round(100 * p)}": f"isolation share {p}" for p in SHARES})
    for nu in (0.01, 0.05, 0.1):
        rows = detectors.boundary_scores(rows, WEEKLY, nu).withColumnRenamed("outside", f"boundary nu {nu}").drop("boundary")
    rows = neighbours.outlier_factors(rows, WEEKLY, KS)
    for k in KS:
        rows = detectors.flagged(rows.withColumn("sparse", -F.col(f"lof_{k}")), "sparse", (0.05,)).withColumnRenamed("flag_5", f"neighbours k {k}").drop("sparse")
    rows = reconstruction.reconstruction_scores(rows, WEEKLY, 3).withColumnsRenamed({f"flag_{s}sigma": f"reconstruction sigma {s}" for s in (2, 3)})
    settings = [c for c in rows.columns if " " in c]
    flags = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("setting"), F.col(f"`{c}`").alias("flag")) for c in settings])).alias("s")).select("s.*")
    found = flags.groupBy("setting").agg(F.sum("flag").alias("n_flagged"), F.avg("flag").alias("share"))
    return rounded(found.withColumn("detector", F.split("setting", " ")[0]), "share")


def isolation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the flags at 5 % change if a column's values are exchanged between weeks."""
    rows = _weeks(spark, sf_dir)
    forest = detectors.isolation_forest(rows, WEEKLY)
    (cut,) = exact_quantiles(forest.scored(rows), ("isolation",), (0.05,))["isolation"]
    found = reconstruction.importance(rows, WEEKLY, ("ticker", "week"), forest.scored, "isolation", cut)
    return rounded(found, "importance_mean", "importance_std", "mean_shift")


QUERIES = {
    q.__name__: q
    for q in (weekly_isolation, weekly_boundary, detector_consensus, weekly_reconstruction, detector_sweep, isolation_importance)
}
ORACLES: dict[str, str] = {}
