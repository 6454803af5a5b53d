"""Models over panels, by Spark's own learners: walk-forward scores, clusters of patterns, and resampled paths."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_ticker, percent_rank
from tidemark.operators.labels import walk_forward
from tidemark.sources.staging import staged


def learner(kind: str):
    """``linear``: logistic regression with an L2 penalty; ``trees``: shallow boosted trees on sampled rows."""
    if kind == "linear":
        return LogisticRegression(featuresCol="scaled", labelCol="label", regParam=0.1, elasticNetParam=0.0)
    return GBTClassifier(featuresCol="scaled", labelCol="label", maxDepth=3, maxIter=20, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.7", minInstancesPerNode=20, seed=7)


def walk_forward_scores(rows: DataFrame, names: tuple[str, ...], kind: str = "linear", folds: int = 3, purge: int = 3, least: int = 300) -> DataFrame:
    """``(ticker, date, fold, p)``: scores of each test block by a model of the dates before it, less the purged ones.

    ``rows`` have a ``label`` of 0, 1 or null; missing features count as 0, so they should be centred. A fold without both
    labels has no scores. The folds, a handful, are fitted in turn.
    """
    parts = walk_forward(rows.fillna(0.0, subset=list(names)), folds, purge, least)
    steps = [VectorAssembler(inputCols=list(names), outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), learner(kind)]
    out = None
    for fold in range(folds):
        train = parts.where((F.col("fold") == fold) & (F.col("role") == "train") & F.col("label").isNotNull())
        if train.select("label").distinct().limit(2).count() < 2:
            continue
        model = Pipeline(stages=steps).fit(train)
        test = model.transform(parts.where((F.col("fold") == fold) & (F.col("role") == "test")))
        scored = test.select("ticker", "date", "fold", vector_to_array("probability")[1].alias("p"))
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else rows.sparkSession.createDataFrame([], "ticker string, date date, fold int, p double")


def blended(scores: DataFrame, other: DataFrame, share: float = 0.3) -> DataFrame:
    """``p`` mixed with the percent rank of another score ``q`` on each date."""
    ranked = scores.join(other, ["ticker", "date"], "left").withColumn("rank", percent_rank(F.col("q"), "date"))
    return ranked.withColumn("p", F.coalesce((1 - share) * F.col("p") + share * F.col("rank"), F.col("p"))).drop("q", "rank")


def pattern_clusters(rows: DataFrame, x: str = "ret_1d", n: int = 10, k: int = 3, least: int = 30, rounds: int = 40) -> DataFrame:
    """``cluster`` of the ``n`` values before each row, by k-means within each ticker; 0 for all of a ticker with fewer than
    ``least`` patterns, null for rows with a shorter past.

    The rounds run for all tickers at once, centres being a table by ticker. The first centre is the pattern nearest to
    the ticker's mean, each further one the pattern farthest from those before it, the earlier of equals; so reruns agree.
    Clusters are numbered by their centre's sum, from falling to rising. Rounds end when no centre moves.
    """
    xs = [f"x{i}" for i in range(n)]
    value = F.coalesce(x, F.lit(0.0))
    at = by_ticker()
    held = rows.select("ticker", "date", (F.row_number().over(at) - n).alias("p"), *[F.lag(value, n - i).over(at).alias(c) for i, c in enumerate(xs)]).where("p > 0")
    held = staged(held.withColumn("n", F.count("*").over(Window.partitionBy("ticker"))))
    many = held.where(F.col("n") >= least).drop("n")

    def gap(name: str) -> Column:
        return sum(((F.col(c) - F.get(name, F.lit(i))) * (F.col(c) - F.get(name, F.lit(i))) for i, c in enumerate(xs)), F.lit(0.0))

    point = F.array(*xs)
    mean = many.groupBy("ticker").agg(F.array(*[F.avg(c) for c in xs]).alias("mean"))
    centres = many.join(mean, "ticker").groupBy("ticker").agg(F.min_by(point, F.struct(gap("mean"), "p")).alias("c0"))
    for i in range(1, k):
        nearest = F.least(F.lit(float("inf")), *[gap(f"c{j}") for j in range(i)])
        centres = staged(centres.join(many.join(centres, "ticker").groupBy("ticker").agg(F.max_by(point, F.struct(nearest, -F.col("p"))).alias(f"c{i}")), "ticker"))
    names = [f"c{i}" for i in range(k)]
    place = F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(names)]))["c"]
    for _ in range(rounds):
        sums = many.join(centres, "ticker").withColumn("c", place).groupBy("ticker").agg(*[F.array(*[F.avg(F.when(F.col("c") == i, F.col(x))) for x in xs]).alias(f"new{i}") for i in range(k)])
        moved = centres.join(sums, "ticker").select("ticker", *[F.when(F.get(f"new{i}", F.lit(0)).isNull(), F.col(c)).otherwise(F.col(f"new{i}")).alias(c) for i, c in enumerate(names)], F.array(*names).alias("old"))
        moved = staged(moved)
        shift = moved.agg(F.max(F.aggregate(F.zip_with(F.flatten("old"), F.flatten(F.array(*names)), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: F.greatest(s, v)))).first()[0]
        centres = moved.drop("old")
        if not shift or shift < 1e-12:
            break
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    ordered = F.transform(F.array_sort(F.array(*[F.struct(total(c).alias("s"), F.lit(i).alias("i"), F.col(c).alias("c")) for i, c in enumerate(names)])), lambda s: s["c"])
    centres = centres.select("ticker", ordered.alias("ordered")).select("ticker", *[F.get("ordered", F.lit(i)).alias(c) for i, c in enumerate(names)])
    labelled = held.join(centres, "ticker", "left").select("ticker", "date", F.when(F.col("n") >= least, place).otherwise(0).cast("int").alias("cluster"))
    return rows.select("ticker", "date").join(labelled, ["ticker", "date"], "left")


def block_bootstrap(days: DataFrame, sims: int, block: int, seed: int = 42) -> DataFrame:
    """Drawdown, log growth and mean of so many resampled paths of ``days(i, ret)``, drawn in blocks of sessions.

    Each path has as many sessions as the series. Starts follow from the seed, path and block, so reruns agree. Paths
    are spread over tasks; each is folded by windows over its own sessions.
    """
    n = days.agg(F.max("i") + 1).first()[0] or 0
    blocks = max(1, -(-n // block))
    draws = days.sparkSession.range(sims * blocks).select((F.col("id") / blocks).cast("long").alias("sim"), (F.col("id") % blocks).alias("b"))
    start = F.pmod(F.xxhash64("sim", "b", F.lit(seed)), F.lit(max(1, n - block + 1)))
    paths = draws.withColumn("start", start).select("sim", "b", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"))
    paths = paths.select("sim", (F.col("b") * block + F.col("o")).alias("k"), (F.col("start") + F.col("o")).alias("i")).where(F.col("k") < n).join(days.select("i", "ret"), "i")
    order = Window.partitionBy("sim").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    level = paths.withColumn("level", F.sum(F.log(F.greatest(1 + F.col("ret"), F.lit(1e-6)))).over(order))
    fall = level.withColumn("fall", F.exp(F.col("level") - F.greatest(F.lit(0.0), F.max("level").over(order))) - 1)
    return fall.groupBy("sim").agg(F.min("fall").alias("max_drawdown"), F.max_by("level", "k").alias("log_growth"), F.avg("ret").alias("mean_ret"))
