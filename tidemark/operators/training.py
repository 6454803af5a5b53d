"""Training of rankings: linear scores of all folds at once, ensembles of boosted trees, and what moved a score."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import percent_rank
from tidemark.operators.labels import walk_forward
from tidemark.operators.trees import Trees
from tidemark.operators.trend import tail_labels
from tidemark.sources.staging import staged

#: Shares of a date's rows that count as winners and losers, a member of the ensemble for each.
TAILS = (0.3, 0.2)
SEEDS = (7, 21, 42)


def with_tails(rows: DataFrame, y: str, tails: tuple[float, ...] = TAILS) -> DataFrame:
    """``rows`` with ``label_30`` and the like for each tail."""
    for q in tails:
        rows = tail_labels(rows, y, q).withColumnRenamed("label", f"label_{round(100 * q)}")
    return rows


def joint_logistic(rows: DataFrame, names: tuple[str, ...], by: tuple[str, ...], penalty: float = 0.1, rounds: int = 25) -> DataFrame:
    """``(*by, weights, n)``: a penalised logistic regression of ``label`` for every group of ``rows`` at once.

    Features are scaled by each group's mean and deviation; the mean loss plus half the penalty times the squared scaled
    weights is minimised by Newton steps. A step is one aggregate by group, of sums that Spark combines before its only
    shuffle; the driver solves a system of ``len(names) + 1`` unknowns per group, so this is for tens of features and
    for groups like folds. ``weights`` are for unscaled features, the constant first. Groups that lack a label are left
    out; a constant feature has the weight 0.
    """
    spark = rows.sparkSession
    stats = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct("label").alias("labels"), *[F.avg(x).alias(f"m_{x}") for x in names], *[F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"s_{x}") for x in names]
    ).where("labels = 2").collect()  # a row per group
    d = len(names)
    keys = [tuple(r[k] for k in by) for r in stats]
    mean, sd = (np.array([[r[f"{p}_{x}"] for x in names] for r in stats], float).reshape(-1, d) for p in "ms")
    weights = np.zeros((len(keys), d + 1))
    kinds = dict(rows.dtypes)
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in by)
    at = {k: i for i, k in enumerate(keys)}

    def plain(scaled: np.ndarray) -> np.ndarray:
        """Weights for unscaled features."""
        w = np.divide(scaled[:, 1:], sd, out=np.zeros_like(sd), where=sd > 0)
        return np.column_stack([scaled[:, 0] - (w * mean).sum(axis=1), w])

    def table(kind: str, values: np.ndarray) -> DataFrame:
        return spark.createDataFrame([(*k, v.tolist()) for k, v in zip(keys, values, strict=True)], f"{key_schema}, {kind} array<double>")

    if not keys:
        return spark.createDataFrame([], f"{key_schema}, weights array<double>, n long")
    scales = F.broadcast(table("mean", mean)).join(F.broadcast(table("sd", sd)), list(by))  # a row per group
    z = [F.coalesce(F.try_divide(F.col(x) - F.get("mean", F.lit(i)), F.nullif(F.get("sd", F.lit(i)), F.lit(0.0))), F.lit(0.0)) for i, x in enumerate(names)]
    scaled = staged(rows.join(F.broadcast(scales), list(by)).select(*by, F.col("label").cast("double").alias("y"), F.lit(1.0).alias("z0"), *[c.alias(f"z{i + 1}") for i, c in enumerate(z)]))
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    for _ in range(rounds):
        held = scaled.join(F.broadcast(table("w", weights)), list(by))
        margin = sum((F.get("w", F.lit(i)) * F.col(f"z{i}") for i in range(1, d + 1)), F.get("w", F.lit(0)))
        held = held.withColumn("p", 1 / (1 + F.exp(-margin))).withColumn("v", F.col("p") * (1 - F.col("p")))
        slopes = [F.avg((F.col("p") - F.col("y")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(d + 1)]
        curves = [F.avg(F.col("v") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in pairs]
        largest = 0.0
        for r in held.groupBy(*by).agg(*slopes, *curves).collect():  # a row per group
            g = at[tuple(r[k] for k in by)]
            slope = np.array([r[f"g{i}"] for i in range(d + 1)])
            curve = np.zeros((d + 1, d + 1))
            for i, j in pairs:
                curve[i, j] = curve[j, i] = r[f"h{i}_{j}"]
            ridge = np.append(0.0, np.full(d, penalty))
            step = np.linalg.solve(curve + np.diag(ridge + 1e-12), slope + ridge * weights[g])
            weights[g] -= step
            largest = max(largest, np.abs(step).max())
        if largest < 1e-9:
            break
    counts = {tuple(r[k] for k in by): r["n"] for r in stats}
    return spark.createDataFrame([(*k, w.tolist(), counts[k]) for k, w in zip(keys, plain(weights), strict=True)], f"{key_schema}, weights array<double>, n long")


def walk_forward_ensemble(rows: DataFrame, names: tuple[str, ...], y: str, folds: int = 6, purge: int = 3, least: int = 300, tails: tuple[float, ...] = TAILS) -> DataFrame:
    """``(ticker, date, fold, p)``: each test block scored by models of the dates before it, less the purged ones.

    A member for each tail; members are averaged as percent ranks of a date, so that no member's scale dominates. The
    panel is staged once, and the models of all folds and tails are fitted in the same rounds. Missing features count as
    0. A fold without both labels has no scores.
    """
    panel = staged(with_tails(rows.select("ticker", "date", y, *names).fillna(0.0, list(names)), y, tails).drop(y))
    parts = staged(walk_forward(panel, folds, purge, least))
    marks = [f"label_{round(100 * q)}" for q in tails]
    train = parts.where("role = 'train'").unpivot(["fold", *names], marks, "tail", "label").where("label is not null")
    models = joint_logistic(train, names, ("fold", "tail"))
    test = parts.where("role = 'test'").select("ticker", "date", "fold", *names).join(F.broadcast(models), "fold")
    ranked = test.withColumn("m", _margin(names)).withColumn("r", percent_rank(F.round("m", 12), "date", "tail"))
    return ranked.groupBy("ticker", "date", "fold").agg(F.avg("r").alias("p"))


def _margin(names: tuple[str, ...], weights: str = "weights") -> Column:
    return sum((F.get(weights, F.lit(i + 1)) * F.col(x) for i, x in enumerate(names)), F.get(weights, F.lit(0)))


def meta_labelled(rows: DataFrame, names: tuple[str, ...], y: str, folds: int = 6, purge: int = 3, least: int = 300, tail: float = 0.3) -> DataFrame:
    """``(ticker, date, fold, primary, confidence, p)``: scores drawn to the middle where a second model expects the first to be wrong.

    ``primary`` is the rank on its date of the first model's score. On the training rows it is right if it is above a half
    for winners or not above it for losers; the second model learns that from the features and ``primary``, and ``p`` is
    ``0.5 + (primary - 0.5) * confidence``. Both are fitted for all folds at once.
    """
    mark = f"label_{round(100 * tail)}"
    panel = staged(with_tails(rows.select("ticker", "date", y, *names).fillna(0.0, list(names)), y, (tail,)).drop(y))
    parts = staged(walk_forward(panel, folds, purge, least))
    first = joint_logistic(parts.where(f"role = 'train' and {mark} is not null").withColumnRenamed(mark, "label"), names, ("fold",))
    scored = parts.join(F.broadcast(first), "fold").withColumn("m", F.round(_margin(names), 12)).drop("weights", "n")
    scored = staged(scored.withColumn("primary", percent_rank(F.col("m"), "fold", "role", "date")).drop("m"))
    right = ((F.col("primary") > 0.5) == (F.col(mark) == 1)).cast("int")
    second = joint_logistic(scored.where(f"role = 'train' and {mark} is not null").withColumn("label", right), (*names, "primary"), ("fold",))
    test = scored.where("role = 'test'").join(F.broadcast(second), "fold").withColumn("confidence", 1 / (1 + F.exp(-_margin((*names, "primary")))))
    return test.select("ticker", "date", "fold", "primary", "confidence", (0.5 + (F.col("primary") - 0.5) * F.col("confidence")).alias("p"))


def compared(scores: dict[str, DataFrame], panel: DataFrame, y: str, lag: int = 2) -> DataFrame:
    """``(config, n_days, mean_ic, t, beta_tilt)`` of named scores ``(ticker, date, p)`` against ``panel(ticker, date, beta, y)``."""
    out = None
    for name, found in scores.items():
        named = found.select(F.lit(name).alias("config"), "ticker", "date", "p")
        out = named if out is None else out.unionByName(named)
    rows = staged(out.join(panel.select("ticker", "date", "beta", y), ["ticker", "date"]).where(F.col(y).isNotNull() & F.col("p").isNotNull()))
    ranked = rows.withColumns({"a": percent_rank(F.col("p"), "config", "date"), "b": percent_rank(F.col(y), "config", "date")})
    ics = ranked.groupBy("config", "date").agg(F.count("*").alias("n"), F.try_divide(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b")).alias("ic")).where("n >= 10 and ic is not null")
    by_config = Window.partitionBy("config")
    ics = ics.withColumn("e", F.col("ic") - F.avg("ic").over(by_config))
    ics = ics.withColumns({f"g{k}": F.col("e") * F.lag("e", k).over(by_config.orderBy("date")) for k in range(1, lag + 1)})  # a row per date
    total = sum((2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(f"g{k}"), F.lit(0.0)) for k in range(1, lag + 1)), F.sum(F.col("e") * F.col("e")))
    curve = ics.groupBy("config").agg(F.count("*").alias("n_days"), F.avg("ic").alias("mean_ic"), total.alias("total"))
    curve = curve.withColumn("t", F.col("mean_ic") / F.sqrt(F.greatest(F.col("total") / F.col("n_days"), F.lit(1e-16)) / F.col("n_days"))).drop("total")
    tilt = ranked.groupBy("config").agg((F.avg(F.when(F.col("a") >= 0.9, F.col("beta"))) - F.avg(F.when(F.col("a") <= 0.1, F.col("beta")))).alias("beta_tilt"))
    return curve.join(tilt, "config")


def fitted_trees(rows: DataFrame, names: tuple[str, ...], labels: tuple[str, ...], seeds: tuple[int, ...] = SEEDS, **more: float) -> list[GBTClassificationModel]:
    """A boosted model for each label and seed on staged ``rows``; Spark runs their jobs side by side."""
    held = staged(VectorAssembler(inputCols=list(names), outputCol="features").transform(rows.fillna(0.0, list(names))).select("features", *labels))
    settings = {"maxDepth": 3, "maxIter": 20, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.5", "minInstancesPerNode": 20} | more

    def fit(member: tuple[str, int]) -> GBTClassificationModel | None:
        label, seed = member
        mine = held.where(F.col(label).isNotNull()).select("features", F.col(label).cast("double").alias("label"))
        if mine.select("label").distinct().count() < 2:
            return None
        return GBTClassifier(seed=seed, **settings).fit(mine)

    with ThreadPoolExecutor(3) as pool:
        return [m for m in pool.map(fit, [(label, s) for label in labels for s in seeds]) if m is not None]


class Attribution:
    """Margins of fitted models and the part of each feature in them.

    A step from a node to its child changes the mean that the tree gives; the change counts for the feature of the
    node's split. What a row's path adds up to by feature is known at each end, so a row needs its ends only. The parts
    and ``base``, the roots' means, add up to the margin.
    """

    def __init__(self, models: list[GBTClassificationModel], names: tuple[str, ...]) -> None:
        nodes = [(w / len(models), t._java_obj.rootNode()) for m in models for t, w in zip(m.trees, m.treeWeights, strict=True)]
        self.levels = max(1, max((t.depth for m in models for t in m.trees), default=1))
        width = 2 << self.levels
        axis, cut = np.full(len(nodes) * width, -1), np.zeros(len(nodes) * width)
        self.parts = np.zeros((len(names), len(nodes) * width))
        self.base = 0.0
        for tree, (weight, root) in enumerate(nodes):
            self.base += weight * root.prediction()
            open_ = [(1, root, np.zeros(len(names)))]
            while open_:
                at, node, path = open_.pop()
                self.parts[:, tree * width + at] = path
                if node.subtreeDepth() == 0:
                    continue
                split = node.split()
                axis[tree * width + at], cut[tree * width + at] = split.featureIndex(), split.threshold()
                for child, place in ((node.leftChild(), 2 * at), (node.rightChild(), 2 * at + 1)):
                    step = np.zeros(len(names))
                    step[split.featureIndex()] = weight * (child.prediction() - node.prediction())
                    open_.append((place, child, path + step))
        self.names, self.trees = names, Trees(names, len(nodes), self.levels, axis, cut)

    def explained(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``margin`` and, by feature, ``part_<name>``; missing features count as 0."""
        out = rows.fillna(0.0, list(self.names)).withColumn("__ends", self.trees.ends())
        parts = {f"part_{n}": self.trees.sum_at_ends(self.parts[i], "__ends") for i, n in enumerate(self.names)}
        return out.withColumns({**parts, "margin": F.lit(self.base) + self.trees.sum_at_ends(self.parts.sum(axis=0), "__ends")}).drop("__ends")


def mean_margin(models: list[GBTClassificationModel], rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``margin`` as the models' own raw predictions give it."""
    out = VectorAssembler(inputCols=list(names), outputCol="features").transform(rows.fillna(0.0, list(names)))
    from pyspark.ml.functions import vector_to_array

    for i, m in enumerate(models):
        out = m.setRawPredictionCol(f"raw{i}").setProbabilityCol("").setPredictionCol("").transform(out)
    total: Column = sum((vector_to_array(f"raw{i}")[1] for i in range(len(models))), F.lit(0.0)) / len(models)
    return out.withColumn("margin", total).drop("features", *[f"raw{i}" for i in range(len(models))])


def important_features(models: list[GBTClassificationModel], names: tuple[str, ...], most: int = 3) -> list[str]:
    """The features of the largest mean importance, for rows whose parts aren't known."""
    mean = np.mean([m.featureImportances.toArray() for m in models], axis=0)
    return [names[i] for i in np.lexsort((np.arange(len(names)), -mean))[:most] if mean[i] > 0]
