"""Labels, sample weights, folds, neutralised scores, and joins of panels with dimensions and other sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_ticker, percent_rank
from tidemark.operators.panel import forward_return, return_class

#: Names of the classes 0..4.
CLASS_NAMES = ("STRONG SELL", "SELL", "HOLD", "BUY", "STRONG BUY")
#: Least score of each label.
LABEL_BANDS = ((8, "STRONG BUY"), (6, "BUY"), (4, "HOLD"), (2, "SELL"), (0, "STRONG SELL"))


def class_name(target: Column) -> Column:
    """The name of a class; unknown and missing ones are "HOLD"."""
    names = F.create_map(*[x for i, name in enumerate(CLASS_NAMES) for x in (F.lit(i), F.lit(name))])
    return F.coalesce(F.try_element_at(names, target), F.lit("HOLD"))


def score_label(score: Column) -> Column:
    """The label of a score from 0 to 10."""
    out = F.when(score >= LABEL_BANDS[0][0], LABEL_BANDS[0][1])
    for least, name in LABEL_BANDS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("HOLD")


def with_targets(rows: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Forward return, class and class name for each horizon, in one window pass."""
    returns = rows.withColumns({f"fwd_{h}d": forward_return(h) for h in horizons})
    classes = returns.withColumns({f"target_{h}d": return_class(F.col(f"fwd_{h}d")) for h in horizons})
    return classes.withColumns({f"label_{h}d": class_name(F.col(f"target_{h}d")) for h in horizons})


def leaks(rows: DataFrame, target: str, horizon: int) -> DataFrame:
    """Per ticker: how many of its last ``horizon`` rows have a target, which only rows from the future could give."""
    last = rows.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("_k") <= horizon)
    return last.groupBy("ticker").agg(F.count(target).alias("n_leaks"), F.count("*").alias("n_last"))


def triple_barrier(rows: DataFrame, vol: str, horizon: int = 3, width: float = 1.0) -> DataFrame:
    """``barrier`` 1 if the path of the next rows touches ``width`` volatilities above, 0 if below; if both, the sign of the
    final return; null if neither, or where the volatility or the final return is missing."""
    ahead = by_ticker().rowsBetween(1, horizon)
    edge = F.col(vol) * F.lit(float(horizon)) ** 0.5 * width
    up, down, end = F.max("close").over(ahead) / F.col("close") - 1 >= edge, F.min("close").over(ahead) / F.col("close") - 1 <= -edge, forward_return(horizon)
    marked = rows.withColumns({"_up": up, "_down": down, "_end": end})
    label = F.when(F.col("_up") & F.col("_down"), (F.col("_end") > 0).cast("int")).when(F.col("_up"), 1).when(F.col("_down"), 0)
    return marked.withColumn("barrier", F.when(F.col("_end").isNotNull() & F.col(vol).isNotNull(), label)).drop("_up", "_down", "_end")


def uniqueness_weights(rows: DataFrame, horizon: int) -> DataFrame:
    """``uniqueness``: one over the mean number of label windows open at the rows of a row's own window, by row of a ticker."""
    counted = rows.withColumn("_open", F.least(F.row_number().over(by_ticker()) - 1, F.lit(horizon)) + 1)
    return counted.withColumn("uniqueness", 1 / F.avg("_open").over(by_ticker().rowsBetween(0, horizon))).drop("_open")


def walk_forward(rows: DataFrame, folds: int, purge: int, least: int = 300) -> DataFrame:
    """``(fold, role)`` for each row: expanding training dates, less the last ``purge`` of them, and the test block after.

    The dates are numbered once; each row is repeated for the folds it takes part in. Folds with fewer than ``least``
    training dates are left out.
    """
    numbered = rows.join(rows.select("date").distinct().withColumn("_d", F.row_number().over(Window.orderBy("date")) - 1), "date")
    total = rows.agg(F.count_distinct("date").alias("_n"))
    length = F.floor(F.col("_n") / (folds + 2))
    plan = total.select(F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), "_n").select("fold", (F.col("_n") - (folds - F.col("fold")) * length).alias("_end"), length.alias("_len")).where(F.col("_end") >= least)
    role = F.when(F.col("_d") < F.col("_end") - purge, "train").when((F.col("_d") >= F.col("_end")) & (F.col("_d") < F.col("_end") + F.col("_len")), "test")
    return numbered.crossJoin(F.broadcast(plan)).withColumn("role", role).where("role is not null").drop("_d", "_end", "_len")


def neutralise_fit(rows: DataFrame, score: str, beta: str, *keys: str) -> DataFrame:
    """``(*keys, sector, slope, intercept)`` of the score on beta and sectors: the slope within sectors, and an intercept for each."""
    whole = rows.where(F.col(score).isNotNull() & F.col(beta).isNotNull() & F.col("sector").isNotNull())
    means = whole.groupBy(*keys, "sector").agg(F.count("*").alias("n"), F.avg(score).alias("my"), F.avg(beta).alias("mb"), F.covar_pop(score, beta).alias("c"), F.var_pop(beta).alias("v"))
    group = Window.partitionBy(*keys)  # a row per sector
    slope = F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("c")).over(group), F.nullif(F.sum(F.col("n") * F.col("v")).over(group), F.lit(0.0))), F.lit(0.0))
    return means.withColumn("slope", slope).select(*keys, "sector", "slope", (F.col("my") - F.col("slope") * F.col("mb")).alias("intercept"))


def neutralise(rows: DataFrame, coefficients: DataFrame, score: str, beta: str, *keys: str) -> DataFrame:
    """``neutral``: the residual of the score. Rows without beta or a known sector keep their score, and so do all rows of a
    date that has too few (under half) complete ones."""
    joined = rows.join(coefficients, [*keys, "sector"], "left")
    residual = F.col(score) - F.col("intercept") - F.col("slope") * F.col(beta)
    enough = F.count(residual).over(Window.partitionBy("date")) >= 0.5 * F.count("*").over(Window.partitionBy("date"))
    return joined.withColumn("neutral", F.when(enough, F.coalesce(residual, F.col(score))).otherwise(F.col(score))).drop("slope", "intercept")


def rank_average(rows: DataFrame, members: tuple[str, ...]) -> DataFrame:
    """``ensemble``: the mean of the members' percent ranks on each date."""
    ranks = rows.withColumns({f"_r_{m}": percent_rank(F.col(m), "date") for m in members})
    return ranks.withColumn("ensemble", sum((F.col(f"_r_{m}") for m in members), F.lit(0.0)) / len(members)).drop(*[f"_r_{m}" for m in members])


def signed_combination(rows: DataFrame, slopes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``combined``: the sum of the features' scores on each date, each with the sign of its mean slope ``slopes(feature, mean_slope)``."""
    day = Window.partitionBy("date")
    signs = slopes.groupBy().pivot("feature", list(names)).agg(F.first(F.signum("mean_slope"))).select(*[F.col(c).alias(f"_s_{c}") for c in names])
    z = {f"_z_{c}": F.try_divide(F.col(c) - F.avg(c).over(day), F.nullif(F.stddev_samp(c).over(day), F.lit(0.0))) for c in names}
    scored = rows.withColumns(z).crossJoin(F.broadcast(signs))
    return scored.withColumn("combined", sum((F.coalesce(F.col(f"_s_{c}") * F.col(f"_z_{c}"), F.lit(0.0)) for c in names), F.lit(0.0))).drop(*z, *signs.columns)


def with_dimension(rows: DataFrame, dimension: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Rows with a dimension's columns; defaults where it has no row. Spark broadcasts a dimension below its threshold."""
    return rows.join(dimension, key, "left").fillna(defaults)


def near_event(rows: DataFrame, flag: str, days: int) -> DataFrame:
    """``near``: 1 if the ticker has a flagged row within so many calendar days, either way."""
    at = F.unix_date("date")
    w = Window.partitionBy("ticker").orderBy(at).rangeBetween(-days, days)
    return rows.withColumn("near", F.max(F.col(flag)).over(w))


def last_rows(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each ticker, 1 being the latest."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("back") <= n)


def universe(latest: DataFrame, quotes: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each ticker's last bar with a live quote and a prediction where there are any; the price is the freshest known."""
    joined = latest.join(quotes, "ticker", "left").join(predictions, "ticker", "left")
    price = F.coalesce("quote", "close")
    return joined.withColumns({"price": price, "live": F.col("quote").isNotNull(), "change_pct": F.try_divide(price, F.col("before")) * 100 - 100, "label": score_label(F.coalesce("score", F.lit(5)))})


def before_expiry(options: DataFrame, expiries: DataFrame, days: int) -> DataFrame:
    """Option rows on weekdays of the ``2 * days`` calendar days up to each expiry, with it: a range join on a small table."""
    near = (F.col("date") >= F.date_sub("expiry", 2 * days)) & (F.col("date") <= F.col("expiry")) & (F.weekday("date") < 5)
    return options.join(F.broadcast(expiries), near)


def explanations(rows: DataFrame) -> DataFrame:
    """``reasons``: what is unusual about a row, as one text; a default where nothing stands out."""
    said = F.array_compact(F.array(
        F.when(F.col("volume_zscore_20") > 2, F.concat(F.lit("Volume is "), F.round("volume_zscore_20", 1).cast("string"), F.lit(" deviations above its mean."))),
        F.when(F.col("delivery_pct") < 0.3, F.concat(F.lit("Delivery fell to "), F.round(F.col("delivery_pct") * 100, 1).cast("string"), F.lit(" %."))),
        F.when(F.col("intraday_reversal") > 0.6, F.lit("The price reversed within the day.")), F.when(F.col("circuit_proximity") > 0.9, F.lit("The price closed near its band.")),
    ))
    return rows.withColumn("reasons", F.when(F.size(said) > 0, F.array_join(said, " ")).otherwise("No single measure stands out."))


def strongest_signals(rows: DataFrame, names: tuple[str, ...], heavy: tuple[str, ...] = (), boost: float = 1.15, n: int = 3) -> DataFrame:
    """Each row's ``n`` largest contributions by weight, those of ``heavy`` names boosted; equal ones keep the order of names."""
    at = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("feature"), F.col(c).alias("value"), (F.abs(F.col(c)) * (boost if c in heavy else 1.0)).alias("w")) for i, c in enumerate(names)])
    kept = F.filter(at, lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]) & (F.abs(x["value"]) < float("inf")))
    best = F.slice(F.array_sort(F.transform(kept, lambda x: F.struct((-x["w"]).alias("w"), x["at"].alias("at"), x["feature"].alias("feature"), x["value"].alias("value")))), 1, n)
    return rows.select("ticker", "date", F.posexplode(best).alias("place", "s")).select("ticker", "date", (F.col("place") + 1).alias("place"), "s.feature", "s.value", F.when(F.col("s.value") > 0, "up").otherwise("down").alias("direction"))
