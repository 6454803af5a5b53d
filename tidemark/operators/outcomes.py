"""What became of scores: outcomes by score and holding period, spreads, significance by group, and books followed day by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import percent_rank
from tidemark.operators import books


def outcomes(rows: DataFrame, holds: tuple[int, ...]) -> DataFrame:
    """``(date, ticker, score, hold, ret, excess)`` of ``rows(date, ticker, score, fwd_<h>d)``.

    ``excess`` is over the mean of all names with an outcome on that date, scored or not. Rows without an outcome have
    none. An empty table gives an empty result.
    """
    long = rows.unpivot(["date", "ticker", "score"], [f"fwd_{h}d" for h in holds], "horizon", "ret").where("ret is not null")
    long = long.withColumn("hold", F.regexp_extract("horizon", r"(\d+)", 1).cast("int")).drop("horizon")
    return long.withColumn("excess", F.col("ret") - F.avg("ret").over(Window.partitionBy("date", "hold")))


def by_score(long: DataFrame) -> DataFrame:
    """One row per holding period and score; unscored rows are left out."""
    share = lambda x: F.avg((F.col(x) > 0).cast("double"))
    return long.where("score is not null").groupBy("hold", "score").agg(
        F.count("*").alias("n"), share("ret").alias("win_rate"), F.avg("ret").alias("mean_ret"), share("excess").alias("beat_market"),
        F.avg("excess").alias("mean_excess"), F.min("ret").alias("worst"), F.max("ret").alias("best"),
    )


def spread(long: DataFrame, top: int = 10, bottom: int = 1) -> DataFrame:
    """Per holding period: means and win rates of the top and the bottom score, and how far the means lie apart.

    A holding period that lacks one of the two is left out.
    """
    parts = []
    for name, score in (("top", top), ("bottom", bottom)):
        ret = F.when(F.col("score") == score, F.col("ret"))
        parts += [F.count(ret).alias(f"{name}_n"), F.avg(ret).alias(f"{name}_mean"), F.avg((ret > 0).cast("double")).alias(f"{name}_win_rate")]
    found = long.groupBy("hold").agg(*parts).where("top_n > 0 and bottom_n > 0")
    return found.withColumn("spread", F.col("top_mean") - F.col("bottom_mean"))


def significance(series: DataFrame, x: str, keys: tuple[str, ...], lag: Column, most: int, least: int = 10) -> DataFrame:
    """Per group of ``series(*keys, date, x)``: size, mean, the t of independent values and one with Bartlett weights up to
    the group's own ``lag``, which is ``most`` at most.

    A group has a row per date, so that its order is one small sort. Nulls are left out, and so are groups of fewer than
    ``least`` values; a t without spread is held down by a floor of 1e-16 under the variance of the sum.
    """
    rows = series.where(F.col(x).isNotNull()).select(*keys, "date", F.col(x).alias("x"), lag.alias("lag"))
    group = Window.partitionBy(*keys)
    order, e = group.orderBy("date"), F.col("x") - F.col("m")
    rows = rows.withColumn("m", F.avg("x").over(group))
    weight = lambda k: F.greatest(F.lit(0.0), 1 - F.lit(float(k)) / (F.col("lag") + 1))
    terms = [(2 * weight(k) * e * F.coalesce(F.lag(e, k).over(order), F.lit(0.0))).alias(f"g{k}") for k in range(1, most + 1)]
    rows = rows.select(*keys, "x", (e * e).alias("g0"), *terms)
    total = sum((F.sum(f"g{k}") for k in range(1, most + 1)), F.sum("g0"))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), total.alias("total"))
    n = F.col("n")
    naive = F.col("mean") / (F.col("sd") + 1e-12) * F.sqrt(n)
    robust = F.col("mean") / F.sqrt(F.greatest(F.col("total") / n, F.lit(1e-16)) / n)
    return found.where(n >= least).select(*keys, "n", "mean", naive.alias("naive_t"), robust.alias("t"))


def latest_entries(indexed: DataFrame, picks: DataFrame, entries: DataFrame) -> DataFrame:
    """``(hold, every, i, ticker, s, weight)``: what is held at session ``s`` of the books of ``entries(hold, every, i)``.

    An entry's picks ``(i, ticker, weight)`` are held for ``hold`` sessions. A later entry takes the whole book over, even
    within that time; an entry without picks is passed by, and the earlier one runs on to its own end.
    """
    entered = entries.join(picks.select("i").distinct(), "i").select("hold", "every", "i", F.col("i").alias("entry"))
    every = books.sessions(indexed).select("i").join(F.broadcast(entries.select("hold", "every").distinct()))  # a row per book
    past = Window.partitionBy("hold", "every").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    marked = every.join(entered, ["hold", "every", "i"], "left").withColumn("entry", F.last("entry", ignorenulls=True).over(past))
    held = marked.where(F.col("i") - F.col("entry") < F.col("hold"))
    return held.select("hold", "every", F.col("i").alias("s"), F.col("entry").alias("i")).join(picks, "i")


def followed(days: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per book of ``days(*keys, i, ret)``: growth over all sessions and the deepest fall, each session counting."""
    order = Window.partitionBy(*keys).orderBy("i")  # a row per session
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = days.withColumn("level", F.sum(F.log(F.greatest(1 + F.col("ret"), F.lit(1e-6)))).over(past))
    rows = rows.withColumn("fall", F.exp(F.col("level") - F.greatest(F.lit(0.0), F.max("level").over(past))) - 1)
    return rows.groupBy(*keys).agg(F.max_by("level", "i").alias("log_growth"), F.min("fall").alias("max_drawdown"), F.count_if(F.col("ret") != 0).alias("n_moved"))


def pooled_neutral(rows: DataFrame, coefficients: DataFrame, score: str, beta: str, *keys: str, digits: int = 9) -> DataFrame:
    """``rows`` with ``neutral``: the residual under fixed coefficients of each group of ``keys``, ranked within the date.

    Rows without beta or with a sector that the fit doesn't know keep their score. Residuals are rounded before they are
    ranked, since those of a perfect fit differ by what rounding leaves.
    """
    joined = rows.join(coefficients, [*keys, "sector"], "left")
    residual = F.coalesce(F.col(score) - F.col("intercept") - F.col("slope") * F.col(beta), F.col(score))
    joined = joined.withColumn("__rest", F.round(residual + 1.2345678e-7, digits)).drop("slope", "intercept")
    return joined.withColumn("neutral", percent_rank(F.col("__rest"), *keys, "date")).drop("__rest")
