"""Reports on flags, scores and outcomes: effect sizes, agreement, tests of proportions and ranks, curves and moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_ticker
from tidemark.operators.cleaning import long_form
from tidemark.operators.order import average_ranks, with_offsets
from tidemark.sources.staging import staged


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0 (Abramowitz and Stegun 26.2.17, within 7.5e-8)."""
    # The coefficients of the published approximation.
    t = 1 / (1 + 0.2316419 * z)
    terms = ((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * terms


def flag_rates(rows: DataFrame, flags: tuple[str, ...], *keys: str) -> DataFrame:
    """Share of each flag per group, with the number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"{f}_rate") for f in flags])


def effect_sizes(rows: DataFrame, flag: str, names: tuple[str, ...]) -> DataFrame:
    """Cohen's d of each feature between flagged and other rows; the deviation is the root of the mean variance."""
    values = long_form(rows, names, (flag,))
    side = {s: F.when(F.col(flag) == yes, F.col("value")) for s, yes in (("flagged", 1), ("other", 0))}
    found = values.groupBy("feature").agg(*[f(side[s]).alias(f"{s}_{n}") for s in side for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    pooled = F.sqrt((F.pow("flagged_std", 2) + F.pow("other_std", 2)) / 2)
    return found.withColumn("cohens_d", F.try_divide(F.col("flagged_mean") - F.col("other_mean"), pooled)).select("feature", "flagged_mean", "other_mean", "cohens_d")


def _pairs(names: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(a, b) for a in names for b in names]


def _one_row_to_pairs(found: DataFrame, names: tuple[str, ...], as_name: str) -> DataFrame:
    """The columns ``a|b`` of a single row as rows ``(a, b, value)``."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias(as_name)) for a, b in _pairs(names)])
    return found.select(F.inline(pairs))


def jaccard(rows: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """``(a, b, jaccard)`` of all pairs of flags in one pass; 1 on the diagonal, 0 where neither occurs."""
    both = lambda a, b: F.count_if((F.col(a) == 1) & (F.col(b) == 1))
    any_ = lambda a, b: F.count_if((F.col(a) == 1) | (F.col(b) == 1))
    found = rows.agg(*[(F.lit(1.0) if a == b else F.coalesce(F.try_divide(both(a, b), any_(a, b)), F.lit(0.0))).alias(f"{a}|{b}") for a, b in _pairs(flags)])
    return _one_row_to_pairs(found, flags, "jaccard")


def spearman_matrix(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``(a, b, rho)`` of all pairs of columns over the rows that have all of them. Ranks come from counts by value,
    carried between bins of each column, so that no task sorts the table."""
    ranks = staged(rows.select(*names).dropna())
    for c in names:
        ranks = ranks.join(average_ranks(ranks, c, f"_{c}").drop("times"), c)
    ranks = ranks.select(*[F.col(f"_{c}").alias(c) for c in names])
    found = ranks.agg(*[F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias(f"{a}|{b}") for a, b in _pairs(names)])
    return _one_row_to_pairs(found, names, "rho")


def event_gaps(rows: DataFrame, flag: str, least_total: int = 10, least: int = 3) -> DataFrame:
    """Days between a ticker's flagged rows: mean, median, extremes, deviation and its ratio to the mean."""
    events = rows.where(F.col(flag) == 1).withColumn("gap", F.datediff("date", F.lag("date").over(by_ticker())))
    found = events.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.percentile("gap", 0.5).alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.stddev_samp("gap").alias("std_gap"))
    found = found.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row per ticker
    return found.where((F.col("total") >= least_total) & (F.col("n") >= least)).withColumn("cov", F.try_divide("std_gap", "mean_gap")).drop("total")


def event_gap_means(rows: DataFrame, flags: tuple[str, ...], least_total: int = 10, least: int = 3) -> DataFrame:
    """Per flag the means over tickers of what ``event_gaps`` says of each, and how many tickers there are; flags of fewer than
    ``least_total`` rows and tickers of fewer than ``least`` are left out. All flags go in one pass."""
    events = rows.unpivot(["ticker", "date"], list(flags), "flag", "on").where(F.col("on") == 1)
    order = Window.partitionBy("flag", "ticker").orderBy("date")
    events = events.withColumn("gap", F.datediff("date", F.lag("date").over(order)))
    found = events.groupBy("flag", "ticker").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.percentile("gap", 0.5).alias("median_gap"), F.stddev_samp("gap").alias("std_gap"))
    found = found.withColumn("total", F.sum("n").over(Window.partitionBy("flag"))).where((F.col("total") >= least_total) & (F.col("n") >= least))  # a row per flag and ticker
    found = found.withColumn("cov", F.try_divide("std_gap", "mean_gap"))
    return found.groupBy("flag").agg(F.count("*").alias("n_tickers"), *[F.avg(x).alias(x) for x in ("mean_gap", "median_gap", "std_gap", "cov")])


def tilt(rows: DataFrame, rank: str, x: str, share: float = 0.1) -> DataFrame:
    """Mean of ``x`` among the highest ranks less that among the lowest."""
    top, low = F.avg(F.when(F.col(rank) >= 1 - share, F.col(x))), F.avg(F.when(F.col(rank) <= share, F.col(x)))
    return rows.agg(top.alias("top"), low.alias("low")).withColumn("tilt", F.col("top") - F.col("low"))


def two_proportions(rows: DataFrame, flag: str, group: str) -> DataFrame:
    """Rates of a flag inside and outside a group, their ratio, z and the two-sided probability."""
    n1, n0 = F.count_if(F.col(group) == 1), F.count_if(F.col(group) == 0)
    x1, x0 = F.count_if((F.col(group) == 1) & (F.col(flag) == 1)), F.count_if((F.col(group) == 0) & (F.col(flag) == 1))
    found = rows.agg(n1.alias("n1"), n0.alias("n0"), x1.alias("x1"), x0.alias("x0")).withColumns({"rate1": F.try_divide("x1", "n1"), "rate0": F.try_divide("x0", "n0"), "p": F.try_divide(F.col("x1") + F.col("x0"), F.col("n1") + F.col("n0"))})
    z = F.try_divide(F.col("rate1") - F.col("rate0"), F.sqrt(F.col("p") * (1 - F.col("p")) * (1 / F.col("n1") + 1 / F.col("n0"))))
    return found.withColumn("ratio", F.when(F.col("rate0") > 0, F.col("rate1") / F.col("rate0")).when(F.col("rate1") > 0, F.lit(float("inf")))).withColumn("z", z).withColumn("p_value", 2 * normal_tail(F.abs("z"))).drop("p")


def rank_sum(rows: DataFrame, x: str, flag: str) -> DataFrame:
    """Mann-Whitney U of flagged against other rows with tie-corrected z, the one-sided probability of "less", and the AUC."""
    values = rows.where(F.col(x).isNotNull() & F.col(flag).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count_if(F.col(flag) == 1).alias("k1"), F.count("*").alias("k"))
    ranked = with_offsets(staged(values), "x", "k")[0].withColumn("rank", F.col("before") + (F.col("k") + 1) / 2)
    found = ranked.agg(F.sum("k1").alias("n1"), F.sum(F.col("k") - F.col("k1")).alias("n0"), F.sum(F.col("rank") * F.col("k1")).alias("r1"), F.sum(F.pow(F.col("k").cast("double"), 3) - F.col("k")).alias("ties"))
    n1, n0, n = F.col("n1"), F.col("n0"), F.col("n1") + F.col("n0")
    found = found.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    found = found.withColumn("z", F.try_divide(F.col("u") - n1 * n0 / 2 + 0.5, sd))
    less = F.when(F.col("z") >= 0, 1 - normal_tail(F.abs("z"))).otherwise(normal_tail(F.abs("z")))
    return found.select("n1", "n0", "u", "z", less.alias("p_less"), F.try_divide("u", n1 * n0).alias("auc"))


def heaviest_strike(options: DataFrame) -> DataFrame:
    """The strike of most open interest per symbol and date; the lowest of equals."""
    totals = options.groupBy("symbol", "date", "strike").agg(F.sum("open_interest").alias("total"))
    return totals.groupBy("symbol", "date").agg(F.max(F.struct("total", (-F.col("strike")).alias("low"))).alias("m")).select("symbol", "date", (-F.col("m.low")).alias("strike"), F.col("m.total").alias("open_interest"))


def agreement(rows: DataFrame, flags: tuple[str, ...], scores: tuple[str, ...], least: int = 2) -> DataFrame:
    """How many flags agree, whether ``least`` do, and the mean of the scores scaled to 0..1 over the table; a constant score counts 0."""
    bounds = rows.agg(*[F.struct(F.min(s).alias("lo"), F.max(s).alias("hi")).alias(f"_{s}") for s in scores])
    count = sum((F.coalesce(F.col(f), F.lit(0)) for f in flags), F.lit(0))
    scaled = [F.when(F.col(f"_{s}.hi") > F.col(f"_{s}.lo"), (F.col(s) - F.col(f"_{s}.lo")) / (F.col(f"_{s}.hi") - F.col(f"_{s}.lo"))).otherwise(0.0) for s in scores]
    return rows.crossJoin(F.broadcast(bounds)).withColumns({"agreement_count": count, "combined_score": sum(scaled, F.lit(0.0)) / len(scores)}).withColumn("consensus", (F.col("agreement_count") >= least).cast("int")).drop(*bounds.columns)


def class_weights(rows: DataFrame, target: str, classes: int = 5, root: bool = False) -> DataFrame:
    """Weight of each class, rarer ones heavier, scaled to a mean of 1; 1 throughout without any label, 0 for absent classes."""
    every = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    counts = rows.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("int").alias("class")).agg(F.count("*").alias("n"))
    found = every.join(counts, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = Window.partitionBy()  # a row per class
    raw = F.try_divide(F.sum("n").over(whole), F.col("n") * F.sum((F.col("n") > 0).cast("int")).over(whole))
    found = found.withColumn("raw", F.coalesce(F.sqrt(raw) if root else raw, F.lit(0.0)))
    return found.withColumn("weight", F.coalesce(F.try_divide("raw", F.avg(F.when(F.col("n") > 0, F.col("raw"))).over(whole)), F.lit(1.0))).drop("raw")


def deciles(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Mean outcome by decile of ``x`` over all rows with both; equal scores keep the order of date and ticker.

    Rows are numbered within each score, after the counts of the smaller ones, which carry over between bins."""
    both = staged(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("ticker", "date", F.col(x).alias("x"), F.col(y).alias(y)))
    before, n = with_offsets(both.groupBy("x").agg(F.count("*").alias("times")), "x", "times")
    equal = Window.partitionBy("x").orderBy("date", "ticker")
    ranked = both.join(before, "x").select(y, (F.col("before") + F.row_number().over(equal)).alias("rn"), F.lit(n).alias("n"))
    decile = F.greatest(F.ceil((F.col("rn") - 1) * 10 / (F.col("n") - 1) - 1e-9) - 1, F.lit(0)).cast("int")
    return ranked.groupBy(decile.alias("decile")).agg(F.count("*").alias("n"), F.avg(y).alias("mean_ret"))


def moments(rows: DataFrame, x: str, trials: int = 1) -> DataFrame:
    """Mean, deviation, Sharpe ratio, skewness, raw kurtosis, value at risk, expected shortfall, and the probability
    that the true Sharpe ratio is above zero (and above that expected of the best of so many trials)."""
    base = rows.where(F.col(x).isNotNull()).select(F.col(x).alias("x"))
    stats = base.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.skewness("x").alias("skew"), (F.kurtosis("x") + 3).alias("kurtosis"), F.percentile("x", F.array(*map(F.lit, (0.05, 0.5, 0.75, 0.9, 0.95)))).alias("q"))
    tail = base.crossJoin(F.broadcast(stats.select(F.col("q")[0].alias("cut")))).where("x <= cut").agg(F.avg("x").alias("cvar"))
    found = stats.crossJoin(F.broadcast(tail)).withColumn("sharpe", F.try_divide("mean", "std"))
    spread = F.sqrt((1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.pow("sharpe", 2)) / (F.col("n") - 1))
    for name, over in (("psr", 0.0), ("dsr", expected_best(trials))):
        z = (F.col("sharpe") - over * spread) / spread
        found = found.withColumn(name, F.when(z >= 0, 1 - normal_tail(F.abs(z))).otherwise(normal_tail(F.abs(z))))
    return found.select("n", "mean", "std", "sharpe", "skew", "kurtosis", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((5, 50, 75, 90, 95))], "cvar", "psr", "dsr")


def expected_best(n: int) -> float:
    """Expected maximum of ``n`` standard normal values, by quadrature of its density."""
    from statistics import NormalDist

    if n <= 1:
        return 0.0
    normal, step = NormalDist(), 0.001
    return math.fsum(x * n * normal.pdf(x) * normal.cdf(x) ** (n - 1) for x in (i * step for i in range(-8000, 8001))) * step


def split_halves(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Means of ``y`` below and above the median of ``x``, their difference and the correlation of the two."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    cut = both.agg(F.percentile("x", 0.5).alias("cut"))
    low, high = F.avg(F.when(F.col("x") <= F.col("cut"), F.col("y"))), F.avg(F.when(F.col("x") > F.col("cut"), F.col("y")))
    return both.crossJoin(F.broadcast(cut)).agg(F.count("*").alias("n"), low.alias("low_half"), high.alias("high_half"), (high - low).alias("difference"), F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("corr"))


def daily_slopes(rows: DataFrame, names: tuple[str, ...], y: str, least: int = 15) -> DataFrame:
    """``(feature, date, slope)`` of ``y`` on each feature, standardised on its date, over at least so many pairs."""
    values = long_form(rows, names, ("date", y)).where(F.col("value").isNotNull() & F.col(y).isNotNull())
    # on a standardised x the slope is the covariance over the deviation
    found = values.groupBy("feature", "date").agg(F.count("*").alias("n"), F.covar_samp("value", y).alias("c"), F.stddev_samp("value").alias("s"))
    return found.where((F.col("n") >= least) & (F.col("s") > 0)).select("feature", "date", (F.col("c") / F.col("s")).alias("slope"))


def fama_macbeth(rows: DataFrame, names: tuple[str, ...], y: str, least: int = 15, days: int = 30, lag: int = 2) -> DataFrame:
    """Mean daily slope of each feature and its Newey-West t, over at least so many dates."""
    slopes = daily_slopes(rows, names, y, least)
    w = Window.partitionBy("feature")
    e = slopes.withColumn("e", F.col("slope") - F.avg("slope").over(w))
    order = w.orderBy("date")  # a row per date
    e = e.withColumns({f"g{k}": F.col("e") * F.lag("e", k).over(order) for k in range(1, lag + 1)})
    total = sum((2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(f"g{k}"), F.lit(0.0)) for k in range(1, lag + 1)), F.sum(F.col("e") * F.col("e")))
    found = e.groupBy("feature").agg(F.count("*").alias("n_days"), F.avg("slope").alias("mean_slope"), total.alias("total")).where(F.col("n_days") >= days)
    return found.select("feature", "n_days", "mean_slope", (F.col("mean_slope") / F.sqrt(F.greatest(F.col("total") / F.col("n_days"), F.lit(1e-16)) / F.col("n_days"))).alias("t"))


def rule_outcomes(rows: DataFrame, rules: dict[str, Column], horizons: tuple[str, ...], least: int = 30) -> DataFrame:
    """Per rule and horizon with enough rows: rows, rows a day, win rate, mean and median; rows are scanned once."""
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    held = rows.withColumn("rule", F.explode(hits)).select("date", "rule", *horizons).unpivot(["date", "rule"], list(horizons), "horizon", "ret").where("ret is not null")
    found = held.groupBy("rule", "horizon").agg(F.count("*").alias("n"), (F.count("*") / F.count_distinct("date")).alias("per_day"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("ret").alias("mean_ret"), F.percentile("ret", 0.5).alias("median_ret"))
    return found.where(F.col("n") >= least)
