"""Books of positions over a grid of sessions: selection, weights, holding, overlays and the statistics of daily returns.

Rows are ``(ticker, date, close, xs_rank, ...)``. A session is a distinct date with its index ``i``; positions are
``(i, ticker, weight)`` with the entry's session. Sessions number some 250 a year, so windows over them are small sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_ticker

TOP, LOW = 0.9, 0.1


def sessions(rows: DataFrame) -> DataFrame:
    """``(date, i)``: the distinct dates and their index from 0."""
    return rows.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def on_sessions(rows: DataFrame) -> DataFrame:
    """Rows with their session's index."""
    return rows.join(sessions(rows), "date")


def moves(indexed: DataFrame) -> DataFrame:
    """``(ticker, s, move)``: the return from session ``s`` to the next one; a ticker that pauses moves when it comes back."""
    return indexed.select("ticker", (F.lead("i").over(by_ticker()) - 1).alias("s"), (F.lead("close").over(by_ticker()) / F.col("close") - 1).alias("move")).where("move is not null")


def equal_weights(rows: DataFrame, chosen: Column) -> DataFrame:
    """The chosen rows of each session with equal weights."""
    return rows.where(chosen).select("i", "ticker", (1.0 / F.count("*").over(Window.partitionBy("i"))).alias("weight"))


def with_fallback(rows: DataFrame, strict: Column, loose: Column) -> DataFrame:
    """Equal weights of the rows that meet both conditions; a session where none does takes those of the loose one."""
    both = F.coalesce(strict & loose, F.lit(False))
    marked = rows.withColumn("any", F.max(both.cast("int")).over(Window.partitionBy("i")))
    return equal_weights(marked, F.coalesce(loose & (both | (F.col("any") == 0)), F.lit(False)))


def inverse_weights(rows: DataFrame, chosen: Column, vol: str) -> DataFrame:
    """The chosen rows weighted by the inverse of their volatility; rows without one have no weight."""
    held = rows.where(chosen & (F.col(vol) > 0)).withColumn("w", 1 / F.col(vol))
    return held.select("i", "ticker", (F.col("w") / F.sum("w").over(Window.partitionBy("i"))).alias("weight"))


def hedged(rows: DataFrame, kind: str) -> DataFrame:
    """Top names against the bottom ones (``dollar``, or ``beta`` with the short side scaled to the long side's beta, by
    0.3 to 3), or against all names of the session (``market``)."""
    w = Window.partitionBy("i")
    long, short = F.col("xs_rank") >= TOP, F.col("xs_rank") <= LOW
    n_long, n_short = F.count_if(long).over(w), F.count_if(short).over(w)
    marked = rows.withColumns({"n_long": n_long, "n_short": n_short, "n": F.count("*").over(w)})
    marked = marked.withColumns({"lw": F.when(long, 1.0 / F.col("n_long")).otherwise(0.0), "sw": F.when(short, 1.0 / F.col("n_short")).otherwise(0.0)})
    if kind == "market":
        return marked.where("n_long > 0").select("i", "ticker", (F.col("lw") - 1.0 / F.col("n")).alias("weight"))
    marked = marked.where("n_long > 0 and n_short > 0")
    ratio: Column = F.lit(1.0)
    if kind == "beta":
        side = {s: F.coalesce(F.sum(F.col("beta") * F.col(s)).over(w), F.lit(0.0)) for s in ("lw", "sw")}
        ratio = F.greatest(F.lit(0.3), F.least(F.lit(3.0), F.coalesce(F.try_divide(side["lw"], F.nullif(side["sw"], F.lit(0.0))), F.lit(1.0))))
    return marked.select("i", "ticker", (F.col("lw") - F.col("sw") * ratio).alias("weight")).where("weight <> 0")


def sector_pairs(rows: DataFrame, least: int = 2) -> DataFrame:
    """In each session and sector of at least so many names the best against the worst rank; sectors share equally."""
    w = Window.partitionBy("i", "sector")
    ranked = rows.where("xs_rank is not null").withColumns({"n": F.count("*").over(w), "best": F.row_number().over(w.orderBy(F.desc("xs_rank"), "ticker")), "worst": F.row_number().over(w.orderBy("xs_rank", "ticker"))})
    ranked = ranked.where(F.col("n") >= least)
    side = F.when(F.col("best") == 1, 1.0).when(F.col("worst") == 1, -1.0)
    pairs = ranked.withColumn("side", side).where("side is not null")
    return pairs.select("i", "ticker", (F.col("side") * 2.0 / F.count("*").over(Window.partitionBy("i"))).alias("weight"))


def persistent(rows: DataFrame, hold: int) -> DataFrame:
    """Top names that were top at the rebalance before as well; all top names where there is none, and at the first."""
    before = rows.select((F.col("i") + hold).alias("i"), "ticker", F.col("xs_rank").alias("rank_before"))
    return with_fallback(rows.join(before, ["i", "ticker"], "left"), F.col("rank_before") >= TOP, F.col("xs_rank") >= TOP)


def improving(rows: DataFrame, back: int = 5, share: float = 0.10) -> DataFrame:
    """The tenth of names (one at least) whose rank has risen most over so many sessions."""
    before = rows.select((F.col("i") + back).alias("i"), "ticker", F.col("xs_rank").alias("rank_before"))
    w = Window.partitionBy("i")
    changed = rows.join(before, ["i", "ticker"]).withColumn("rise", F.col("xs_rank") - F.col("rank_before")).where("rise is not null")
    changed = changed.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy(F.desc("rise"), "ticker"))})
    return equal_weights(changed, F.col("k") <= F.greatest(F.floor(F.col("n") * share), F.lit(1)))


def sector_capped(rows: DataFrame, cap: float = 0.40) -> DataFrame:
    """Equal weights of the top names, sectors cut to the cap once and all scaled to 1 again."""
    held = rows.where(F.col("xs_rank") >= TOP).withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("i")))
    held = held.withColumn("of_sector", F.sum("w").over(Window.partitionBy("i", "sector")))
    held = held.withColumn("w", F.when(F.col("of_sector") > cap, F.col("w") * cap / F.col("of_sector")).otherwise(F.col("w")))
    return held.select("i", "ticker", (F.col("w") / F.sum("w").over(Window.partitionBy("i"))).alias("weight"))


def held(positions: DataFrame, hold: int, tranches: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Positions on every session that they are held, from the entry on; tranches share the capital. ``keys`` tell books apart."""
    weight = F.col("weight") / hold if tranches else F.col("weight")
    return positions.select(*keys, "i", "ticker", weight.alias("weight"), F.explode(F.sequence(F.col("i"), F.col("i") + hold - 1)).alias("s"))


def on_grid(rows: DataFrame, hold: int) -> DataFrame:
    """Rows of every ``hold``-th session."""
    return rows.where(F.col("i") % hold == 0)


def stopped(on: DataFrame, indexed: DataFrame, stop: float = -0.10) -> DataFrame:
    """Held rows but those whose price is more than ``-stop`` below the entry's; a session without a price keeps them."""
    entry = indexed.select("i", "ticker", F.col("close").alias("paid"))
    now = indexed.select(F.col("i").alias("s"), "ticker", F.col("close").alias("now"))
    marked = on.join(entry, ["i", "ticker"]).join(now, ["s", "ticker"], "left")
    return marked.where(F.col("now").isNull() | (F.col("now") / F.col("paid") - 1 > stop)).select("i", "ticker", "weight", "s")


def decayed(positions: DataFrame, indexed: DataFrame, hold: int, floor: float = 0.667, most: int = 60) -> DataFrame:
    """Tranches that end when a name's rank falls below the floor, after ``most`` sessions at the latest, one at least."""
    on = held(positions, most).withColumn("weight", F.col("weight") / hold)
    ranks = indexed.select(F.col("i").alias("s"), "ticker", "xs_rank")
    marked = on.join(ranks, ["s", "ticker"], "left")
    so_far = Window.partitionBy("i", "ticker").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    fallen = F.max(F.when(F.col("xs_rank") < floor, 1).otherwise(0)).over(so_far)
    return marked.withColumn("fallen", fallen).where((F.col("fallen") == 0) | (F.col("s") == F.col("i"))).select("i", "ticker", "weight", "s")


def daily_returns(on: DataFrame, indexed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, i, date, ret)`` of every session: the weighted moves of what is held; 0 where nothing is."""
    found = on.join(moves(indexed), ["ticker", "s"]).groupBy(*keys, "s").agg(F.sum(F.col("weight") * F.col("move")).alias("ret"))
    every = sessions(indexed)
    if keys:
        every = every.crossJoin(F.broadcast(on.select(*keys).distinct()))  # a row per book
    return every.join(found.withColumnRenamed("s", "i"), [*keys, "i"], "left").select(*keys, "i", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def refilled(indexed: DataFrame, every: int, starts: tuple[int, ...], keeps: tuple[float, ...], size: int = 10) -> DataFrame:
    """``(start, keep, i, names, changed)``: books that are reviewed every ``every`` sessions from ``start`` on.

    At a review names whose rank is ``keep`` or more stay, and the best others fill the book up to ``size``; ties go to
    the first name. What a review holds depends on the one before, so a book is a fold over its reviews, in one row. Only
    names that can matter are in it: strong ones, and the ``2 * size`` best of a review.
    """
    least = min(keeps)
    plan = F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.lit(k).alias("keep")) for s in starts for k in keeps]))
    rows = indexed.where(F.col("xs_rank").isNotNull()).select("i", "ticker", "xs_rank")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("xs_rank"), "ticker")))
    rows = rows.where((F.col("xs_rank") >= least) | (F.col("place") <= 2 * size))
    reviews = rows.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("place", "ticker", "xs_rank"))).alias("ranked"))
    reviews = reviews.withColumn("p", plan).select("p.*", "i", "ranked").where(F.col("i") % every == F.col("start"))
    whole = reviews.groupBy("start", "keep").agg(F.array_sort(F.collect_list(F.struct("i", "ranked"))).alias("reviews"))
    kind = "struct<held:array<string>,out:array<struct<i:int,names:array<string>,changed:bigint>>>"

    def review(state: Column, r: Column) -> Column:
        before = state["held"]
        strong = F.transform(F.filter(r["ranked"], lambda x: x["xs_rank"] >= F.col("keep")), lambda x: x["ticker"])
        stay = F.array_intersect(before, strong)
        others = F.array_except(F.transform(r["ranked"], lambda x: x["ticker"]), stay)
        come = F.slice(others, 1, F.greatest(F.lit(0), size - F.size(stay)))
        names = F.concat(stay, come)
        changed = F.size(F.array_except(before, names)) + F.size(F.array_except(names, before))
        entry = F.struct(r["i"].cast("int").alias("i"), names.alias("names"), changed.cast("long").alias("changed"))
        return F.struct(names.alias("held"), F.array_append(state["out"], entry).alias("out")).cast(kind)

    nothing = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast("array<struct<i:int,names:array<string>,changed:bigint>>").alias("out")).cast(kind)
    found = whole.select("start", "keep", F.aggregate("reviews", nothing, review, lambda s: s["out"]).alias("out"))
    return found.select("start", "keep", F.inline("out"))


def vol_targeted(days: DataFrame, target: float = 0.20, window: int = 60, least: int = 20) -> DataFrame:
    """Daily returns times the leverage that the deviation of the days before calls for, within 0.3 and 2; 1 without one."""
    order = Window.orderBy("i")
    w = order.rowsBetween(1 - window, 0)
    vol = days.withColumn("vol", F.when(F.count("ret").over(w) >= least, F.stddev_samp("ret").over(w) * (252**0.5)))
    before = F.lag("vol").over(order)
    lever = F.when(before.isNull(), 1.0).when(before <= target / 2, 2.0).otherwise(F.greatest(F.lit(0.3), F.try_divide(F.lit(target), before)))
    return vol.withColumn("leverage", lever).select("i", "date", (F.col("ret") * F.col("leverage")).alias("ret"), "leverage")


def summary(days: DataFrame, cost: Column, lag: int = 5) -> DataFrame:
    """Per ``book``: days, log growth before and after the daily cost, Sharpe ratio, worst drawdown of the net curve, share of
    days above zero, and the Newey-West t. A day that loses everything leaves a millionth."""
    w = Window.partitionBy("book")
    order = w.orderBy("i")  # a row per session of a book
    rows = days.withColumn("net", F.col("ret") - cost)
    rows = rows.withColumns({"gain": F.log(F.greatest(1 + F.col("ret"), F.lit(1e-6))), "net_gain": F.log(F.greatest(1 + F.col("net"), F.lit(1e-6))), "e": F.col("net") - F.avg("net").over(w)})
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", F.sum("net_gain").over(past)).withColumns({f"g{k}": F.col("e") * F.lag("e", k).over(order) for k in range(1, lag + 1)})
    rows = rows.withColumn("fall", F.exp(F.col("level") - F.max("level").over(past)) - 1)
    total = sum((2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(f"g{k}"), F.lit(0.0)) for k in range(1, lag + 1)), F.sum(F.col("e") * F.col("e")))
    found = rows.groupBy("book").agg(F.count("*").alias("n_days"), F.sum("gain").alias("log_growth"), F.sum("net_gain").alias("net_log_growth"), F.avg("net").alias("mean_net"), (F.avg("net") / (F.stddev_samp("net") + 1e-12) * 252**0.5).alias("sharpe"), F.min("fall").alias("max_drawdown"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), total.alias("total"))
    return found.withColumn("t", F.col("mean_net") / F.sqrt(F.greatest(F.col("total") / F.col("n_days"), F.lit(1e-16)) / F.col("n_days"))).drop("total")


def period_sweep(rows: DataFrame, holds: tuple[int, ...], bps: float = 10.0, vol: str | None = None) -> DataFrame:
    """Per holding period and every so many dates with an outcome: mean of the top names (by inverse volatility if given),
    of all names, net of cost for both sides of the trade."""
    outs = rows.select("date", "ticker", "xs_rank", *([vol] if vol else []), *[F.col(f"fwd_{h}d") for h in holds])
    long = outs.unpivot(["date", "ticker", "xs_rank", *([vol] if vol else [])], [f"fwd_{h}d" for h in holds], "horizon", "ret").where("ret is not null")
    long = long.withColumn("hold", F.regexp_extract("horizon", r"(\d+)", 1).cast("int"))
    chosen = F.col("xs_rank") >= TOP
    mean = F.avg(F.when(chosen, F.col("ret"))) if vol is None else F.try_divide(F.sum(F.when(chosen, F.col("ret") / F.col(vol))), F.sum(F.when(chosen, 1 / F.col(vol))))
    days = long.groupBy("hold", "date").agg(mean.alias("book"), F.avg("ret").alias("market"))
    grid = days.withColumn("k", F.row_number().over(Window.partitionBy("hold").orderBy("date")) - 1).where(F.col("k") % F.col("hold") == 0).where("book is not null")
    return grid.withColumn("net", F.col("book") - 4 * bps / 1e4).drop("k")


def sweep_summary(periods: DataFrame) -> DataFrame:
    """Per holding period: periods, growth, annualised, win rate, how often the market is beaten, worst, best and drawdown."""
    w = Window.partitionBy("hold").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = periods.withColumn("level", F.sum(F.log(F.greatest(1 + F.col("net"), F.lit(1e-6)))).over(w)).withColumn("fall", F.exp(F.col("level") - F.greatest(F.lit(0.0), F.max("level").over(w))) - 1)
    found = rows.groupBy("hold").agg(
        F.count("*").alias("n"), F.sum(F.log(F.greatest(1 + F.col("net"), F.lit(1e-6)))).alias("net_log_growth"), F.avg("book").alias("mean_book"), F.avg("market").alias("mean_market"), F.avg((F.col("book") > 0).cast("double")).alias("win_rate"),
        F.avg((F.col("book") > F.col("market")).cast("double")).alias("beat_market"), F.min("book").alias("worst"), F.max("book").alias("best"), F.min("fall").alias("max_drawdown"),
    )
    return found.withColumn("annual_log_growth", F.col("net_log_growth") * 252 / (F.col("n") * F.col("hold")))


def top_runs(indexed: DataFrame) -> DataFrame:
    """``(ticker, length)``: runs of sessions in a row with a top rank; a session without a row ends a run."""
    top = indexed.where(F.col("xs_rank") >= TOP).select("ticker", "date", "i", (F.col("i") - F.row_number().over(by_ticker())).alias("run"))
    return top.groupBy("ticker", "run").agg(F.count("*").alias("length")).drop("run")


def decay_curve(rows: DataFrame, horizons: int = 30, least: int = 10, days: int = 30) -> DataFrame:
    """``(h, n_days, mean_ic, t, of_peak, peak_h, half_life)``: rank correlation of today's rank with the returns over each horizon.

    ``t`` allows for overlap up to the horizon; ``half_life`` is the first horizon after the peak with half of its
    correlation or less. Horizons with fewer than ``days`` dates are left out. All horizons are taken in one window pass
    and ranked together.
    """
    from tidemark.functions.windows import percent_rank

    leads = rows.select("date", "ticker", "xs_rank", *[(F.lead("close", h).over(by_ticker()) / F.col("close") - 1).alias(str(h)) for h in range(1, horizons + 1)])
    long = leads.unpivot(["date", "ticker", "xs_rank"], [str(h) for h in range(1, horizons + 1)], "h", "ret").where("ret is not null and xs_rank is not null").withColumn("h", F.col("h").cast("int"))
    ranked = long.select("h", "date", percent_rank(F.col("xs_rank"), "h", "date").alias("a"), percent_rank(F.col("ret"), "h", "date").alias("b"))
    safe = F.try_divide(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b"))
    daily = ranked.groupBy("h", "date").agg(F.count("*").alias("n"), safe.alias("ic")).where((F.col("n") >= least) & F.col("ic").isNotNull())
    by_h = Window.partitionBy("h")
    order = by_h.orderBy("date")  # a row per date of a horizon
    daily = daily.withColumn("e", F.col("ic") - F.avg("ic").over(by_h))
    daily = daily.withColumns({f"g{k}": F.col("e") * F.lag("e", k).over(order) for k in range(1, horizons)})
    lag = F.greatest(F.col("h") - 1, F.lit(1))
    total = F.sum(F.col("e") * F.col("e"))
    for k in range(1, horizons):
        total = total + F.when(lag >= k, 2 * (1 - k / (lag + 1))).otherwise(0.0) * F.coalesce(F.sum(f"g{k}"), F.lit(0.0))
    curve = daily.groupBy("h").agg(F.count("*").alias("n_days"), F.avg("ic").alias("mean_ic"), total.alias("total")).where(F.col("n_days") >= days)
    whole = Window.partitionBy()  # a row per horizon
    curve = curve.withColumn("t", F.col("mean_ic") / F.sqrt(F.greatest(F.col("total") / F.col("n_days"), F.lit(1e-16)) / F.col("n_days")))
    curve = curve.withColumns({"top": F.max("mean_ic").over(whole), "peak_h": F.max_by("h", F.struct("mean_ic", -F.col("h"))).over(whole)})
    late = F.when((F.col("h") > F.col("peak_h")) & (F.col("mean_ic") <= F.col("top") / 2), F.col("h"))
    return curve.select("h", "n_days", "mean_ic", "t", F.try_divide("mean_ic", "top").alias("of_peak"), "peak_h", F.min(late).over(whole).alias("half_life"))


def regimes(rows: DataFrame) -> DataFrame:
    """Per date, known the session before: market sums and deviation over 20 sessions, mean breadth, and the fall from the peak."""
    days = rows.groupBy("date").agg(F.avg("ret_1d").alias("market"), F.avg(F.when(F.col("ret_5d") > 0, 1.0).otherwise(0.0)).alias("up_share"))
    order = Window.orderBy("date")
    w, past = order.rowsBetween(-19, 0), order.rowsBetween(Window.unboundedPreceding, 0)
    full = F.count("market").over(w) == 20
    days = days.withColumns({"trend_20": F.when(full, F.sum("market").over(w)), "vol_20": F.when(full, F.stddev_samp("market").over(w)), "breadth_20": F.when(F.count("up_share").over(w) == 20, F.avg("up_share").over(w)), "level": F.sum("market").over(past)})
    days = days.withColumn("fall", F.col("level") - F.max("level").over(past))
    return days.select("date", *[F.lag(c).over(order).alias(c) for c in ("trend_20", "vol_20", "breadth_20", "fall")])


def capacity(rows: DataFrame, shares: tuple[float, ...] = (0.05, 0.10)) -> DataFrame:
    """Money that the top names take at a share of the tenth percentile of their mean daily turnover over 20 rows."""
    w = by_ticker().rowsBetween(-19, 0)
    adv = rows.withColumn("adv", F.when(F.count("turnover").over(w) == 20, F.avg("turnover").over(w)))
    chosen = adv.where(F.col("xs_rank") >= TOP)
    found = chosen.agg(F.percentile("adv", 0.1).alias("p10"), (F.count("*") / F.count_distinct("date")).alias("positions"))
    return found.select("p10", "positions", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("capacity", F.col("p10") * F.col("share") * F.col("positions"))
