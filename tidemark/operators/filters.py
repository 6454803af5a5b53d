"""Filters on rows with an outcome: what each adds, and whether the best of one half of the dates hold on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewer rows than this are no figure.
LEAST = 30


def halves(rows: DataFrame) -> DataFrame:
    """``half`` A for dates before the middle one of all, B from it on."""
    days = rows.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row per date
    middle = days.agg(F.floor(F.count("*") / 2).alias("i")).join(days, "i").select(F.col("date").alias("__middle"))
    return rows.join(F.broadcast(middle)).withColumn("half", F.when(F.col("date") < F.col("__middle"), "A").otherwise("B")).drop("__middle")


def _figures(y: str) -> list[Column]:
    return [
        F.count("*").alias("n"), (F.count("*") / F.count_distinct("date")).alias("per_day"), F.avg((F.col(y) > 0).cast("double")).alias("win"), F.avg(y).alias("mean"), F.percentile(y, 0.5).alias("median"),
    ]


def met(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` once for each rule that they meet, with its ``rule``; a rule over a missing value isn't met."""
    held = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.withColumn("rule", F.explode(held))


def lifts(rows: DataFrame, rules: dict[str, Column], y: str) -> DataFrame:
    """``(rule, n, per_day, win, mean, median, lift)`` over rows with an outcome ``y``; all rules in one pass."""
    known = rows.where(F.col(y).isNotNull())
    whole = known.agg(F.avg((F.col(y) > 0).cast("double")).alias("whole"))
    found = met(known, rules).groupBy("rule").agg(*_figures(y)).where(F.col("n") >= LEAST)
    return found.join(F.broadcast(whole)).withColumn("lift", F.col("win") - F.col("whole")).drop("whole")  # a row


def combined(rows: DataFrame, rules: dict[str, Column], y: str, most: int) -> DataFrame:
    """``(size, rules, half, n, ...)``: the ``most`` rules of the largest lift on half A, the first ``size`` of them together, on
    both halves; size 0 is all rows. Equal lifts keep the order of names."""
    known = rows.where(F.col(y).isNotNull())
    best = lifts(known.where("half = 'A'"), rules, y).orderBy(F.desc(F.round("win", 12)), "rule").limit(most).select("rule")
    names = [r["rule"] for r in best.collect()]  # ``most`` names
    sizes = [F.lit(0)] + [F.when(_all([rules[n] for n in names[:size]]), F.lit(size)) for size in range(1, len(names) + 1)]
    grouped = known.withColumn("size", F.explode(F.array_compact(F.array(*sizes)))).groupBy("size", "half").agg(*_figures(y)).where(F.col("n") >= LEAST)
    texts = F.array(*[F.lit(" + ".join(names[:size])) for size in range(len(names) + 1)])
    return grouped.withColumn("rules", F.get(texts, F.col("size")))


def _all(rules: list[Column]) -> Column:
    held = F.lit(True)
    for rule in rules:
        held &= F.coalesce(rule, F.lit(False))
    return held
