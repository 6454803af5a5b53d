"""Mixing sources to target sizes: whole copies first, then a Pareto order sample of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import n_words, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 20_24
#: A text of this many words has an inclusion preference of 1; they run from 0.5 for the shortest texts to 1.5.
MIDDLE_SIZE = 200
#: Tables of sources up to this many rows are sent to all tasks; larger ones are joined by a shuffle.
SMALL_SOURCES = 100_000
#: Pareto ranks are integers of 60 bits; the cut is sought 12 bits at a time, the rest among the rows that are left.
RANK_BITS, STEP_BITS, STEPS = 60, 12, 2


def water_level(sources: DataFrame, total: float, cap: float) -> float:
    """The level at which ``min(cap * source_size, level * weight)`` adds up to ``total``; infinite if caps add to less.

    Resharing what capped sources leave over by weight until none is above its cap ends at this level. Only the sums
    of one pass at a time come to the driver.
    """
    level = 0.0
    while True:
        full = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, F.col("source_size") * cap).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            return float("inf")
        new = (total - row["held"]) / row["open"]
        if new <= level:
            return level
        level = new


def ranked_sources(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``weight``: the weights in turn over the sources by code point, null last. Ranks come from a range sort."""
    placed = staged(sources.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").sortWithinPartitions("none", "source").drop("none").withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    before, starts = 0, []
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        starts.append((row["part"], before))
        before += row["count"]
    starts = placed.sparkSession.createDataFrame(starts, "part long, start long")
    index = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.array(*map(F.lit, weights))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("weight", F.get(turn, (index % len(weights)).cast("int"))).drop("part", "start", "place")


def with_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Inner join on ``source``, null being a source of its own."""
    right = sources.select(F.coalesce("source", F.lit("")).alias("__key"), F.col("source").isNull().alias("__none"), *[c for c in sources.columns if c != "source"])
    if n_sources <= SMALL_SOURCES:
        right = F.broadcast(right)
    left = rows.withColumn("__key", F.coalesce("source", F.lit(""))).withColumn("__none", F.col("source").isNull())
    return left.join(right, ["__key", "__none"]).drop("__key", "__none")


def pareto_rank(draw: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds, mapped to integers in the same order: q / (1 + q) of RANK_BITS bits."""
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), inclusion))
    q = (draw / (1 - draw)) / (p / (1 - p))
    return F.floor(q / (1 + q) * F.lit(float(1 << RANK_BITS))).cast("long")


def draw(seed: int) -> Column:
    """A number in (0, 1) that follows from the row's id and text alone."""
    bits = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits + 0.5) / float(1 << 52)


def by_size(size: Column) -> Column:
    """The preference for longer texts, which tell a model more than scraps do: up to 3 times the shortest ones'."""
    return 0.5 + size / (size + F.lit(float(MIDDLE_SIZE)))


def sized(docs: DataFrame, seed: int = SEED, preference: Column | None = None) -> DataFrame:
    """``(doc_id, source, size, draw, preference)``: what the plan needs of each row, from one scan of the texts.

    Without a ``preference`` it is ``by_size``; a null or negative one counts as 1 or 0.
    """
    given = preference.cast("double") if preference is not None else F.lit(None).cast("double")
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), given.alias("preference"))
    found = cols.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw(seed).alias("draw"), "preference")
    return found.withColumn("preference", by_size(F.col("size")) if preference is None else F.greatest(F.lit(0.0), F.coalesce("preference", F.lit(1.0))))


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, int]:
    """Per source ``source_size, target, whole, part, cut``, and the number of sources.

    Every document gets ``whole`` copies for certain. One more goes to those whose Pareto rank, under the inclusion
    probability ``rate * preference``, is at most ``cut``; the rate makes the probabilities' words add up to the need: as many of the first ranks as bring the source's words
    closest to its target. The cut is found from sums by rank interval, so no source is gathered or sorted.
    """
    sources = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("preference")).alias("preferred_size")), "sizes")
    n_sources = sources.count()
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    sources = staged(ranked_sources(sources, weights), "weights")
    level = water_level(sources, total, cap) if n_sources else 0.0
    target = F.least(F.col("source_size") * cap, F.lit(level) * F.col("weight"))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("target", target.cast("double")).withColumn("whole", F.floor(copies).cast("long")).withColumn("part", copies - F.col("whole")).drop("weight")
    sources = sources.withColumn("rate", F.col("part") * F.coalesce(F.try_divide("source_size", "preferred_size"), F.lit(1.0))).drop("preferred_size")
    left = staged(sources.withColumn("need", F.col("part") * F.col("source_size")).withColumn("low", F.lit(0).cast("long")), "need")
    ranks = with_source(rows, left.select("source", "part", "rate"), n_sources).where("part > 0").select("source", "size", rank_of(F.col("rate")).alias("rank"))
    shift = RANK_BITS
    for _ in range(STEPS):
        shift -= STEP_BITS
        bins = with_source(ranks, left.select("source", "low"), n_sources).where(F.shiftright("rank", shift + STEP_BITS) == F.col("low"))
        bins = bins.groupBy("source", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bin")  # 4,096 bins at most
        bins = with_source(bins.withColumn("upto", F.sum("words").over(run)), left.select("source", "need"), n_sources)
        below = F.col("upto") < F.col("need")
        step = bins.groupBy("source").agg(F.max(F.when(below, F.col("upto"))).alias("held"), F.max(F.when(below, F.col("bin"))).alias("last"), F.min(F.when(~below, F.col("bin"))).alias("open"))
        # the bin in which the need is met, or the one past the last
        step = step.select(F.col("source").alias("s"), "held", F.coalesce("open", F.col("last") + 1).alias("bin"))
        known = left.join(step, F.col("source").eqNullSafe(F.col("s")), "left")
        left = staged(known.select(*sources.columns, (F.col("need") - F.coalesce("held", F.lit(0))).alias("need"), F.coalesce("bin", F.shiftleft("low", STEP_BITS)).alias("low")), "need")
    rest = with_source(ranks, left.select("source", "low", "need"), n_sources).where(F.shiftright("rank", shift) == F.col("low"))
    rest = rest.groupBy("source", "rank").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    rest = rest.withColumn("off", F.abs(F.sum("words").over(Window.partitionBy("source").orderBy("rank")) - F.col("need")))
    best = rest.groupBy("source").agg(F.min_by(F.col("rank"), F.struct("off", "rank")).alias("best"), F.min("off").alias("off"))
    cuts = left.join(best.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    none = F.shiftleft("low", shift) - 1
    cut = F.when(F.col("part") <= 0, F.lit(-1)).when(F.col("off") < F.abs("need"), F.col("best")).otherwise(none)
    return staged(cuts.select("source", "source_size", "target", "whole", "part", "rate", cut.cast("long").alias("cut")), "cuts"), n_sources


def rank_of(rate: Column) -> Column:
    return pareto_rank(F.col("draw"), rate * F.col("preference"))


def allotted(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """Adds ``copies`` and the source's columns to rows that carry ``draw`` and ``preference``."""
    joined = with_source(rows, plan, n_sources)
    return joined.withColumn("copies", F.col("whole") + F.when((F.col("part") > 0) & (rank_of(F.col("rate")) <= F.col("cut")), 1).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, preference: Column | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for every row of ``docs(doc_id, text, source)``.

    Null text has size 0; a null source is a source, the last by code point. Rows with equal ids and texts are taken
    alike, so reruns agree whatever the order of rows. An empty table gives an empty mix.
    """
    rows = staged(sized(docs, seed, preference), "sized")
    plan, n_sources = plan_mix(rows, weights, share, cap)
    return allotted(rows, plan, n_sources).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, preference: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as in ``docs`` (names without backticks).

    A text without words adds nothing to a mix and is left out, null among them. Repeated rows are taken alike, and so are
    rows of a null source, which is a source of its own. An empty table gives an empty mix.
    """
    plan, n_sources = plan_mix(staged(sized(docs, seed, preference), "sized"), weights, share, cap)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = by_size(n_words(F.col("text"))) if preference is None else F.greatest(F.lit(0.0), F.coalesce(preference.cast("double"), F.lit(1.0)))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), chosen.alias("preference"))
    rows = rows.select("row", "source", draw(seed).alias("draw"), "preference")
    taken = allotted(rows, plan, n_sources).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("row.*")
