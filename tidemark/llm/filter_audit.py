"""How document filters interact: what each removes alone, after others, and over all orders of the filters."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Splits at runs of ASCII white space.
GAPS = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: short, repetitive, upper-case, with symbols."""
    words = F.filter(F.split(text, GAPS), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    length = F.length(text).cast("long")
    upper = length - F.length(F.translate(text, UPPER, ""))
    fails = (n < 200, 100 * distinct < 50 * n, 100 * upper > 3 * length, text.rlike(r"[#$%&*|]"))
    return sum((F.when(fail, 1 << bit).otherwise(0) for bit, fail in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by language, failed filters and labels.

    Copies are told apart by their texts' digests, with counts combined before each shuffle: a digest that a third of
    all rows share reaches the window over digests as a row per language, label and mask.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_mask(text).alias("mask"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))  # repeated rows
    has_id = F.col("doc_id").isNotNull()
    spread = F.when(has_id, 0).otherwise(F.pmod(F.xxhash64("digest"), F.lit(1024)).cast("int"))  # rows without an id match nothing; they are dealt out all the same
    rows = rows.withColumn("spread", spread).join(known.withColumn("spread", F.lit(0)), ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"])
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"), F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("without_id")
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    originals = F.col("without_id") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    groups = groups.withColumn("originals", originals)
    cells = groups.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("originals").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))).alias("cell"))
    return cells.groupBy("part", "cell.mask", "good", "toxic").agg(F.sum("cell.n").alias("n"))


def order_steps() -> Column:
    """All orders of the filters with their steps, as an array that is part of the plan: 120 orders by 5 steps."""
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    steps = lambda order: F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: F.struct(order.alias("filter_order"), k.alias("step"), F.substring(order, k, 1).alias("filter")))
    return F.flatten(F.transform(orders, steps))


def order_metrics(cells: DataFrame) -> DataFrame:
    """Cells of ``mask_cells`` unpivoted against every step of every order.

    A running bit-or over a cell's earlier steps tells which failures came before; sums per step and totals per filter
    follow. The work is 600 rows per cell, and cells don't grow with the documents but with the languages.
    """
    long = cells.withColumn("at", F.explode(order_steps())).select("part", "mask", "good", "toxic", "n", "at.*")
    long = long.withColumn("bit", F.expr("shiftleft(1, ascii(filter) - ascii('A'))"))
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    earlier = Window.partitionBy("part", "filter_order", "mask", "good", "toxic").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumns({"failed": failed != 0, "before": F.coalesce(F.bit_or(failed).over(earlier), F.lit(0)) != 0})
    count = lambda held: F.sum(F.when(held, F.col("n")).otherwise(0)).alias
    here = F.col("failed") & ~F.col("before")
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        count(~F.col("failed") & ~F.col("before"))("kept"), count(here)("removed"), count(F.col("failed") & F.col("before"))("redundant"),
        count(F.col("mask") == F.col("bit"))("unique_fails"), count(here & (F.col("good") == 1))("good_lost"), count(here & (F.col("toxic") == 1))("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Interaction of five filters over ``docs(doc_id, text, lang)``, by language, order and step.

    Filters: A fewer than 200 words, B fewer than half of the words distinct, C over 3 % upper-case A-Z, D one of
    ``#$%&*|``, E a copy of a text with a smaller id. ``labels(doc_id, quality, toxic)`` may lack documents; of several
    rows for a document any 1 counts. A null text is empty and a null language the empty string; a row without an id
    has no labels, is no copy and has none; repeated rows count each, and none of them is a copy of the other. An empty
    table gives an empty result; further columns of ``docs`` are not looked at.
    """
    return order_metrics(mask_cells(docs, labels))
