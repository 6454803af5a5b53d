"""Ranks and exact quantiles of a whole table without a task that holds it, and as-of joins.

A sketch of a column (Spark's approximate percentiles, of bounded size) cuts its values into bins of about equal counts.
Where a bin begins is exact: rows are counted by bin, and the counts of the bins before it carry over.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import staged

#: Size of a sketch: errors are about one over it, as a share of the rows.
ACCURACY = 10_000
#: Values of one column that come to the driver at most, to pick quantiles from.
FEW = 2_000


def with_offsets(values: DataFrame, x: str, n: str) -> tuple[DataFrame, int]:
    """``values(x, n)``, one row per value, with ``before``: the sum of ``n`` over smaller values; and the sum of all.

    Bins are as many as shuffle partitions. Each is summed in order on its own, and the sums of the bins before it are
    added; a value with very many rows is one row here, so that no bin is hot.
    """
    spark = values.sparkSession
    bins = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = values.agg(F.percentile_approx(x, F.array(*[F.lit(i / bins) for i in range(1, bins)]), ACCURACY)).first()[0] if bins > 1 else []
    cuts = sorted(set(cuts or []))
    spread = values.withColumn("bin", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(x))) if cuts else F.lit(0))
    sums = {r["bin"]: r["s"] for r in spread.groupBy("bin").agg(F.sum(n).alias("s")).collect()}  # a row per bin
    carried, total = {}, 0
    for b in sorted(sums):
        carried[b], total = total, total + sums[b]
    if not carried:
        return values.withColumn("before", F.lit(0).cast("long")), 0
    offset = F.create_map(*[F.lit(v) for pair in carried.items() for v in pair])[F.col("bin")]
    inside = Window.partitionBy("bin").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return spread.withColumn("before", offset + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("bin"), total


def average_ranks(rows: DataFrame, x: str, rank: str = "rank") -> DataFrame:
    """``x, rank, times`` by value: the average rank of its rows among all rows with a value, and how many they are."""
    values = rows.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("times"))
    return with_offsets(values, x, "times")[0].select(x, (F.col("before") + (F.col("times") + 1) / 2).alias(rank), "times")


@dataclass
class _Sought:
    """The value of ``x`` at ``rank`` (from 0): above ``low``, which ``below`` values don't exceed, and below ``high``, which
    ``held`` fewer do."""

    x: str
    rank: int
    held: int
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    value: float | None = None

    @property
    def inside(self) -> Column:
        return F.when((F.col(self.x) > self.low) & (F.col(self.x) < self.high), F.col(self.x))

    def seen(self, cut: float, smaller: int, up_to: int) -> None:
        """Draw the conclusion from exact counts at a cut; the cut itself always leaves the range."""
        if smaller <= self.rank < up_to:
            self.value = cut
        elif self.rank < smaller and cut < self.high:
            self.high, self.held = cut, smaller - self.below
        elif self.rank >= up_to and cut > self.low:
            self.low, self.held, self.below = cut, self.held - (up_to - self.below), up_to


def _narrow(rows: DataFrame, sought: list[_Sought]) -> None:
    """A sketch of what each range holds proposes cuts around the rank; counts at the cuts shrink the range for certain."""
    margin = 2 / ACCURACY
    cuts = []
    for i, s in enumerate(sought):
        at = (s.rank - s.below + 0.5) / s.held
        cuts.append(F.percentile_approx(s.inside, F.array(*[F.lit(min(1.0, max(0.0, at + d))) for d in (-margin, 0, margin)]), ACCURACY).alias(f"c{i}"))
    found = rows.agg(*cuts).first()
    pairs = [(i, c) for i in range(len(sought)) for c in sorted(set(found[f"c{i}"]))]
    counts = [how.alias(f"{name}{j}") for j, (i, c) in enumerate(pairs) for name, how in (("s", F.count_if(F.col(sought[i].x) < c)), ("u", F.count_if(F.col(sought[i].x) <= c)))]
    found = rows.agg(*counts).first()
    for j, (i, c) in enumerate(pairs):
        sought[i].seen(c, found[f"s{j}"], found[f"u{j}"])


def _pick(rows: DataFrame, sought: list[_Sought]) -> None:
    """What is left of each range, FEW values at most, in order."""
    left = rows.select(*[s.inside.alias(f"v{i}") for i, s in enumerate(sought)])
    lists = left.agg(*[F.sort_array(F.collect_list(f"v{i}")).alias(f"v{i}") for i in range(len(sought))]).first()
    for i, s in enumerate(sought):
        s.value = lists[f"v{i}"][s.rank - s.below]


def exact_quantiles(rows: DataFrame, names: tuple[str, ...], shares: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Quantiles of each column over its finite values, between ranks by proportion; null without values.

    The column is never held anywhere: sketches narrow the range around a rank by some thousand times a round, exact
    counts confirm it, and at last at most FEW values are looked at. All columns and shares go in the same rounds.
    """
    held = staged(rows.select(*[F.when(F.abs(F.col(c).cast("double")) < math.inf, F.col(c).cast("double")).alias(c) for c in names]))
    counts = held.agg(*[F.count(c).alias(c) for c in names]).first()
    at = {(c, q): (counts[c] - 1) * q for c in names for q in shares if counts[c]}
    sought = {(c, r): _Sought(c, r, counts[c]) for (c, _), h in at.items() for r in {math.floor(h), math.ceil(h)}}
    while wide := [s for s in sought.values() if s.value is None and s.held > FEW]:
        _narrow(held, wide)
    if rest := [s for s in sought.values() if s.value is None]:
        _pick(held, rest)

    def between(c: str, q: float) -> float | None:
        if (c, q) not in at:
            return None
        low, high = sought[c, math.floor(at[c, q])].value, sought[c, math.ceil(at[c, q])].value
        return low + (high - low) * (at[c, q] - math.floor(at[c, q]))

    return {c: [between(c, q) for q in shares] for c in names}


def next_event(rows: DataFrame, events: DataFrame, by: str, on: str, event: str, clip: bool = False) -> DataFrame:
    """``rows`` with ``event``: the first date of ``events(by, event)`` at or after the row's own date, per key of ``by``.

    Both sides are sorted together once, by key and month, and filled backwards; months without a later event of their
    own take the first event of the next month that has one, so that a key with very many rows is not one task. Past the
    last event of its key a row gets null, or with ``clip`` that last event.
    """
    month = lambda d: F.trunc(d, "month")
    known = events.select(by, event).where(F.col(event).isNotNull()).distinct()
    both = rows.withColumns({"__at": F.col(on), "__event": F.lit(None).cast("date")}).unionByName(known.select(by, F.col(event).alias("__at"), F.col(event).alias("__event")), allowMissingColumns=True)
    both = both.withColumn("__month", month(F.col("__at")))
    backwards = Window.partitionBy(by, "__month").orderBy(F.desc("__at"), F.desc_nulls_last("__event")).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({"__near": F.last("__event", ignorenulls=True).over(backwards), "__row": F.col("__event").isNull()}).where("__row")
    firsts = known.groupBy(by, month(F.col(event)).alias("__month")).agg(F.min(event).alias("__first"))
    months = rows.select(by, month(F.col(on)).alias("__month")).distinct().join(firsts, [by, "__month"], "full")
    later = Window.partitionBy(by).orderBy(F.desc("__month"))  # a row per key and month
    months = months.withColumn("__later", F.last("__first", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, -1)))
    found = filled.join(months.select(by, "__month", "__later"), [by, "__month"], "left")
    nearest = F.coalesce("__near", "__later")
    if clip:
        found = found.join(known.groupBy(by).agg(F.max(event).alias("__last")), by, "left")
        nearest = F.coalesce("__near", "__later", "__last")
    return found.withColumn(event, nearest).select(*rows.columns, event)
