"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import staged


@dataclass(frozen=True)
class Ring:
    """``nodes`` virtual nodes per shard stand at distinct cells out of ``cells``; no shard takes more than ``1 + slack``
    of the mean load. A shard that is added takes cells that were free, so the nodes of others don't move."""

    shards: int = 8
    nodes: int = 128
    cells: int = 4096
    slack: float = 0.0005

    def owners(self) -> list[tuple[int, int]]:
        """``(cell, shard)`` of the virtual nodes in clockwise order."""
        if self.shards * self.nodes > self.cells:
            raise ValueError("more virtual nodes than cells")
        taken: dict[int, int] = {}
        for shard in range(self.shards):
            for node in range(self.nodes):
                cell = int(md5(f"{shard}/{node}".encode()).hexdigest()[:8], 16) % self.cells
                while cell in taken:
                    cell = (cell + 1) % self.cells
                taken[cell] = shard
        return sorted(taken.items())


#: One stretch of a unit's keys that goes to one shard: its size class, its cell, the first byte and the shard.
Piece = tuple[int, int, int, int]


def dealt(units: dict[tuple[int, int], int], ring: Ring) -> list[Piece]:
    """Send the bytes of every ``(size class, cell)`` to the next virtual node clockwise; what a full shard can't take
    goes on clockwise. Large classes go first, so that what overflows in the end is small texts."""
    nodes = ring.owners()
    cells = [cell for cell, _ in nodes]
    total = sum(units.values())
    room = [-(-int(total * (1 + ring.slack)) // ring.shards) + 1] * ring.shards
    pieces: list[Piece] = []
    for (size_class, cell), left in sorted(units.items(), key=lambda x: (-x[0][0], x[0][1])):
        at, start = bisect_left(cells, cell), 0
        while left:
            shard = nodes[at % len(nodes)][1]
            took = min(left, room[shard])
            if took:
                pieces.append((size_class, cell, start, shard))
                room[shard] -= took
                start, left = start + took, left - took
            at += 1
    return pieces


def _size_class(size: Column) -> Column:
    """Sizes within a factor of four; a whole number."""
    return F.floor((F.length(F.bin(size)) - 1) / 2).cast("int")


def headers(docs: DataFrame, ring: Ring) -> DataFrame:
    """``doc_id, size, text_crc32`` and a row's place on the ring. Rows without an id have no key: a number of the row
    stands for it, so that many of them don't meet in one cell."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row_number"),
    )
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row_number").cast("string"))).cast("binary"))
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    order = F.conv(F.substring(key, 9, 12), 16, 10).cast("long")
    return rows.withColumns({"cell": (place % ring.cells).cast("int"), "size_class": _size_class(F.col("size")), "key_order": order})


def _byte_in_unit(rows: DataFrame) -> DataFrame:
    """``first_byte``: bytes of the rows before this one in its unit. Sums of 256 slices carry over, so that no task
    orders a whole unit."""
    unit, slices = ["size_class", "cell"], ["size_class", "cell", "slice"]
    rows = rows.withColumn("slice", (F.col("key_order") % 256).cast("int"))
    before = Window.partitionBy(*unit).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*slices).agg(F.sum("size").alias("bytes")).withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    inside = Window.partitionBy(*slices).orderBy("key_order", "doc_id", "row_number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, slices).withColumn("first_byte", F.col("offset") + F.col("within"))


def placed(rows: DataFrame, ring: Ring) -> DataFrame:
    """Staged ``headers`` with their ``shard`` and ``home``, the shard at the next node clockwise."""
    spark = rows.sparkSession
    sums = rows.groupBy("size_class", "cell").agg(F.sum("size").alias("bytes"))
    units = {(r["size_class"], r["cell"]): r["bytes"] for r in sums.collect()}  # 32 size classes by ring.cells rows at most, whatever the input
    pieces: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for size_class, cell, start, shard in dealt(units, ring):
        pieces[size_class, cell].append((start, shard))
    nodes = ring.owners()
    cells = [cell for cell, _ in nodes]
    home = {cell: nodes[bisect_left(cells, cell) % len(nodes)][1] for cell in range(ring.cells)}
    kind = "size_class int, cell int, home int, parts array<struct<start:bigint,shard:int>>"
    plan = F.broadcast(spark.createDataFrame([(*unit, home[unit[1]], parts) for unit, parts in pieces.items()], kind))  # a row per unit: bounded as above
    rows = rows.join(plan, ["size_class", "cell"])
    whole = rows.where(F.size("parts") == 1).withColumn("shard", F.get("parts", F.lit(0))["shard"])
    cut = _byte_in_unit(rows.where(F.size("parts") > 1))
    part = F.array_max(F.filter("parts", lambda p: p["start"] <= F.col("first_byte")))  # the last one that starts at or before the row
    cut = cut.withColumn("shard", part["shard"])
    return whole.unionByName(cut.select(whole.columns)).drop("parts")


def numbered(rows: DataFrame) -> DataFrame:
    """``slot``: gapless from 0 within each shard, counted by cell and carried over between cells."""
    counts = rows.groupBy("shard", "cell").count()  # ring.shards by ring.cells rows at most
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("key_order", "doc_id", "row_number")
    return rows.withColumn("within", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "cell"]).withColumn("slot", F.col("offset") + F.col("within") - 1)


def assign(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """A shard and a slot for every row of ``docs(doc_id, text)``: ``doc_id, size, text_crc32, home, shard, slot``.

    A key is hashed to a cell of the ring and belongs to the next virtual node clockwise (``home``). Loads are bytes of
    text plus one per row; a shard that has reached ``1 + ring.slack`` of the mean load is full, and keys that overflow
    go on clockwise to the next shard with room. So loads are equal within ``ring.shards * ring.slack`` of the mean and
    a few texts' sizes, and a shard that is added takes part of every shard while few other keys move.

    The texts are read once; only their headers are staged. What the driver sees are sums by size class and cell, whose
    number doesn't grow with the input. A null text has no bytes; a row without an id is placed by its number, which may
    differ between runs; repeated rows are placed one by one; an empty table gives an empty result; further columns of
    ``docs`` are not looked at.
    """
    rows = placed(staged(headers(docs, ring), "headers"), ring)
    return numbered(staged(rows, "placed")).select("doc_id", "size", "text_crc32", "home", "shard", "slot")
