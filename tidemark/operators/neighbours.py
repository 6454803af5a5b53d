"""Exact nearest neighbours by joins over the boxes of a k-d partition, and what builds on them.

Rows are dealt to the cells of a partition that a bounded sample shapes; every cell's box is the smallest that holds its
rows. A row first looks in its own cell, which bounds the distance it has to look further; then only in cells whose box
is no farther than that. The sample decides how even the cells are, never which neighbours are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions.windows import by_ticker
from tidemark.sources.staging import staged

#: Rows that shape the partition, the most cells it has, and the rows of a cell that are aimed at below that.
SAMPLE, MOST_CELLS, CELL_ROWS = 20_000, 4096, 256
#: Distances that a task holds at once, and the rows that look for neighbours at once.
PAIRS, GUESTS = 1 << 21, 1 << 14
#: Pieces of a cell, a power of two, that tell which rows of others it has to know.
PIECES = 16
#: Keeps a density finite where all neighbours are copies.
LEAST_REACH = 1e-10


@dataclass(frozen=True)
class Partition:
    """A complete binary tree: node ``i`` sends rows above ``cuts[i]`` on ``axes[i]`` to node ``2i + 1``, others to ``2i``."""

    axes: np.ndarray
    cuts: np.ndarray

    def cell(self, x: np.ndarray) -> np.ndarray:
        node, every = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(len(self.axes).bit_length() - 1):
            node = 2 * node + (x[every, self.axes[node]] > self.cuts[node])
        return (node - len(self.axes)).astype(np.int32)


def partition_of(rows: DataFrame, xs: tuple[str, ...], cells: int) -> Partition:
    """Cuts at medians of the widest axes of a sample of SAMPLE rows, chosen by a hash of their values."""
    sample = np.array(rows.select(*xs).orderBy(F.xxhash64(*xs)).limit(SAMPLE).collect(), float).reshape(-1, len(xs))
    leaves = 1 << max(0, min(cells, MOST_CELLS) - 1).bit_length()
    axes, cuts, held = np.zeros(leaves, np.int64), np.zeros(leaves), {1: sample}
    for node in range(1, leaves):
        x = held.pop(node)
        if len(x):
            axes[node] = np.ptp(x, axis=0).argmax()
            cuts[node] = np.median(x[:, axes[node]])
        above = x[:, axes[node]] > cuts[node]
        held[2 * node], held[2 * node + 1] = x[~above], x[above]
    return Partition(axes, cuts)


def in_cells(rows: DataFrame, xs: tuple[str, ...], partition: Partition) -> DataFrame:
    """``rows`` with their ``cell``."""
    at = [rows.columns.index(x) for x in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(partition.cell(x))], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cell", IntegerType())]))


def boxes_of(rows: DataFrame, xs: tuple[str, ...], *by: str, **more: Column) -> DataFrame:
    """The box ``x_lo, x_hi`` of each cell, by group."""
    edges = [how(x).alias(f"{x}_{name}") for x in xs for name, how in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy(*by, "cell").agg(*edges, *[c.alias(n) for n, c in more.items()])


def square(x: Column) -> Column:
    return x * x


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def _closest(guests: np.ndarray, ids: np.ndarray, x: np.ndarray, want: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each guest the ``want`` rows of ``x`` within its bound, by distance and id: guests, rows, squared distances."""
    found = []
    for low in range(0, len(guests), step := max(1, min(GUESTS, PAIRS // max(1, len(x))))):
        part = guests[low : low + step]
        far = np.zeros((len(part), len(x)))
        for axis in range(x.shape[1]):
            gap = part[:, axis, None] - x[None, :, axis]
            far += gap * gap
        limit = bounds[low : low + step]
        if len(x) > want:
            limit = np.minimum(limit, np.partition(far, want - 1, axis=1)[:, want - 1])
        who, which = np.nonzero(far <= limit[:, None])
        d = far[who, which]
        order = np.lexsort((ids[which], d, who))
        who, which, d = who[order], which[order], d[order]
        first = np.searchsorted(who, who)  # where a guest's entries begin
        keep = np.arange(len(who)) - first < want
        found.append((who[keep] + low, which[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def _matrix(rows: pa.Table, xs: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([rows.column(x).to_numpy() for x in xs])


def _square_gaps(low: np.ndarray, high: np.ndarray, to_low: np.ndarray, to_high: np.ndarray) -> np.ndarray:
    """Squared distances of the boxes ``low, high`` to the boxes ``to_low, to_high``, rows by columns; 0 where they meet."""
    gap2 = np.zeros((len(low), len(to_low)))
    for axis in range(low.shape[1]):
        gap = np.maximum(np.maximum(to_low[None, :, axis] - high[:, axis, None], low[:, axis, None] - to_high[None, :, axis]), 0)
        gap2 += gap * gap
    return gap2


def _pieces(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One of PIECES even pieces of a cell for each of its rows, cut at medians of the widest axis, the bound being one."""
    held, piece = np.column_stack([x, np.sqrt(np.minimum(bounds, np.finfo(float).max))]), np.zeros(len(x), np.int32)
    for _ in range(PIECES.bit_length() - 1):
        piece *= 2
        for p in np.unique(piece):
            at = np.flatnonzero(piece == p)
            axis = np.ptp(held[at], axis=0).argmax()
            piece[at[np.argsort(held[at, axis], kind="stable")[len(at) // 2 + len(at) % 2 :]]] += 1
    return piece


def neighbourhoods(points: DataFrame, xs: tuple[str, ...], want: int) -> DataFrame:
    """``id, n, *xs, cell, near``: ``points(id, n, *xs)``, each being ``n`` equal rows, with their nearest ones, and the guests
    that a cell's rows are near to, where ``near`` is null.

    ``near`` holds places in the list of the cell's own rows by id and then its guests by id. They come by distance and id, the
    point itself among them: as many points as have ``want`` rows. Exact: a cell's rows bound how far they have to look, and
    all rows of other cells within that distance of a piece of the cell are its guests. Lists stay where they are made.
    """
    count = points.count()
    rows = staged(in_cells(points, xs, partition_of(points, xs, -(-count // max(CELL_ROWS, 2 * want)))))
    boxes = boxes_of(rows, xs, held=F.sum("n")).where(F.col("held") >= want).collect()  # MOST_CELLS rows at most
    full = [np.array([[b[f"{x}_{end}"] for x in xs] for b in boxes], float).reshape(-1, len(xs)) for end in ("lo", "hi")]
    columns = ", ".join(f"{x} double" for x in xs)

    def at_home(cell: pa.Table) -> pa.Table:
        x, ids, times = _matrix(cell, xs), cell.column("id").to_numpy(), cell.column("n").to_numpy()
        bounds = np.full(len(x), np.inf)
        for low in range(0, len(x) if len(boxes) else 0, step := max(1, PAIRS // max(1, len(boxes)))):
            part = x[low : low + step]
            far = np.zeros((len(part), len(boxes)))
            for axis in range(len(xs)):
                gap = np.maximum(full[1][None, :, axis] - part[:, axis, None], part[:, axis, None] - full[0][None, :, axis])
                far += gap * gap
            bounds[low : low + step] = far.min(axis=1)  # a box of as many rows as are wanted lies within
        who, which, d2 = _closest(x, ids, x, want, np.full(len(x), np.inf))
        held = np.cumsum(times[which])
        starts = np.searchsorted(who, np.arange(len(x)))
        before = held[starts] - times[which[starts]]
        enough = held - before[who] >= want  # from here on a point knows as many rows as it wants
        np.minimum.at(bounds, who[enough], d2[enough])
        return pa.Table.from_arrays([*[cell.column(c) for c in ("id", "n", *xs, "cell")], pa.array(bounds), pa.array(_pieces(x, bounds))], ["id", "n", *xs, "cell", "bound", "piece"])

    known = staged(rows.groupBy("cell").applyInArrow(at_home, f"id long, n long, {columns}, cell int, bound double, piece int"))
    pieces = boxes_of(known, xs, "piece", bound=F.max("bound")).collect()  # MOST_CELLS * PIECES rows at most
    home, reach2 = np.array([b["cell"] for b in pieces], np.int32), np.array([b["bound"] for b in pieces], float)
    low, high = (np.array([[b[f"{x}_{end}"] for x in xs] for b in pieces], float).reshape(-1, len(xs)) for end in ("lo", "hi"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x, cell = np.column_stack([batch.column(c).to_numpy() for c in xs]), batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for begin, end in pairwise(cuts):  # rows of one cell
                there = x[begin:end]
                near = np.flatnonzero((_square_gaps(there.min(axis=0)[None], there.max(axis=0)[None], low, high)[0] <= reach2) & (home != cell[begin]))
                for at in range(0, len(there) if len(near) else 0, step := max(1, PAIRS // max(1, len(near)))):
                    part = there[at : at + step]
                    who, which = np.nonzero(_square_gaps(part, part, low[near], high[near]) <= reach2[near])
                    visits = np.unique((who << 32) | home[near[which]])
                    guests = batch.take(pa.array(begin + at + (visits >> 32)))
                    yield pa.RecordBatch.from_arrays([*[guests.column(c) for c in ("id", "n", *xs)], pa.array((visits & 0xFFFFFFFF).astype(np.int32))], ["id", "n", *xs, "cell"])

    guests = known.mapInArrow(routed, f"id long, n long, {columns}, cell int")

    def among(cell: pa.Table) -> pa.Table:
        cell, n_own = _in_place(cell, "piece")
        x, ids, times = _matrix(cell, xs), cell.column("id").to_numpy(), cell.column("n").to_numpy()
        piece, bounds = (cell.column(c).slice(0, n_own).to_numpy() for c in ("piece", "bound"))
        found = [(np.zeros(0, np.int64),) * 2]
        for p in np.unique(piece):
            own = np.flatnonzero(piece == p)
            at = np.flatnonzero(_square_gaps(x[own].min(axis=0)[None], x[own].max(axis=0)[None], x, x)[0] <= bounds[own].max())
            who, which, _ = _closest(x[own], ids[at], x[at], want, bounds[own])
            found.append((own[who], at[which]))
        who, which = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.argsort(who, kind="stable")
        who, which = who[order], which[order]
        keep = _before(who, times[which]) < want
        who, which = who[keep], which[keep]
        used = np.concatenate((np.ones(n_own, bool), np.zeros(len(ids) - n_own, bool)))
        used[which] = True
        kept = cell.filter(pa.array(used)).select(["id", "n", *xs, "cell"])
        ends = np.cumsum(np.bincount(who, minlength=n_own))
        return kept.append_column("near", _lists(ends, (np.cumsum(used) - 1)[which].astype(np.int32), kept.num_rows))

    met = known.unionByName(guests, allowMissingColumns=True).groupBy("cell")
    return staged(met.applyInArrow(among, f"id long, n long, {columns}, cell int, near array<int>"))


def _in_place(cell: pa.Table, own: str) -> tuple[pa.Table, int]:
    """A cell's own rows by id, then its guests by id, and the number of the former, those that have ``own``."""
    guest = cell.column(own).is_null()
    order = np.lexsort((cell.column("id").to_numpy(), guest.to_numpy()))
    return cell.take(pa.array(order)), cell.num_rows - int(guest.to_numpy().sum())


def _before(who: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Rows of the entries of the same ``who`` that come earlier."""
    held = np.cumsum(times) - times
    return held - held[np.searchsorted(who, who)]


def _lists(ends: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """``n`` lists that end at ``ends``; null beyond those."""
    offsets = np.concatenate(([0], ends, np.full(n - len(ends), ends[-1] if len(ends) else 0))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(np.arange(n) >= len(ends)))


def outlier_factors(rows: DataFrame, xs: tuple[str, ...], ks: tuple[int, ...] = (20,)) -> DataFrame:
    """``rows`` with ``lof_k`` for each ``k``: how much sparser a row lies than its ``k`` nearest others.

    A row's reach from a neighbour is their distance, or the neighbour's own ``k``-th distance if that is larger; its
    density is one over the mean reach; the factor is the mean density of its neighbours over its own. Ties at the
    ``k``-th distance go to the smaller values. Equal rows are one point with a count, so that many copies cost nothing;
    a row that lacks a value has no factor, nor has the only row of a table.

    A cell's lists are places in its own rows and guests; what is shuffled is a few numbers for each guest, not for each
    neighbour.
    """
    whole = F.lit(True)
    for x in xs:
        whole &= F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    points = rows.where(whole).groupBy(*xs).agg(F.count("*").alias("n")).orderBy(*xs)
    points = staged(points.withColumn("id", F.monotonically_increasing_id()))  # ids ascend with the values
    near = neighbourhoods(points, xs, max(ks) + 1)
    columns = ", ".join(f"{x} double" for x in xs)

    def entries(cell: pa.Table) -> tuple[pa.Table, int, np.ndarray, np.ndarray, list[np.ndarray]]:
        """The cell in place, its own rows, who is near whom, and how many rows each entry stands for by ``k``, the point's own row aside."""
        cell, n_own = _in_place(cell, "near")
        lists = cell.column("near").slice(0, n_own).combine_chunks()
        who, which = np.repeat(np.arange(n_own), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        times = cell.column("n").to_numpy()[which]
        before = _before(who, times)
        return cell, n_own, who, which, [np.clip(k + 1 - before, 0, times) - (who == which) for k in ks]

    def apart(cell: pa.Table, who: np.ndarray, which: np.ndarray) -> np.ndarray:
        x = _matrix(cell, xs)
        d2 = np.zeros(len(who))
        for axis in range(len(xs)):
            gap = x[who, axis] - x[which, axis]
            d2 += gap * gap
        return np.sqrt(d2)

    def numbers(values: list[np.ndarray], n: int) -> pa.Array:
        """For each own row an array of a number for each ``k``."""
        return _lists(np.arange(1, len(values[0]) + 1) * len(ks), np.column_stack(values).ravel(), n)

    def told(cell: pa.Table, name: str) -> np.ndarray:
        return cell.column(name).combine_chunks().flatten().to_numpy().reshape(-1, len(ks))

    def reaches(cell: pa.Table) -> pa.Table:
        cell, n_own, who, which, weights = entries(cell)
        d, out = apart(cell, who, which), []
        for w in weights:
            reach = np.zeros(n_own)
            np.maximum.at(reach, who[w > 0], d[w > 0])
            out.append(reach)
        return cell.append_column("reach", numbers(out, cell.num_rows))

    def densities(cell: pa.Table) -> pa.Table:
        cell, n_own, who, which, weights = entries(cell)
        d, reach, out = apart(cell, who, which), told(cell, "reach"), []
        for i, w in enumerate(weights):
            total, k = (np.bincount(who, v, n_own) for v in (w * np.maximum(reach[which, i], d), w))
            out.append(np.where(k > 0, 1 / (total / np.maximum(k, 1) + LEAST_REACH), np.nan))
        return cell.select(["id", "n", "cell", "near"]).append_column("density", numbers(out, cell.num_rows))

    def factors(cell: pa.Table) -> pa.Table:
        cell, n_own, who, which, weights = entries(cell)
        density, out = told(cell, "density"), []
        for i, w in enumerate(weights):
            total, k = (np.bincount(who, v, n_own) for v in (w * density[which, i], w))
            out.append(pa.array(total / np.maximum(k, 1) / density[:n_own, i], mask=k == 0))
        return pa.Table.from_arrays([cell.column("id").slice(0, n_own), *out], ["id", *[f"lof_{k}" for k in ks]])

    def shared(found: DataFrame, value: str) -> DataFrame:
        """Guests with the ``value`` that their own cell found, beside the rows of each cell."""
        own, guests = found.where("near IS NOT NULL"), found.where("near IS NULL").drop(value)
        return own.unionByName(guests.join(own.select("id", value), "id")).groupBy("cell")

    found = staged(near.groupBy("cell").applyInArrow(reaches, f"id long, n long, {columns}, cell int, near array<int>, reach array<double>"))
    found = staged(shared(found, "reach").applyInArrow(densities, "id long, n long, cell int, near array<int>, density array<double>"))
    factor = shared(found, "density").applyInArrow(factors, "id long, " + ", ".join(f"lof_{k} double" for k in ks))
    return rows.join(points.join(factor, "id", "left").drop("id", "n"), list(xs), "left")


def nearest_pattern(rows: DataFrame, x: str = "ret_1d", n: int = 10, apart: int = 5, least: int = 20, segments: int = 5) -> DataFrame:
    """``pattern_similarity_score``: distance of the ``n`` values before each row to the nearest such pattern of the
    ticker that is over ``apart`` patterns older; null for a ticker's first ``least`` patterns. Missing values count as 0.

    Means of ``segments`` equal parts give distances that are never larger than the patterns' own. Patterns are dealt to
    cells by their means; one looks in its own cell, then in those cells of its ticker whose boxes, and at those patterns
    whose means, are nearer than what it has found. All of it are joins by ticker and cell.
    """
    width = n // segments
    at = by_ticker()
    xs, means = [f"x{i}" for i in range(n)], tuple(f"m{i}" for i in range(segments))
    value = F.coalesce(x, F.lit(0.0))
    held = rows.select("ticker", "date", (F.row_number().over(at) - n - 1).alias("p"), *[F.lag(value, n - i).over(at).alias(c) for i, c in enumerate(xs)]).where("p >= 0")
    scaled = [(total([F.col(xs[i * width + j]) for j in range(width)]) / width**0.5).alias(m) for i, m in enumerate(means)]
    held = staged(held.select("*", *scaled))
    longest = held.groupBy("ticker").count().agg(F.max("count")).first()[0] or 0
    cells = staged(in_cells(held, means, partition_of(held, means, -(-longest // (CELL_ROWS // 2)))))

    def prefixed(df: DataFrame, prefix: str, *keys: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])

    hosts = prefixed(cells.drop("date"), "h_", "ticker", "cell")
    distance = total([square(F.col(c) - F.col(f"h_{c}")) for c in xs])
    bound = total([square(F.col(m) - F.col(f"h_{m}")) for m in means])
    older = F.col("h_p") < F.col("p") - apart
    guests = cells.where(F.col("p") >= least)
    home = guests.join(hosts, ["ticker", "cell"]).where(older).groupBy("ticker", "p").agg(F.min(distance).alias("d2"))
    guests = staged(guests.join(home, ["ticker", "p"], "left").withColumn("d2", F.coalesce("d2", F.lit(float("inf")))))
    boxes = boxes_of(cells, means, "ticker", first=F.min("p")).withColumnRenamed("cell", "there")
    zero = F.lit(0.0)
    gap = total([square(F.greatest(F.col(f"{m}_lo") - F.col(m), F.col(m) - F.col(f"{m}_hi"), zero)) for m in means])
    slack = F.col("d2") * (1 + 1e-9) + 1e-18  # sums of other terms in another order
    routed = guests.join(boxes, "ticker").where((gap <= slack) & (F.col("there") != F.col("cell")) & (F.col("first") < F.col("p") - apart))
    routed = routed.select("ticker", F.col("there").alias("cell"), "p", "d2", *xs, *means)
    abroad = routed.join(hosts, ["ticker", "cell"]).where(older & (bound <= slack)).groupBy("ticker", "p").agg(F.min(distance).alias("other"))
    found = guests.join(abroad, ["ticker", "p"], "left").select("ticker", "date", F.least("d2", F.coalesce("other", F.lit(float("inf")))).alias("d2"))
    score = F.when(F.col("d2") < float("inf"), F.sqrt("d2")).alias("pattern_similarity_score")
    return rows.join(found.select("ticker", "date", score), ["ticker", "date"], "left")
