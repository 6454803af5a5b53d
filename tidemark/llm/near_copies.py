"""The pipeline's near copies: tiled comparison of wide SimHash fingerprints proposes pairs, whole shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.simhash import _LOWER, one_of_each, thinned, tiled_links
from tidemark.llm.staging import batches, staged


@dataclass(frozen=True)
class Shingling:
    """Texts are near copies if ``similarity`` (Jaccard) of their distinct shingles of ``width`` words is common.

    Fingerprints have 64 bits in each of ``lanes``. At a similarity of 0.8 the cosine is 0.89 and 15 % of the bits differ,
    39 of 256 with a deviation of 5.7; unrelated texts differ in 128 with a deviation of 8. A ``radius`` of 64 loses 3
    pairs in a million of those at 0.8 (1 in 200 where sets of 4 and 5 shingles meet) and takes no unrelated ones.
    """

    width: int = 5
    similarity: float = 0.8
    lanes: int = 4
    radius: int = 64


#: Sets that one task holds as rows of a group; larger groups are dealt over several tasks.
BUCKET_ROWS = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    value = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * _MIX + value[i : i + n]
    return np.unique(h ^ (h >> np.uint64(32)))


@lru_cache(maxsize=2)
def _hashing(n: int) -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def wide_print(found: np.ndarray, lanes: int) -> np.ndarray:
    """A SimHash of 64 bits per lane: each bit is 1 if it is set in over half of the shingles' hashes; zero for an empty set."""
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(found), 4096):
        h = found[at : at + 4096, None] * _hashing(lanes)
        h = (h ^ (h >> np.uint64(31))) * _MIX
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found), bitorder="little").view(np.int64)


def name_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def alike(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets reach the similarity; every common shingle is counted."""
    size_a, size_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(all_a, all_b)
    row_a, row_b = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
    common = np.zeros((len(a), len(b)))
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]
        sides = []
        for values, rows, n in ((all_a, row_a, len(a)), (all_b, row_b, len(b))):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            side = np.zeros((n, len(part)), np.float32)
            side[rows[hit], place[hit]] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    return common * (1 + similarity) >= similarity * (size_a[:, None] + size_b[None, :]) - 1e-6


def _block_links(a: list, b: list, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of all pairs of ``(name, set)`` between two lists, thinned, compared in blocks."""
    for i in range(0, len(a), 512):
        x = a[i : i + 512]
        for j in range(0, len(b), 512):
            y = b[j : j + 512]
            near = alike([v for _, v in x], [v for _, v in y], similarity)
            yield from thinned(near, np.array([k for k, _ in x]), np.array([k for k, _ in y]))


def group_links(own: list, guests: list, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect just what the pairs within ``own`` and between ``own`` and ``guests`` connect.

    Rows that are alike to one row, the pivot, are connected already and aren't compared with each other: a large group
    of near copies costs a comparison each with the pivot, and the others are compared with all.
    """
    rows = own + guests
    for p in range(0, len(own), max(1, len(own) // 3)):
        hit = np.concatenate([alike([own[p][1]], [v for _, v in rows[i : i + 512]], similarity)[0] for i in range(0, len(rows), 512)])
        if 2 * hit.sum() > len(rows):
            break
    else:
        hit = np.zeros(len(rows), bool)
        p = 0
    names = np.array([k for k, _ in rows])
    yield names[hit], np.full(int(hit.sum()), own[p][0])
    held, free = ([r for r, h in zip(own, hit, strict=False) if h == yes] for yes in (True, False))
    yield from _block_links(free, rows, similarity)
    yield from _block_links(held, [r for r, h in zip(guests, hit[len(own) :], strict=True) if not h], similarity)


def prints(docs: DataFrame, s: Shingling) -> DataFrame:
    """``(doc_id, name, n, f0, f1, ...)`` of every row with an id; ``name`` names the shingle set, ``n`` is its size. Staged."""
    names = [f"f{i}" for i in range(s.lanes)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            sets = [shingles(t, s.width) for t in batch.column(1).to_pylist()]
            lanes = np.stack([wide_print(x, s.lanes) for x in sets]) if sets else np.zeros((0, s.lanes), np.int64)
            columns = [batch.column(0), pa.array([name_of(x) for x in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), *map(pa.array, lanes.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "n", *names])

    return staged(_plain(docs).mapInArrow(run, f"doc_id long, name long, n long, {', '.join(f'{x} long' for x in names)}"), "prints")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def candidates(distinct: DataFrame, s: Shingling) -> DataFrame:
    """``(name, grp)`` of the sets whose fingerprints are connected by steps within the radius.

    Sets of a similarity differ in size by a factor of 1 / similarity at most, so a tile is a class of sizes and meets
    itself and the next one; there are at most some 150 tiles.
    """
    width = -math.log(s.similarity) * 1.001
    sized = distinct.select(F.col("name").alias("id"), F.floor(F.log(F.greatest("n", F.lit(1))) / width).cast("int").alias("tile"), *[f"f{i}" for i in range(s.lanes)])
    found = tiled_links(sized, [0, 1], s.radius, [f"f{i}" for i in range(s.lanes)])
    return components(found).select(F.col("node").alias("name"), F.col("component").alias("grp"))


def near_links(docs: DataFrame, rows: DataFrame, s: Shingling) -> DataFrame:
    """Links ``(a, b)`` between names that connect just the sets that are alike, given ``rows``, the prints of ``docs``.

    Fingerprints propose groups; the texts of a group's sets are read again, and whole sets decide. Links are thinned
    after this check, so a large group gives a few rows per member and loses no connection.
    """
    distinct = rows.groupBy("name").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", *[f"f{i}" for i in range(s.lanes)])])
    distinct = staged(distinct, "distinct")
    groups = staged(candidates(distinct, s), "groups")
    shares = groups.groupBy("grp").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("shares"))
    wanted = staged(distinct.select("name", "first").join(groups, "name").join(shares, "grp").select(F.col("first").alias("id"), F.col("name").alias("wanted"), "grp", "shares"), "wanted")
    plain = _plain(docs)
    texts = plain.join(wanted.hint("shuffle_hash"), plain["doc_id"] == wanted["id"]).select("wanted", "grp", "shares", "text")

    def sets_of(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_in):
            sets = [shingles(t, s.width) for t in batch.column(3).to_pylist()]
            own = pa.array([name_of(x) == w for x, w in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x.tobytes() for x in sets], pa.binary())], ["name", "grp", "shares", "shingles"])
            yield found.filter(own)  # an id may come with several texts; a name has one set

    held = texts.mapInArrow(sets_of, "name long, grp long, shares int, shingles binary").groupBy("grp", "name").agg(F.first("shares").alias("shares"), F.first("shingles").alias("shingles"))
    held = held.withColumn("own", F.pmod(F.xxhash64("name"), F.col("shares")).cast("int"))
    # every row visits the shares before its own, so each pair of shares meets once
    dealt = held.select("grp", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("share"), "own", "name", "shingles")
    dealt = dealt.select("grp", "share", (F.col("own") != F.col("share")).cast("int").alias("visits"), "name", "shingles")

    def run(rows_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list) -> pa.RecordBatch:
            x, y = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in (0, 1))
            keep = x != y
            return pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], ["a", "b"])

        key, own, guests, first = None, [], [], True

        def close(found: list) -> None:
            """Compare what has been gathered: own rows with each other once, guests with the own rows."""
            if own and (first or guests):
                found += group_links(own, guests, s.similarity) if first else _block_links(own, guests, s.similarity)

        for batch in rows_in:
            found: list = []
            for grp, share, visits, name, raw in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if (grp, share) != key:
                    close(found)
                    key, own, guests, first = (grp, share), [], [], True
                (guests if visits else own).append((name, np.frombuffer(raw, np.uint64)))
                if len(guests) >= 2 * BUCKET_ROWS:  # the own rows come before all visits
                    close(found)
                    guests, first = [], False
            yield batch_of(found)
        found = []
        close(found)
        yield batch_of(found)

    return dealt.repartition("grp", "share").sortWithinPartitions("grp", "share", "visits").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, s: Shingling = Shingling()) -> DataFrame:
    """One row of each class of near copies stays, a row with the smallest doc_id; classes are connected components.

    Null and empty texts are one class. Rows without an id take no part and stay. Repeated ids are treated as in
    ``simhash_dedup``; an empty table stays empty, and other columns are carried along whatever their names.
    """
    rows = prints(docs, s)
    linked = components(near_links(docs, rows, s)).withColumnRenamed("node", "name")
    named = rows.groupBy("name").agg(F.min("doc_id").alias("first")).join(linked, "name", "left").select("name", "first", F.coalesce("component", "name").alias("component"))
    named = staged(named, "named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = rows.select("doc_id", "name").join(named.join(least, "component").select("name", "component_id"), "name")
    return one_of_each(docs, classes.select("doc_id", "component_id"))
