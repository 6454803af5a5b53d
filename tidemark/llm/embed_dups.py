"""Near-duplicate vectors: Euclidean p-stable hashing for candidates, exact cosines for links."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.staging import staged

COSINE = 0.95
#: Rows of a bucket that one task compares with the rest of it; larger buckets are dealt over several tasks.
SHARE_ROWS = 1024


@dataclass(frozen=True)
class Hashing:
    """``projections`` quantised by ``width`` make a bucket; vectors meet if any of ``tables`` buckets agrees.

    At the distance that a cosine of 0.95 leaves between unit vectors, 0.316, a projection agrees with a probability of
    0.874, for unrelated vectors (a distance of 1.41) with one of 0.486.
    """

    tables: int = 16
    projections: int = 8
    width: float = 2.0
    seed: int = 11

    @classmethod
    def for_rows(cls, n: int, missed: float = 0.0013) -> Hashing:
        """Buckets that stay small at any number of rows: a projection more for each doubling or so beyond 20,000, and as
        many tables as a pair at 0.95 needs to miss all with the given probability. Tables grow with n ** 0.19."""
        projections = 8 + max(0, math.ceil(math.log(max(n, 1) / 20_000) / -math.log(0.486)))
        return cls(max(16, math.ceil(math.log(missed) / math.log1p(-(0.874**projections)))), projections)


@lru_cache(maxsize=8)
def _planes(h: Hashing, size: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng((h.seed, size))
    return g.standard_normal((size, h.tables * h.projections)), g.uniform(0, h.width, h.tables * h.projections)


def bucket_keys(unit: np.ndarray, h: Hashing) -> np.ndarray:
    """A 64-bit bucket key for each row and table; the vector's length and the table are part of it."""
    planes, shift = _planes(h, unit.shape[1])
    cells = np.floor((unit @ planes + shift) / h.width).astype(np.int64).reshape(len(unit), h.tables, h.projections)
    key = np.broadcast_to(np.arange(h.tables, dtype=np.uint64) + np.uint64(unit.shape[1] << 8), cells.shape[:2]).copy()
    for j in range(h.projections):
        key = (key ^ cells[:, :, j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors as a matrix, by length of vector."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    starts, flat = np.concatenate(([0], np.cumsum(sizes)[:-1])), column.flatten().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(float)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _compare(a: tuple, b: tuple, table: int, cosine: float, h: Hashing, counts: dict, edges: list) -> None:
    """Count the links between shares a and b of a bucket, each pair only in the first table in which it meets."""
    (ids_a, copies_a, unit_a), (ids_b, copies_b, unit_b) = a, b
    for i in range(0, len(ids_a), 256):
        for j in range(0, len(ids_b), 1024):
            near = unit_a[i : i + 256] @ unit_b[j : j + 1024].T >= cosine
            near &= ids_a[i : i + 256, None] < ids_b[None, j : j + 1024]
            x, y = np.nonzero(near)
            if not len(x):
                continue
            if table:
                rows_x, at_x = np.unique(x, return_inverse=True)
                rows_y, at_y = np.unique(y, return_inverse=True)
                keys_x, keys_y = (bucket_keys(u, h)[:, :table] for u in (unit_a[rows_x + i], unit_b[rows_y + j]))
                fresh = ~(keys_x[at_x] == keys_y[at_y]).any(axis=1)
                x, y = x[fresh], y[fresh]
                if not len(x):
                    continue
            x, y = x + i, y + j
            for ids, at, weight in ((ids_a, x, copies_b[y]), (ids_b, y, copies_a[x])):
                who, inverse = np.unique(at, return_inverse=True)
                for w, n in zip(ids[who].tolist(), np.bincount(inverse, weight).astype(np.int64).tolist(), strict=True):
                    counts[w] = counts.get(w, 0) + n
            # edges that keep the block's components: each row to its first column, each column to its first row
            keep = _spanning(x, y)
            edges.append((ids_a[x[keep]], ids_b[y[keep]]))


def _spanning(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Some of the links (x, y) between rows and columns that connect what all of them connect."""
    _, rows = np.unique(x, return_inverse=True)
    _, cols = np.unique(y, return_inverse=True)
    n_rows = rows.max() + 1
    parent = list(range(n_rows + cols.max() + 1))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    keep = []
    for k, (r, c) in enumerate(zip(rows.tolist(), (cols + n_rows).tolist(), strict=True)):
        r, c = find(r), find(c)
        if r != c:
            parent[c] = r
            keep.append(k)
    return np.array(keep, np.int64)


def embedding_classes(vectors: DataFrame, cosine: float = COSINE, hashing: Hashing | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``.

    Equal vectors are one vertex with a count from the start. Null or zero vectors, and those with null or non-finite
    components, link with nothing. Vectors of different lengths don't link. Rows with a null id count as links of
    others and have a null component; a repeated row is a vector of its own. An empty table gives an empty result.
    Unless given, the hashing is chosen for the number of distinct vectors.
    """
    e = F.col("embedding")
    good = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), good.alias("good")), "vectors")
    sound = rows.where("good").select("vec_id", "e")
    distinct = staged(sound.groupBy("e").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    hashing = hashing or Hashing.for_rows(distinct.count())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _rows(batch.column(1)):
                keys = bucket_keys(_unit(matrix), hashing)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, hashing.tables), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists], ["id", "keys"])

    buckets = staged(distinct.select("id", "e").mapInArrow(hashed, "id long, keys array<long>").select("id", F.posexplode("keys").alias("table", "key")), "keys")
    sizes = staged(buckets.groupBy("table", "key").count().where("count > 1").select("table", "key", F.ceil(F.col("count") / SHARE_ROWS).cast("int").alias("shares")), "buckets")
    met = staged(buckets.join(sizes, ["table", "key"]).select("id", "table", "key", "shares", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share")), "met")
    # a bucket of one share is compared with itself; of several, each share holds its own rows while all rows pass by
    own = met.select("id", "table", "key", "share", F.lit(0).alias("visits"))
    visits = met.where("shares > 1").select("id", "table", "key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(1).alias("visits"))
    dealt = own.unionByName(visits).join(distinct.select("id", "copies", "e"), "id").select("table", "key", "share", "visits", "id", "copies", "e")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own_parts, a = None, [], None
        counts: dict[int, int] = {}
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> tuple:
            return tuple(np.concatenate([p[i] for p in own_parts]) for i in range(3))

        def alone() -> None:
            if own_parts and a is None:
                whole = joined()
                _compare(whole, whole, group[0], cosine, hashing, counts, edges)

        def found() -> pa.RecordBatch:
            who, links = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
            x, y = (np.concatenate([who, *(p[i] for p in edges)]) for i in (0, 1))
            n = np.concatenate([links, np.zeros(len(x) - len(who), np.int64)])
            counts.clear()
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            table, key, share, kind, ids, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            starts = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(6)).to_numpy(zero_copy_only=False))))
            flat = batch.column(6).flatten().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0) | (np.diff(share) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(key)], strict=True):
                if lo == hi:
                    continue
                if (table[lo], key[lo], share[lo]) != group:
                    alone()
                    group, own_parts, a = (int(table[lo]), key[lo], share[lo]), [], None
                mid = lo + int(np.searchsorted(kind[lo:hi], 1))
                for p, q in ((lo, mid), (mid, hi)):
                    if p == q:
                        continue
                    part = ids[p:q], copies[p:q].astype(float), _unit(flat[starts[p] : starts[q]].reshape(q - p, -1))  # one length in a bucket
                    if q == mid:
                        own_parts.append(part)
                    else:
                        a = a or (joined() if own_parts else ((np.zeros(0, np.int64), np.zeros(0), np.zeros((0, part[2].shape[1])))))
                        _compare(a, part, group[0], cosine, hashing, counts, edges)
            if len(counts) + len(edges) > 50_000:
                yield found()
        alone()
        if counts or edges:
            yield found()

    ordered = dealt.repartition("table", "key", "share").sortWithinPartitions("table", "key", "share", "visits")
    links = staged(ordered.mapInArrow(compared, "a long, b long, n long"), "links")
    counted = links.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    linked = components(links.where("n = 0").select("a", "b"))
    member = distinct.join(counted, "id", "left").join(linked.withColumnRenamed("node", "id"), "id", "left")
    member = staged(member.select("e", "first", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "member")
    least = staged(member.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    classes = staged(member.join(least, "component").select("e", "n_links", "component_id"), "classes")
    found = sound.join(classes, "e").select("vec_id", "n_links", "component_id")
    unsound = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(unsound).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
