"""SimHash fingerprints and an exact, tiled search for fingerprints within a few bits of each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.staging import batches, staged

SEED = 42
RADIUS = 2
SHINGLE = 3
#: Fingerprints that one task holds as rows of a tile; larger tiles are dealt over several tasks.
TILE_ROWS = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bits that are set in over half of the shingles' hashes, repeats included; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id long, fp long)`` for every row; one scan, no shuffle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def thinned(near: np.ndarray, a_id: np.ndarray, b_id: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A few links per id that connect just the ids which the pairs of ``near`` connect."""
    root = np.arange(len(a_id))
    while True:  # the smallest row reachable within this block
        col = np.where(near, root[:, None], len(a_id)).min(axis=0)
        new = np.minimum(root, np.where(near, col[None, :], len(a_id)).min(axis=1))
        if (new == root).all():
            break
        root = new
    hit, hit_a = col < len(a_id), near.any(axis=1)
    yield b_id[hit], a_id[col[hit]]
    yield a_id[hit_a], a_id[root[hit_a]]


def _spanning(own: np.ndarray, own_id: np.ndarray, other: np.ndarray, other_id: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the two sets, thinned to a few per fingerprint without losing who is connected to whom.

    Fingerprints are rows of 64-bit words. Both sets are ordered by population count, and blocks whose counts differ by
    more than the radius are skipped.
    """
    ones, other_ones = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (own, other))
    order, other_order = ones.argsort(kind="stable"), other_ones.argsort(kind="stable")
    for i in range(0, len(own), 128):
        at = order[i : i + 128]
        a, a_id, least, most = own[at], own_id[at], ones[at[0]] - radius, ones[at[-1]] + radius
        lo, hi = np.searchsorted(other_ones[other_order], [least, most + 1])
        for j in range(lo, hi, 1024):
            to = other_order[j : min(j + 1024, hi)]
            b = other[to]
            far = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
            for lane in range(1, own.shape[1]):
                far += np.bitwise_count(a[:, None, lane] ^ b[None, :, lane])
            near = far <= radius
            if near.any():
                yield from thinned(near, a_id, other_id[to])


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` that connect just those ids of distinct ``prints(id, fp)`` that differ in ``radius`` bits or fewer.

    A fingerprint is cut into radius + 1 parts. Two that differ in ``radius`` bits agree in one part at least, so a tile is
    a value of a part, every print lies in radius + 1 tiles, and no pair within the radius is missed. Inside a tile,
    blocks whose population counts differ by more than the radius are skipped.
    """
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    values = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1) if hi - lo < 64 else F.lit(-1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    tile = F.explode(F.array(*[value * (radius + 1) + i if radius else value for i, value in enumerate(values)])).alias("tile")
    return tiled_links(prints.select("id", "fp", tile), [0], radius, ["fp"])


def tiled_links(tiles: DataFrame, steps: list[int], radius: int, lanes: list[str]) -> DataFrame:
    """Links ``(a, b)`` of ``tiles(id, tile, *lanes)`` within ``radius`` bits over all lanes, for tiles that differ by a step.

    Tiles beyond TILE_ROWS are dealt over several tasks by a hash; the table of these is small, as each stands for that
    many rows. Links are thinned, no connection is lost.
    """
    large = staged(tiles.groupBy("tile").agg(F.count("*").alias("n")).where(F.col("n") > TILE_ROWS).select(F.col("tile").alias("at"), F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("shares")), "tiles")

    def dealt_over(rows: DataFrame) -> DataFrame:
        return rows.join(large, "at", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))

    # owner rows stay in their own tile's share; every row also visits each share of the tiles that it may match
    own = dealt_over(tiles.withColumnRenamed("tile", "at")).select("at", F.pmod(F.xxhash64(*lanes), F.col("shares")).cast("int").alias("share"), F.lit(0).alias("visits"), "id", *lanes)
    step = F.explode(F.array(*map(F.lit, steps))).alias("step")
    visits = dealt_over(tiles.select("id", *lanes, "tile", step).select("id", *lanes, (F.col("tile") - F.col("step")).alias("at")))
    visits = visits.select("at", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(1).alias("visits"), "id", *lanes)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own_fp, own_id = None, [], []
        a = a_id = None
        for batch in filter(len, rows):
            at, share, kind, ids, *words = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4 + len(lanes)))
            fps = np.stack(words, axis=1).astype(np.int64).view(np.uint64)
            cut = np.concatenate(([0], np.flatnonzero((np.diff(at) != 0) | (np.diff(share) != 0)) + 1, [len(at)]))
            # a print that is alone in its tile meets itself only
            alone = (np.diff(cut) == 2) & (ids[cut[:-1].clip(max=len(at) - 1)] == ids[(cut[:-1] + 1).clip(max=len(at) - 1)])
            alone[[0, -1]] = False  # a tile may go on in the next batch
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in zip(cut[:-1][~alone].tolist(), cut[1:][~alone].tolist(), strict=True):
                if lo == hi:
                    continue
                if (at[lo], share[lo]) != key:
                    key, own_fp, own_id, a = (at[lo], share[lo]), [], [], None
                mid = lo + int(np.searchsorted(kind[lo:hi], 1))
                if mid > lo:
                    own_fp.append(fps[lo:mid])
                    own_id.append(ids[lo:mid])
                if hi > mid:
                    if a is None:
                        a, a_id = np.concatenate([np.zeros((0, len(lanes)), np.uint64), *own_fp]), np.concatenate([np.zeros(0, np.int64), *own_id])
                    out.extend(_spanning(a, a_id, fps[mid:hi], ids[mid:hi], radius))
            if out:
                x, y = (np.concatenate([o[i] for o in out]) for i in (0, 1))
                keep = x != y
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], ["a", "b"])

    # a set number of tasks, as the work of a tile is more than its bytes tell
    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(visits).repartition(tasks, "at", "share").sortWithinPartitions("at", "share", "visits")
    return dealt.mapInArrow(run, "a long, b long")


def _plain_tile(counts: tuple[int, ...]) -> int:
    key = 0
    for c in counts:
        key = key * 32 + c
    return key


def simhash_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    Rows with one fingerprint are one vertex from the start, so copies cost nothing beyond a combined minimum.
    Null and empty texts have fingerprint zero and are linked like any other. A class whose ids are all null has a
    null component; other nulls are passed over in the minimum. Repeated rows come back as often as they came.
    """
    prints = staged(fingerprints(docs), "prints")
    return classes_of(prints, lambda vertices: near_links(vertices, radius))


def classes_of(prints: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``prints(doc_id, fp)``, given the links of ``vertices(id, fp)``."""
    # a vertex is named by its smallest doc_id; a fingerprint whose ids are all null takes part under a name of its own
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    vertices = distinct.withColumn("id", F.col("fp"))
    linked = components(links_of(vertices.select("id", "fp")))
    member = vertices.join(linked.withColumnRenamed("node", "id"), "id", "left").select("fp", "first", F.coalesce("component", "id").alias("component"))
    member = staged(member, "member")
    least = staged(member.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    classes = staged(member.join(least, "component").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each class stays: a row with the smallest doc_id; all columns of ``docs`` are kept.

    Rows that repeat the smallest doc_id of a class count as one document; the one with the smallest text hash stays.
    An id that is repeated in two classes goes with either. Rows without an id stay.
    """
    return one_of_each(docs, simhash_classes(docs, radius))


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, given ``classes(doc_id, ..., component_id)``: all but those of ids that aren't their class's.

    The ids to drop grow with the rows, so they meet the rows by a shuffle at every size; rows without an id stay.
    """
    named = staged(classes.where("doc_id is not null").groupBy("doc_id", "component_id").count(), "named")
    dropped = named.where("doc_id <> component_id").select(F.col("doc_id").alias("_dropped"))
    kept = docs.join(dropped.hint("shuffle_hash"), docs["doc_id"].cast("long") == dropped["_dropped"], "left_anti")
    twice = named.where("doc_id = component_id and count > 1").select(F.col("doc_id").alias("_twice"))
    if not twice.limit(1).count():
        return kept
    once = kept.join(twice.hint("shuffle_hash"), kept["doc_id"].cast("long") == twice["_twice"], "left_anti")
    again = kept.join(twice.hint("shuffle_hash"), kept["doc_id"].cast("long") == twice["_twice"], "left_semi")
    least = F.min_by(F.struct(*[again[c] for c in docs.columns]), F.struct(F.xxhash64(again["text"]), F.xxhash64(*[again[c] for c in docs.columns])))
    return once.unionByName(again.groupBy(again["doc_id"].cast("long").alias("_doc")).agg(least.alias("_row")).select("_row.*"))
