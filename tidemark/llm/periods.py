"""Periodic runs of words by partition refinement: classes of equal factors, refined length by length, smaller halves first."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import batches, words_of

#: Runs of ASCII white space.
GAPS = r"[\x20\x09-\x0D]+"
#: A run has at least this many words and holds its period at least so often.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of text that one refinement works on at once; a longer text is a batch of its own.
BATCH = 1 << 23
#: Distances that wait unsorted until they are merged into the sorted ones, and the pieces that they may lie in.
WAITING, CHUNKS = 4096, 16


class _Due:
    """Positions by the distance to the next member of their class, handed out when the length comes to that distance.

    Distances of a position only grow, so an entry that no longer holds is dropped when it is met.
    """

    def __init__(self, following: np.ndarray, longest: np.ndarray) -> None:
        self.following, self.longest = following, longest
        self.gaps = np.empty(0, np.int32)
        self.places = np.empty(0, np.int32)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def put(self, places: np.ndarray, length: int) -> None:
        gaps = self.following[places] - places
        use = (gaps >= length) & (gaps <= self.longest[places])
        if use.any():
            self.waiting.append((gaps[use], places[use]))
            self.n_waiting += int(use.sum())

    def merge(self, length: int) -> None:
        gaps = np.concatenate([self.gaps, *(g for g, _ in self.waiting)])
        places = np.concatenate([self.places, *(p for _, p in self.waiting)])
        use = (gaps >= length) & (self.following[places] - places == gaps)
        order = np.argsort(gaps[use], kind="stable")
        self.gaps, self.places, self.waiting, self.n_waiting = gaps[use][order], places[use][order], [], 0

    def take(self, length: int) -> np.ndarray:
        """Positions, in order, whose class's next member is ``length`` on."""
        if self.n_waiting > max(WAITING, len(self.gaps) // 8):
            self.merge(length)
        elif len(self.waiting) > CHUNKS:
            gaps, places = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            use = (gaps >= length) & (self.following[places] - places == gaps)
            self.waiting, self.n_waiting = [(gaps[use], places[use])], int(use.sum())
        low, high = np.searchsorted(self.gaps, np.array([length, length + 1], np.int32))
        places = np.concatenate([self.places[low:high], *(p[g == length] for g, p in self.waiting)])
        return np.unique(places[self.following[places] - places == length])

    def rest(self, length: int) -> Iterator[tuple[int, np.ndarray]]:
        """All distances from ``length`` on, once no class changes any more."""
        self.merge(length)
        bounds = np.flatnonzero(np.append(True, self.gaps[1:] != self.gaps[:-1])) if len(self.gaps) else []
        for low, places in zip(bounds, np.split(self.places, bounds[1:]) if len(bounds) else [], strict=True):
            yield int(self.gaps[low]), np.unique(places)


def _first_classes(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by text and word, and the bounds of the classes in them."""
    order = np.lexsort((words, text)).astype(np.int32)
    new = np.ones(len(order), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    return order, np.flatnonzero(new).astype(np.int32)


def squares(words: np.ndarray, text: np.ndarray, left: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(length, positions)``: where a factor of this length that isn't itself a repetition stands twice in a row.

    ``words`` numbers the words of all texts one after another, ``text`` the texts in order. By position, ``left`` counts
    the words to the text's end and ``most`` is the longest period looked for. A position whose factor would pass the
    end, or that is farther than ``most`` from both neighbours in its class (which only move away), stays where it is:
    it is in no square that counts. Classes lie as slices of ``members``; those that leave a class are swapped to its
    slice's end. Of the classes that one splits into, the largest keeps its name, and only the others split their
    predecessors' classes at the next length, so that a position is touched a logarithmic number of times.
    """
    n = len(words)
    members, starts = _first_classes(words, text)
    sizes = np.diff(np.append(starts, n)).astype(np.int32)
    n_classes = len(starts)
    start, size = np.zeros(2 * n + 1, np.int32), np.zeros(2 * n + 1, np.int32)
    start[:n_classes], size[:n_classes] = starts, sizes
    where, name = np.empty(n, np.int32), np.empty(n, np.int32)
    where[members] = np.arange(n, dtype=np.int32)
    name[members] = np.repeat(np.arange(n_classes, dtype=np.int32), sizes)
    following, before = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    same = name[members[1:]] == name[members[:-1]]
    following[members[:-1][same]] = members[1:][same]
    before[members[1:][same]] = members[:-1][same]
    due = _Due(following, np.minimum(most, left // 2))
    due.put(np.arange(n, dtype=np.int32), 1)
    # of each text's classes all but the largest
    owner = text[members[starts]]
    biggest = np.lexsort((-sizes, owner))
    head = np.ones(len(biggest), bool)
    head[1:] = owner[biggest][1:] != owner[biggest][:-1]
    small = np.setdiff1d(np.arange(n_classes), biggest[head], assume_unique=True)
    length = 1
    while True:
        if not len(small):
            yield from due.rest(length)
            return
        found = due.take(length)
        if len(found):
            yield length, found
        # positions in front of the small classes' members, by the class they are in and the class that follows them
        lengths = size[small]
        at = np.repeat(start[small] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        behind = members[at]
        moved = behind - 1
        use = (behind > 0) & (text[moved] == text[behind])
        behind, moved = behind[use], moved[use]
        ahead, back = following[moved], before[moved]
        near = ((ahead >= 0) & (ahead - moved <= most[moved])) | ((back >= 0) & (moved - back <= most[moved]))
        use = near & (left[moved] > length) & (most[moved] > length)
        behind, moved = behind[use], moved[use]
        if not len(moved):
            small = small[:0]
            length += 1
            continue
        order = np.lexsort((moved, name[moved].astype(np.int64) * (2 * n + 1) + name[behind]))
        moved, label, home = moved[order], name[behind[order]], name[moved[order]]
        new_home = np.ones(len(moved), bool)
        new_home[1:] = home[1:] != home[:-1]
        new_group = new_home.copy()
        new_group[1:] |= label[1:] != label[:-1]
        group_at, home_at = np.flatnonzero(new_group), np.flatnonzero(new_home)
        group_size = np.diff(np.append(group_at, len(moved)))
        homes = home[home_at]
        n_moved = np.diff(np.append(home_at, len(moved)))
        rest = size[homes] - n_moved
        home_of_group = np.cumsum(new_home)[group_at] - 1
        n_groups = np.bincount(home_of_group, minlength=len(homes))
        splits = (rest > 0) | (n_groups > 1)
        if not splits.all():  # a class that moves as a whole stays as it is
            keep = np.repeat(splits, n_moved)
            keep_group = splits[home_of_group]
            moved, home_at = moved[keep], np.append(0, np.cumsum(n_moved[splits])[:-1])
            group_size = group_size[keep_group]
            homes, rest, n_moved, n_groups = homes[splits], rest[splits], n_moved[splits], n_groups[splits]
            home_of_group = np.repeat(np.arange(len(homes)), n_groups)
        length += 1
        if not len(moved):
            small = small[:0]
            continue
        small, n_classes = _split(moved, homes, home_at, rest, n_moved, group_size, home_of_group, members, where, name, start, size, n_classes)
        _relink(moved, homes, n_moved, group_size, following, before, due, length)


def _split(moved, homes, home_at, rest, n_moved, group_size, home_of_group, members, where, name, start, size, n_classes):
    """Carve the groups of ``moved`` off their classes; gives the new small classes and the number of classes."""
    # the last places of each class's slice take the moved; whoever stays there goes to the places that they leave
    tail = start[homes] + rest
    places = np.repeat(tail - home_at, n_moved) + np.arange(len(moved))
    gone = np.zeros(len(moved), bool)
    slot = np.repeat(tail, n_moved)
    in_tail = where[moved] >= slot
    gone[(where[moved] - slot + np.repeat(home_at, n_moved))[in_tail]] = True
    staying = members[places[~gone]]
    holes = where[moved[~in_tail]]
    members[holes], where[staying] = staying, holes
    members[places], where[moved] = moved, places
    # the largest of a class's parts keeps the name
    n_groups = len(group_size)
    group_at = np.append(0, np.cumsum(group_size)[:-1])
    order = np.lexsort((-group_size, home_of_group))
    head = np.ones(n_groups, bool)
    head[1:] = home_of_group[order][1:] != home_of_group[order][:-1]
    largest = order[head]
    rest_stays = rest >= group_size[largest]
    names = np.empty(n_groups, np.int32)
    fresh = np.ones(n_groups, bool)
    fresh[largest[~rest_stays]] = False
    n_fresh = int(fresh.sum())
    names[fresh] = np.arange(n_classes, n_classes + n_fresh)
    names[~fresh] = homes[home_of_group[~fresh]]
    n_classes += n_fresh
    # the rest of a class whose largest part moved gets a name of its own, at no more cost than that part
    left = np.flatnonzero(~rest_stays & (rest > 0))
    rest_names = np.arange(n_classes, n_classes + len(left), dtype=np.int32)
    n_classes += len(left)
    if len(left):
        counts = rest[left]
        at = np.repeat(start[homes[left]] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        name[members[at]] = np.repeat(rest_names, counts)
        start[rest_names], size[rest_names] = start[homes[left]], counts
    size[homes[rest_stays]] = rest[rest_stays]
    start[names], size[names] = places[group_at], group_size
    name[moved] = np.repeat(names, group_size)
    return np.concatenate([names[fresh], rest_names]), n_classes


def _relink(moved, homes, n_moved, group_size, following, before, due, length):
    """Take ``moved`` out of their classes' lists and chain each group; note the distances that changed."""
    at_home = np.repeat(np.arange(len(homes), dtype=np.int64), n_moved)
    listed = moved[np.argsort(at_home * len(following) + moved)]  # as in the old lists, across groups
    head = np.ones(len(listed), bool)
    head[1:] = following[listed[:-1]] != listed[1:]
    tail = np.append(head[1:], True)
    left, right = before[listed[head]], following[listed[tail]]
    following[left[left >= 0]] = right[left >= 0]
    before[right[right >= 0]] = left[right >= 0]
    due.put(left[left >= 0], length)
    group_at = np.append(0, np.cumsum(group_size)[:-1])
    following[moved[:-1]] = moved[1:]
    following[moved[group_at + group_size - 1]] = -1
    before[moved[1:]] = moved[:-1]
    before[moved[group_at]] = -1
    due.put(moved, length)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of every run of each text, by start and period.

    A run is a stretch of words with its smallest period, as long as it can be, that holds the period LEAST_TIMES times
    and has LEAST_WORDS words. Squares that start at neighbouring words belong to one run.
    """
    lengths = np.array([len(words) for words in texts], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not lengths.sum():
        return found
    number: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int32, int(lengths.sum()))
    ends = np.cumsum(lengths)
    first = ends - lengths
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    left = (np.repeat(ends, lengths) - np.arange(len(words))).astype(np.int32)
    most = np.repeat((lengths // LEAST_TIMES).astype(np.int32), lengths)
    for period, places in squares(words, text, left, most):
        new = np.append(True, places[1:] != places[:-1] + 1)
        begins = places[new]
        long = np.diff(np.append(np.flatnonzero(new), len(places))) - 1 + 2 * period
        for at, length in zip(begins[use := long >= max(LEAST_WORDS, LEAST_TIMES * period)].tolist(), long[use].tolist(), strict=True):
            found[text[at]].append((at - int(first[text[at]]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join(w for w, drop in zip(words, gone.tolist(), strict=True) if not drop)


RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Periodic runs of words in every row of ``docs(doc_id, text)``: ``doc_id, runs, collapsed``; a scan, no shuffle.

    ``runs`` are ``(start, length, period)`` by start and period, counted in words; ``collapsed`` is the text without the
    repeats: the words that no run holds after its first period, joined by one space. Whole texts are refined, several
    at a time up to BATCH bytes, which bounds a task's memory but for a text that is longer itself. Null and empty texts
    have no runs and an empty ``collapsed``; repeated rows come out alike; an empty table gives an empty result; further
    columns of ``docs`` are not looked at.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH):
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            runs = runs_of(texts)
            left = [collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(texts, runs, strict=True)]
            runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kinds.field("runs").type), pa.array(left, pa.string())], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in a tenth of the texts, chosen by the CRC-32 of the id; a text without an id or
    without words stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", GAPS), lambda w: w != "")
    rows = docs.withColumn("__words", F.when(h % 10 == 0, words))
    n = F.size("__words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    tailed = F.transform("__words", lambda w, i: F.when(i < a, w).otherwise(F.get(F.col("__words"), (a + (i - a) % p).cast("int"))))
    return rows.withColumn("text", F.when(n > 0, F.array_join(tailed, " ")).otherwise(F.col("text"))).drop("__words")
