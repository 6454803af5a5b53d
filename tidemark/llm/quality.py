"""Repetition rules: characters inside duplicated word n-grams and duplicated lines, by rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import SPACES, batches

SYMBOLS = "#*$%&|<>"
WINDOW = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """A text is rejected if the share of its word characters in repeats reaches a limit.

    ``grams`` pairs an n-gram length with the largest share of characters in n-grams met earlier in the text; ``lines``
    is the largest share in lines met earlier. Prose stays well below; lists of one word or passage over and over don't.
    """

    grams: tuple[tuple[int, float], ...] = ((4, 0.40), (6, 0.30), (10, 0.25), (16, 0.20))
    lines: float = 0.30
    min_words: int = 50
    repeat_percent: int = 50


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Spread small word numbers over 64 bits."""
    x = ids.astype(np.uint64) + np.uint64(1)
    x *= _BASE
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _covered(marks: np.ndarray, width: int, total: int) -> np.ndarray:
    """Words below any marked window of this width."""
    edge = np.zeros(total + 1, np.int32)
    edge[:-1][: len(marks)] += marks
    edge[width : width + len(marks)] -= marks
    return np.cumsum(edge[:-1]) > 0


def _duplicates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are found twice or more, and which of them were met earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again


def measure(text: str | None, limits: Limits) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_share, gram shares...`` of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line) - sum(line.count(c) for c in SPACES)
            else:
                seen.add(line)
    repeated, shares = 0, [0.0] * len(limits.grams)
    if n >= WINDOW:
        number: dict[bytes, int] = {}
        ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
        distinct = list(number)
        lengths = np.fromiter([len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in distinct], np.int64, len(distinct))[ids]
        value = _mixed(ids)
        rolled, width = value, 1
        for want in sorted({WINDOW, *(g for g, _ in limits.grams)}):
            if want > n:
                break
            while width < want:
                width += 1
                rolled = rolled[:-1] * _BASE + value[width - 1 :]
            twice, again = _duplicates(rolled)
            if want == WINDOW:
                repeated = int(_covered(twice, want, n).sum())
            for i, (g, _) in enumerate(limits.grams):
                if g == want and again.any():
                    shares[i] = float(lengths[_covered(again, want, n)].sum() / chars)
    return n, chars, symbols, dup_lines, repeated, dup_line_chars / chars if chars else 0.0, *shares


def repetition_report(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Measures and verdict of every row of ``docs(doc_id, text)``; one scan, no shuffle, rows independent of each other.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated three-word windows. ``kept``: not
    base_failed and every repetition share below its limit. A null or empty text has no words, so it fails. Repeated
    rows are judged alike; an empty table gives an empty report.
    """
    names = [f"dup_share_{g}" for g, _ in limits.grams]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, " + ", ".join(f"{x} double" for x in names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.float64()] * (1 + len(names))
        for batch in batches(rows):
            found = [measure(t, limits) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    report = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    calm = F.col("dup_line_share") < limits.lines
    for name, (_, most) in zip(names, limits.grams, strict=True):
        calm &= F.col(name) < most
    return report.withColumn("base_failed", failed).withColumn("kept", ~failed & calm)


def accepted(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that ``repetition_report`` keeps, with all their columns, in one scan.

    Null and empty texts go, having too few words. Repeated rows stay or go alike; an empty table stays empty; other
    columns are carried along (their names hold no dots or backticks).
    """
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            yield batch.filter(pa.array([verdict(measure(t, limits), limits) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)


def verdict(found: tuple, limits: Limits) -> bool:
    n, _, _, _, repeated, lines, *shares = found
    return n >= limits.min_words and 100 * repeated <= limits.repeat_percent * n and lines < limits.lines and all(s < most for s, (_, most) in zip(shares, limits.grams, strict=True))
