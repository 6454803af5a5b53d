"""Cost-balanced packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import batches, staged

CAPACITY = 2048
END_ID = 1
#: Cost of n tokens in one document: LINEAR * n for the feed-forward part and QUADRATIC * n * n for attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Pieces that are packed together, on average; their number of groups grows with the input.
GROUP_PIECES = 2048
#: Chunks of text between white space whose ids a worker remembers, give or take one batch's.
MEMORY = 600_000
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 23
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters whose case, composition and class the tokenizer and Arrow treat alike; texts with others, and
#: texts that may hold one of the tokenizer's added tokens, are encoded whole.
_ODD = "<[|]|[^\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]"
#: The tokenizer's own cut into words, after lower-casing, for chunks of such characters.
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^ \t-\ra-z\u00df-\u00f6\u00f8-\u017f0-9]+")
#: A letter, then signs up to white space: a cut of the tokenizer's own, so that words are met without their full stops.
_SIGNS = "([a-z\u00df-\u00f6\u00f8-\u017f])([^ \t-\ra-z\u00df-\u00f6\u00f8-\u017f0-9']+)([ \t-\r]|$)"


class Encoder:
    """Ids of whole texts. No token spans white space, so chunks met before are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Chunks met before, the place of each one's ids in ``pool``, and their number."""
        self.known = pa.array([], pa.string())
        self.pool, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, chunks: pa.Array) -> None:
        """The ids of new chunks: their words are encoded in one text and parted at the tokens that close a word."""
        words = list(map(_CUT.findall, chunks.to_pylist()))
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(chain.from_iterable(words))], add_special_tokens=False)[0].ids, "<u4")
        ends = np.concatenate(([0], np.flatnonzero(self.last[ids]) + 1))
        stops = np.concatenate(([0], np.cumsum(list(map(len, words)))))
        if len(ends) == stops[-1] + 1:
            places = ends[stops]
        else:
            each = [self.whole(chunk) for chunk in chunks.to_pylist()]
            ids, places = np.concatenate(each), np.concatenate(([0], np.cumsum(list(map(len, each)))))
        self.known = pa.concat_arrays([self.known, chunks])
        self.starts = np.concatenate((self.starts, len(self.pool) + places[:-1]))
        self.sizes = np.concatenate((self.sizes, np.diff(places)))
        self.pool = np.concatenate((self.pool, ids))

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null one is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(pa.array(odd), "", texts)), _SIGNS, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(plain)
        chunks = lists.flatten().dictionary_encode()
        if len(self.known) > MEMORY:
            self.forget()
        new = chunks.dictionary.filter(pc.invert(pc.is_in(chunks.dictionary, self.known)))
        if len(new):
            self.learn(new)
        at = pc.index_in(chunks.dictionary, self.known).to_numpy()[chunks.indices.to_numpy()]
        ends = np.concatenate(([0], np.cumsum(self.sizes[at])))
        ids = self.pool[np.repeat(self.starts[at] - ends[:-1], self.sizes[at]) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [self.whole(texts[i].as_py()) if odd[i] else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids, closed by END_ID and cut into whole sequences and one rest; one scan, no shuffle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), np.array([END_ID], "<u4")
        for batch in batches(rows, ENCODE_BYTES):
            out = []
            for doc, found in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1)), strict=True):
                ids = np.concatenate([found, end])
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    out.append((doc, at, len(part), zlib.crc32(part), len(ids)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def balanced(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences.

    Pieces in descending order of cost each go to the sequence of lowest cost that has room; a new sequence opens only
    if none has. Whole sequences are set aside first; the open ones of a group, some hundreds, are compared at once.
    """
    cost = LINEAR * lengths + QUADRATIC * lengths.astype(float) ** 2
    order = np.lexsort((np.arange(len(lengths)), -cost))
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n_full = int((lengths >= capacity).sum())
    seq[order[:n_full]] = np.arange(n_full)
    rest = order[n_full:]
    n_open = max(1, -(-int(lengths[rest].sum()) // capacity))
    room, load = np.full(len(rest) + 1, capacity), np.zeros(len(rest) + 1)
    for i in rest.tolist():
        n = lengths[i]
        s = int(np.where(room[:n_open] >= n, load[:n_open], np.inf).argmin())
        if room[s] < n:
            s, n_open = n_open, n_open + 1
        seq[i], offset[i] = n_full + s, capacity - room[s]
        room[s] -= n
        load[s] += cost[i]
    return seq, offset, n_full + n_open


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)`` with their ``sequence_id``, ``offset`` and estimated ``cost``.

    Pieces, written before they are counted, meet in groups of some thousands by a hash; a document of whole sequences
    and a rest may span groups. A null text is empty: its one id closes it. Repeated rows are packed as documents of
    their own. Sequence ids are unique and gapless within a group; an empty table gives no pieces.
    """
    cut = staged(pieces(docs, path or vocabulary_path(), capacity), "pieces")
    groups = max(1, cut.count() // GROUP_PIECES)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        seq, offset, _ = balanced(lengths, capacity)
        _, number = np.unique(seq, return_inverse=True)
        rows["sequence_id"], rows["offset"] = number + (int(key[0]) << 32), offset
        rows["cost"] = LINEAR * lengths + QUADRATIC * lengths.astype(float) ** 2
        return rows.drop(columns="bin")

    dealt = cut.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long"))
    return dealt.groupBy("bin").applyInPandas(run, f"{PIECES}, sequence_id long, offset long, cost double")
