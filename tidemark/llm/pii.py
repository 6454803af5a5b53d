"""Personal data: fixed forms as seeds, and lexical patterns bootstrapped from them that find further identifiers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import SPACES, batches, staged

KINDS = ("email", "ip", "card", "phone")
#: Believed patterns that every task carries when texts are masked; with more of them rows and patterns are joined.
CARRIED = 1 << 16
# The fixed forms; a run is only tried from its first character or from where the last match ended, which finds the
# same matches in linear time.
_EMAIL = regex.compile(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = regex.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = regex.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: an unbroken run with digits, and further groups of digits behind it.
_CANDIDATE = regex.compile(r"[^\s<>\[\]{}\"',;:!?|]*+")
_WORD = regex.compile(r"[^\x20\x09-\x0D]++")
_DIGIT = regex.compile("[0-9]")
_GROUP = regex.compile(r"\(?[0-9][0-9().-]*+")
#: Addresses in other notations: what stands for the at sign, the part behind it, and four groups of digits.
_AT = regex.compile(r"[\[({<\x20\t][\x20\t]?(?:at|At|AT|@)[\x20\t]?[\])}>\x20\t]|(?<=[A-Za-z0-9])@(?=[A-Za-z0-9])|[\x20\t]@|@[\x20\t]")
_DOMAIN = regex.compile(r"[\x20\t]*+([A-Za-z0-9-]++(?:(?:[\x20\t]*+[\[({<][\x20\t]*+(?:dot|Dot|DOT|\.)[\x20\t]*+[\])}>][\x20\t]*+|[\x20\t](?:dot|Dot|DOT)[\x20\t]|\.)[A-Za-z0-9-]++)*+)")
_QUAD = regex.compile(r"(?<![0-9A-Za-z])[0-9]{1,3}+(?:(?:[\x20\t]?[\[({][\x20\t]?(?:dot|\.)[\x20\t]?[\])}][\x20\t]?|[\x20\t]dot[\x20\t]|[\x20\t]?[.-][\x20\t]?)[0-9]{1,3}+){3}(?![0-9A-Za-z])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: An identifier that patterns of every kind may propose; ``shape(kind)`` is one for patterns of that kind only.
ANY = -1
#: Longer runs are cut into parts of this many characters at most.
LONGEST = 64
SPANS = "array<struct<kind:int,start:int,stop:int>>"


@dataclass(frozen=True)
class Bootstrap:
    """``context`` words before an entity are its pattern. A pattern speaks for a kind if at least ``support`` distinct
    entities of that kind follow it and they are at least ``confidence`` of all that follows it. ``digits`` is the
    least number of digits of an identifier that isn't an address in another notation; ``rounds`` of scoring run over the graph.
    Every task gets a sieve of ``2 ** sieve_bits`` places of 4 bytes, whatever the size of the data; 22 bits suit some
    millions of patterns, fewer places only let more words through to the exact join."""

    context: int = 2
    support: int = 3
    confidence: float = 0.6
    digits: int = 5
    rounds: int = 3
    sieve_bits: int = 20


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, stop)`` of the fixed forms, in code points, by start and kind."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = "".join(_DIGIT.findall(m.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(found)


def _hash_of(value: bytes) -> int:
    return xxhash.xxh64_intdigest(value, 7) - (1 << 63)


def _hash(value: str) -> int:
    return _hash_of(value.encode("utf-8", "surrogatepass"))


_MARKS = ".,;:!?\"'()[]{}<>*#$%&|"
_MASK = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15


def _code(word: str) -> int:
    """A word of a pattern, unsigned: in lower case, with digits alike and without marks at its ends."""
    return _hash(_DIGIT.sub("0", word.lower()).strip(_MARKS)) & _MASK


def _key(words: list[str]) -> int:
    """A pattern: its words' codes in turn."""
    key = 0
    for w in words:
        key = ((key ^ _code(w)) * _MIX) & _MASK
        key ^= key >> 29
    return key - (1 << 64) if key >> 63 else key


def _keys(codes: np.ndarray, context: int) -> np.ndarray:
    """The pattern before each word but the first ``context`` ones, as ``_key`` has it."""
    n = max(0, len(codes) - context)
    key = np.zeros(n, np.uint64)
    for i in range(context):
        key = (key ^ codes[i : i + n]) * np.uint64(_MIX)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


class Codes(dict):
    """Codes of words (in UTF-8) met before; emptied when it has grown too large."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = code = _code(word.decode("utf-8", "surrogatepass"))
        return code


def shape(kind: int) -> int:
    return ANY - 1 - kind


def fits(code, kind):
    """Whether a pattern of ``kind`` may propose a candidate of this code; for numbers and for columns."""
    return (code == ANY) | (code == ANY - 1 - kind)


def addresses(text: str) -> list[tuple[int, int, int]]:
    """``(start, stop, code)`` of e-mail and IP addresses in other notations, which need no number of digits."""
    out, done = [], 0
    for m in _AT.finditer(text):
        stop = m.start()
        while stop and text[stop - 1] in " \t[({<":
            stop -= 1
        start = stop
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        d = _DOMAIN.match(text, m.end())
        if start == stop or not d:
            continue
        # a plain "at" needs a dot on one of its sides, or it is prose
        plain = m.group().strip().isalpha()
        name, domain = text[start:stop].strip("."), d.group(1)
        if plain and "." not in name and not regex.search(r"\.|[\s\[({<](?:dot|Dot|DOT)[\s\])}>]", domain):
            continue
        out.append((start, d.end(), shape(0)))
        done = d.end()
    out += [(m.start(), m.end(), shape(1)) for m in _QUAD.finditer(text) if all(int(x) <= 255 for x in regex.findall("[0-9]+", m.group()))]
    return out


def occurrences(text: str, b: Bootstrap) -> list[tuple[int, int, int, int, int]]:
    """``(start, stop, kind or code, pattern, instance)`` of all seeds and of all that may be an identifier beside them."""
    return seeds_and_occurrences(text, b)[1]


def seeds_and_occurrences(text: str, b: Bootstrap) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int]]]:
    """``base_spans`` and ``occurrences`` of a text."""
    others = addresses(text)
    if not others and not _DIGIT.search(text) and "@" not in text:
        return [], []
    seeds, out = base_spans(text), []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = np.array([s for s, _ in words])

    def entry(start: int, stop: int, kind: int) -> None:
        n = int(np.searchsorted(starts, start, "right")) - 1
        n += text[words[n][0] : start].strip("(<[{\"'+") != ""  # a part of the word before the entity is context
        before = [text[max(s, 0) : min(e, start)] for s, e in words[max(0, n - b.context) : n]]
        if len(before) == b.context:
            out.append((start, stop, kind, _key(before), _hash(text[start:stop])))

    for start, kind, stop in seeds:
        entry(start, stop, kind)
    taken, at = [(s, e) for s, _, e in seeds], 0
    for start, stop, code in others:
        if not any(x < stop and start < y for x, y in taken):
            entry(start, stop, code)
    last = -1
    for s, e in words:
        if s < last or not _DIGIT.search(text, s, e):
            continue
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        lead = s
        while lead < e and text[lead] in "(<[{\"'":
            lead += 1
        m = _CANDIDATE.match(text, lead, e)
        start, stop = lead, m.end()
        while stop < len(text) and text[stop] == " " and stop == m.end() and (g := _GROUP.match(text, stop + 1)) and g.end() - start <= LONGEST and (g.end() == len(text) or text[g.end()] in " \t\n\r\v\f.,;:!?"):
            m, stop = g, g.end()
        while stop > start and not text[stop - 1].isalnum():
            stop -= 1
        last = stop
        for part in range(start, stop, LONGEST):
            end = min(part + LONGEST, stop)
            if sum(c in "0123456789" for c in text[part:end]) < b.digits or any(x < end and part < y for x, y in taken[max(0, at - 1) : at + 4]):
                continue
            entry(part, end, ANY)
    return seeds, out


class Followers:
    """Distinct words behind the patterns of a sieve, up to a number per pattern that settles that the pattern speaks for nothing.

    ``most[bit]`` is that number, 0 where there is no pattern.
    """

    #: Words held before they are handed over.
    HELD = 200_000

    def __init__(self, most: np.ndarray, context: int):
        self.most, self.context, self.codes = most, context, Codes()
        self.found: dict[int, set[int]] = {}
        self.held = 0

    def add(self, text: str) -> None:
        words = text.encode("utf-8", "surrogatepass").split()
        keys = _keys(np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words)), self.context)
        most = self.most[keys & (len(self.most) - 1)]
        at = np.flatnonzero(most)
        for i, key, limit in zip((at + self.context).tolist(), keys[at].tolist(), most[at].tolist(), strict=True):
            behind = self.found.setdefault(key, set())
            if len(behind) < limit:
                before = len(behind)
                behind.add(_hash_of(words[i]))
                self.held += len(behind) - before

    def taken(self) -> pa.RecordBatch:
        pairs = [(key, word) for key, behind in self.found.items() for word in behind]
        self.found, self.held = {}, 0
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["pattern", "word"])


def _word_at(text: str, start: int) -> int:
    """The hash of the word that holds a place."""
    while start and text[start - 1] not in SPACES:
        start -= 1
    return _hash(_WORD.match(text, start).group())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def confident_patterns(docs: DataFrame, b: Bootstrap = Bootstrap(), begun: DataFrame | None = None) -> DataFrame:
    """``(pattern, kind, confidence)`` of the patterns that speak for a kind.

    Seeds have score 1 for their kind. A pattern's confidence is the share of what follows it that is believed to be of
    the kind; an instance's belief is that of its best pattern. Both are scored in turn over the graph of distinct
    pattern-instance links, so copies of a text add nothing; instances that are believed induce patterns of their own.
    Of other words that follow a pattern, over all texts, each distinct one counts once too. ``begun`` are the occurrences
    ``(pattern, instance, kind, word)`` of all texts, if they are known already.
    """
    def seen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found: set[tuple] = set()
            for text in batch.column(0).to_pylist():
                found.update((pattern, instance, kind, _word_at(text, start)) for start, _, kind, pattern, instance in occurrences(text, b))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["pattern", "instance", "kind", "word"])

    texts = _texts(docs)
    if begun is None:
        begun = texts.mapInArrow(seen, "pattern long, instance long, kind int, word long")
    begun = staged(begun.distinct(), "begun")
    links = staged(begun.select("pattern", "instance", "kind").distinct(), "links")
    # only patterns before several distinct identifiers can reach the support
    words_begun = begun.select("pattern", "word").distinct()
    counts = links.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= b.support)
    wide = staged(counts.join(words_begun.groupBy("pattern").agg(F.count("*").alias("begun")), "pattern"), "wide")
    # with so many distinct words behind a pattern, even if all its instances are believed they are too small a part of it
    enough = F.col("begun") + F.floor(F.col("instances") * (1 / b.confidence - 1)) + 2
    bits = wide.groupBy(F.col("pattern").bitwiseAND(F.lit((1 << b.sieve_bits) - 1)).cast("int").alias("bit")).agg(F.max(enough).alias("most")).toPandas()
    most = np.zeros(1 << b.sieve_bits, np.int32)
    most[bits["bit"].to_numpy(np.int64)] = bits["most"].to_numpy(np.int64).clip(max=np.iinfo(np.int32).max)

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind = Followers(most, b.context)
        for batch in batches(rows):
            for text in batch.column(0).to_pylist():
                behind.add(text)
                if behind.held > behind.HELD:
                    yield behind.taken()
        yield behind.taken()

    none = "pattern long, kind int, confidence double"
    if not len(bits):
        return docs.sparkSession.createDataFrame([], none)
    # words at which no identifier begins
    others = texts.mapInArrow(counted, "pattern long, word long").distinct().join(words_begun, ["pattern", "word"], "left_anti")
    totals = others.groupBy("pattern").agg(F.count("*").alias("total"))
    size = F.col("instances") + F.coalesce("total", F.lit(0))
    patterns = staged(wide.join(totals, "pattern", "left").select("pattern", size.alias("size")), "patterns")
    graph = staged(links.join(patterns, "pattern", "left_semi").select("pattern", "instance", "kind"), "graph")
    seeds = graph.where("kind >= 0").select("pattern", "instance", "kind", F.lit(1.0).alias("belief"))
    others = graph.where("kind < 0").select("pattern", "instance", F.col("kind").alias("code"))
    scored = seeds
    good = None
    for _ in range(b.rounds):
        strength = scored.groupBy("pattern", "kind").agg(F.sum("belief").alias("strength"), F.count("*").alias("instances"))
        rated = strength.join(patterns, "pattern").select("pattern", "kind", (F.col("strength") / F.col("size")).alias("confidence"), "instances")
        good = staged(rated.where((F.col("confidence") >= b.confidence) & (F.col("instances") >= b.support)).select("pattern", "kind", "confidence"), "good")
        belief = others.join(good, "pattern").where(fits(F.col("code"), F.col("kind"))).groupBy("instance", "kind").agg(F.max("confidence").alias("belief"))
        scored = seeds.unionByName(others.join(belief, "instance").where(fits(F.col("code"), F.col("kind"))).select("pattern", "instance", "kind", "belief"))
    # a pattern speaks for one kind
    best = good.groupBy("pattern").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best"))
    return staged(best.select("pattern", (-F.col("best.k")).cast("int").alias("kind"), F.col("best.confidence").alias("confidence")), "best")


def spans_of(docs: DataFrame, b: Bootstrap = Bootstrap(), row: F.Column | None = None) -> DataFrame:
    """``(doc_id, row, base, found)``: spans ``(kind, start, stop)`` of the fixed forms, and those that patterns add.

    A null or empty text has no spans. Rows are told apart by ``row``, numbered here if not given, so repeated ids do no harm; an empty table gives
    an empty result. Found spans overlap no fixed form.
    """
    number = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
    entry = pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("word", pa.int64()), ("code", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_in):
            base, marks = [], []
            for text in batch.column(2).to_pylist():
                seeds, found = seeds_and_occurrences(text, b)
                base.append([{"kind": k, "start": s, "stop": e} for s, k, e in seeds])
                marks.append([{"pattern": p, "instance": i, "word": _word_at(text, s), "code": k, "start": s, "stop": e} for s, e, k, p, i in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(span)), pa.array(marks, pa.list_(entry))], ["row", "doc_id", "base", "marks"])

    # one pass over the texts finds the fixed forms and the occurrences that patterns are learnt from and applied to
    found = staged(rows.mapInArrow(run, f"row long, doc_id long, base {SPANS}, marks array<struct<pattern:bigint,instance:bigint,word:bigint,code:int,start:int,stop:int>>"), "spans")
    marks = found.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    patterns = confident_patterns(docs, b, marks.select("pattern", "instance", F.col("code").alias("kind"), "word"))
    named = marks.where("code < 0").select("row", "pattern", "code", "start", "stop")
    added = named.join(patterns, "pattern").where(fits(F.col("code"), F.col("kind"))).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop"))).alias("found"))  # within a document
    return found.join(added, "row", "left").select("doc_id", "row", "base", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def joined(spans: str) -> F.Column:
    """``kind:start:end`` by start and kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(docs: DataFrame, b: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, ``n_chars`` (where there is one) counted anew.

    All rows and columns stay (names without dots or backticks); a text without spans stays as it is, null included. Overlapping
    spans make one, named by the first. Repeated rows come out alike; an empty table stays empty.
    """
    spoken = confident_patterns(docs, b)
    if spoken.limit(CARRIED + 1).count() > CARRIED:
        return _redacted_by_join(docs, b)
    kinds = {r["pattern"]: r["kind"] for r in spoken.collect()}  # at most CARRIED rows; more are joined
    at, schema = docs.schema.fieldNames().index("text"), docs.schema

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts = [_masked(t, base_spans(t) + [(s, kinds[p], e) for s, e, k, p, _ in occurrences(t, b) if k < 0 and p in kinds and fits(k, kinds[p])] if kinds else base_spans(t)) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return _counted(docs.mapInArrow(run, schema))


def _redacted_by_join(docs: DataFrame, b: Bootstrap) -> DataFrame:
    """``redacted`` for more patterns than tasks carry: rows get a number that is written with them, and meet their spans by it.

    Null texts, repeated rows, empty tables and other columns are treated as there.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = staged(docs.select(F.monotonically_increasing_id().alias("at"), row, F.col("doc_id"), F.col("text")), "redact")
    spans = spans_of(whole, b, F.col("at")).select(F.col("row").alias("at"), F.concat("base", "found").alias("spans"))
    pairs = whole.select("at", F.col("text").cast("string").alias("text"), "row").join(spans, "at").select("text", "spans", "row")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts = [_masked(t, [(x["start"], x["kind"], x["stop"]) for x in s]) if t else t for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], ["text", "row"])

    plain = pairs.mapInArrow(run, whole.select("text", "row").schema)
    return _counted(plain.select(*[F.col("text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def sha256_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
