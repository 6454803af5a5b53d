"""License scan over a positional index of rare licence words, in DataFrame functions alone."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import staged

#: A word of a licence: digits, letters and whatever is beyond ASCII, after A-Z are lower-cased.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rarest words of a template's key phrases whose postings are intersected.
RARE = 2


@dataclass(frozen=True)
class Template:
    """A licence text, its label, and the phrases that must stand in it at their places; other words may differ."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(re.findall(LICENSE_WORD, self.text.translate(str.maketrans(UPPER, LOWER))))

    @property
    def fixed(self) -> tuple[tuple[int, str], ...]:
        """``(place, word)`` of the key phrases' words; all words of a template without key phrases."""
        words, held = self.words, set()
        for key in self.keys:
            want = tuple(re.findall(LICENSE_WORD, key))
            at = next(i for i in range(len(words)) if words[i : i + len(want)] == want)
            held.update(range(at, at + len(want)))
        return tuple((i, words[i]) for i in sorted(held or range(len(words))))


# Phrases of public licences.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsd", "licensed under the bsd license", ("bsd license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying",)),
)


def coded(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """``doc_id``, the number of words, and each word's number in the licence vocabulary, 0 for all other words."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    known = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    words = F.regexp_extract_all(text, F.lit(LICENSE_WORD), F.lit(0))
    codes = F.transform(words, lambda w: F.when(w.isin(*numbers), known[w]).otherwise(F.lit(0)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), codes.alias("codes")).withColumn("n_words", F.size("codes").cast("long"))


def inverse_frequencies(rows: DataFrame, numbers: dict[str, int]) -> dict[int, float]:
    """IDF of each vocabulary word over all rows. What comes to the driver is a row for each word of the templates."""
    seen = rows.select(F.explode(F.array_distinct(F.filter("codes", lambda c: c > 0))).alias("code")).groupBy("code").count()
    counts = {r["code"]: r["count"] for r in seen.collect()}  # len(numbers) rows at most
    return {c: -float(counts.get(c, 0)) for c in numbers.values()}


def _postings(code: int, place: int) -> Column:
    """Where a template would start by each of a file's occurrences of one of its words."""
    return F.transform(F.filter("hits", lambda h: h["code"] == code), lambda h: h["at"] - place)


def _starts(template: Template, numbers: dict[str, int], idf: dict[int, float]) -> Column:
    """Places where the template stands: postings of its rarest words agree on them and all key words are there."""
    rare: list[tuple[int, int]] = []
    for place, word in sorted(template.fixed, key=lambda x: (-idf[numbers[x[1]]], x[0])):
        if numbers[word] not in {c for c, _ in rare}:
            rare.append((numbers[word], place))
    postings = [_postings(code, place) for code, place in rare[:RARE]]
    found = F.array_distinct(postings[0])
    for other in postings[1:]:
        found = F.array_intersect(found, other)
    key = F.lit(True)

    def stands(start: Column) -> Column:
        held = key
        for place, word in template.fixed:
            held &= F.coalesce(F.get(F.col("codes"), start + place), F.lit(0)) == numbers[word]
        return held

    return F.filter(found, stands)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Licences of every row of ``docs(doc_id, text)``, on their own but for the words' frequencies.

    ``places`` lists ``(label, base, start, share)``: where a template stands, ``share`` being the part of its words
    that are at their places. ``n_base, first_word, last_word`` count the base phrases' places and give their smallest
    and largest start; ``base_labels`` and ``labels`` are distinct, sorted and comma-joined; ``score`` is the largest
    share, 0 without places. The rarest words only find the places: which words are rare doesn't change the result.
    A null text is empty: no words, no labels (empty strings), null places. Repeated rows come out alike; other columns
    are left out; an empty table gives an empty result.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    numbers = {w: i + 1 for i, w in enumerate(vocabulary)}
    rows = staged(coded(docs, numbers), "codes")
    idf = inverse_frequencies(rows, numbers)
    looked_up = set()
    for t in templates:
        order = sorted({numbers[w] for _, w in t.fixed}, key=lambda c: (-idf[c], min(p for p, w in t.fixed if numbers[w] == c)))
        looked_up.update(order[:RARE])
    hits = F.filter(F.transform("codes", lambda c, i: F.when(c.isin(*looked_up), F.struct(i.alias("at"), c.alias("code")))), lambda h: h.isNotNull())
    rows = rows.select("doc_id", "n_words", "codes", hits.alias("hits"))

    def placed(t: Template) -> Column:
        def share(start: Column) -> Column:
            there = F.lit(0)
            for place, word in enumerate(t.words):
                there = there + F.when(F.coalesce(F.get(F.col("codes"), start + place), F.lit(0)) == numbers[word], 1).otherwise(0)
            return there / F.lit(float(len(t.words)))

        return F.transform(_starts(t, numbers, idf), lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.cast("long").alias("start"), share(s).alias("share")))

    kind = "array<struct<label:string,base:boolean,start:bigint,share:double>>"
    places = F.when(F.size("hits") > 0, F.concat(*[placed(t) for t in templates])).otherwise(F.array().cast(kind))
    rows = rows.select("doc_id", "n_words", places.alias("places"))
    base = F.filter("places", lambda p: p["base"])
    joined = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["label"]))), ",")
    rows = rows.select("doc_id", "n_words", "places", base.alias("held"))
    return rows.select(
        "doc_id", "n_words", F.size("held").cast("long").alias("n_base"),
        F.array_min(F.transform("held", lambda p: p["start"])).alias("first_word"), F.array_max(F.transform("held", lambda p: p["start"])).alias("last_word"),
        joined(F.col("held")).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"), "places",
    )
