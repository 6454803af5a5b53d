"""Periodic runs against a plain search, and the text that is left."""

import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periods

DOCS = "doc_id long, text string, runs string, length int"


def plain_runs(words):
    """Every stretch with a period, by comparing words at each distance; those whose smallest period it is."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at < len(words) - q:
            if words[at] != words[at + q]:
                at += 1
                continue
            start = at
            while at < len(words) - q and words[at] == words[at + q]:
                at += 1
            run = words[start : at + q]
            if len(run) >= max(6, 4 * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                found.append((start, len(run), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=5))
def test_runs_of_random_words(texts):
    assert periods.runs_of(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=12), st.integers(1, 9), st.lists(st.sampled_from([b"a", b"b"]), max_size=5)), max_size=6))
def test_runs_of_repeated_words(parts):
    text = [w for part, times, more in parts for w in part * times + more]
    assert periods.runs_of([text, text[::-1]]) == [plain_runs(text), plain_runs(text[::-1])]


def test_long_texts_take_little_time_and_nothing_is_cut():
    rng = random.Random(2)
    words = [b"%d" % rng.randrange(3000) for _ in range(100_000)]
    assert periods.runs_of([words, words[:25_000] * 4, words[:50_000] * 2, [b"a"] * 100_000]) == [[], [(0, 100_000, 25_000)], [], [(0, 100_000, 1)]]


def test_collapsed_text_keeps_first_periods():
    words = b"x a b a b a b a b y".split()
    assert periods.runs_of([words]) == [[(1, 8, 2)]]
    assert periods.collapsed(words, [(1, 8, 2)]) == b"x a b y"


def test_planted_tails(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.randrange(50)) for _ in range(rng.randrange(80))), "r", 1) for i in range(200)]
    got = {r.doc_id: r for r in periods.periodic_runs(periods.planted(spark.createDataFrame(rows, DOCS))).collect()}
    for i, text, _, _ in rows:
        words, h = text.encode().split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        want = plain_runs(words)
        assert [tuple(r) for r in got[i].runs] == want
        gone = {k for start, length, period in want for k in range(start + period, start + length)}
        assert got[i].collapsed == b" ".join(w for k, w in enumerate(words) if k not in gone).decode()


def test_awkward_rows(spark):
    rows = [(None, "a a a a a a a", "x", 1), (1, None, None, None), (2, "", "b", 2), (3, "word", "b", 3), (3, "word", "b", 3), (4, "\x0b \t\n", None, 4), (5, "naïve \U0001f600 " * 30000, "c", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    got = periods.periodic_runs(periods.planted(docs)).collect()
    assert sorted((r.doc_id or 0, len(r.runs)) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 0), (3, 0), (4, 0), (5, 1)]
    assert [r.collapsed for r in got if r.doc_id == 5] == ["naïve \U0001f600"]
    assert periods.periodic_runs(periods.planted(docs.limit(0))).collect() == []
