"""Pattern keys, and the confidence of patterns against a brute force over all words that follow them."""

from collections import defaultdict

import numpy as np

from tidemark.llm import pii

RNG = np.random.default_rng(9)
WORDS = ["".join(RNG.choice(list("abcdefghijkl"), 5)) for _ in range(60)]


def test_keys_of_a_text_equal_those_of_its_words():
    text = "Call me: (now) at 12:30,  or call me: later \x0b at 45:10"
    words = text.encode().split()
    codes = pii.Codes()
    found = pii._keys(np.array([codes[w] for w in words], np.uint64), 2).tolist()
    assert found == [pii._key([w.decode() for w in words[i : i + 2]]) for i in range(len(words) - 2)]
    assert pii._keys(np.zeros(1, np.uint64), 2).tolist() == []


def test_confident_patterns_against_all_followers(spark):
    texts = []
    for i in range(60):
        body = " ".join(RNG.choice(WORDS, 30))
        texts.append(f"{body} reach me jo{i}@mail.example.com {body} his card 4{i:03d} is {WORDS[i % 60]} of the 10.0.0.{i} of the {WORDS[(i * 7) % 60]}")
        texts.append(f"line tel +1 555 01{i:02d} 777 or tel {WORDS[i % 8]} and ref no 10.1.1.{i}")
    b = pii.Bootstrap(rounds=1)
    seeds, words, begun = defaultdict(set), defaultdict(set), defaultdict(set)
    instances = defaultdict(set)
    for t in texts:
        for start, _, kind, pattern, instance in pii.occurrences(t, b):
            instances[pattern].add((instance, kind))
            begun[pattern].add(pii._word_at(t, start))
            if kind >= 0:
                seeds[pattern, kind].add(instance)
        parts = t.split()
        for i in range(2, len(parts)):
            words[pii._key(parts[i - 2 : i])].add(pii._hash(parts[i]))
    want = {}
    for (pattern, kind), found in seeds.items():
        share = len(found) / (len(instances[pattern]) + len(words[pattern] - begun[pattern]))
        if len(found) >= b.support and share >= b.confidence and share > want.get(pattern, (0, 0))[1]:
            want[pattern] = (kind, share)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.pattern: (r.kind, r.confidence) for r in pii.confident_patterns(docs, b).collect()}
    assert {p: k for p, (k, _) in got.items()} == {p: k for p, (k, _) in want.items()} and want
    assert all(abs(got[p][1] - want[p][1]) < 1e-9 for p in want)


def test_followers_stop_where_the_pattern_is_settled():
    key = pii._key(["of", "the"])
    most = np.zeros(1 << 20, np.int32)
    most[key & ((1 << 20) - 1)] = 5
    behind = pii.Followers(most, 2)
    for w in WORDS:
        behind.add(f"of the {w}")
    assert behind.taken().num_rows == 5 and behind.held == 0


def test_one_look_at_a_text_gives_fixed_forms_and_occurrences():
    from tidemark.llm import pii

    b = pii.Bootstrap()
    for text in ("", "plain words only", "mail to a.b@c.org or +49 30 1234567 now", "his number is 7712345 and 4111 1111 1111 1111 here", "host 10.0.0.7 or x [at] y.org"):
        assert pii.seeds_and_occurrences(text, b) == (pii.base_spans(text), pii.occurrences(text, b))
