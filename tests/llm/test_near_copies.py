"""The pipeline's near copies against all pairs of shingle sets."""

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import near_copies

RNG = np.random.default_rng(4)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(4000)]


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def changed(words, places):
    return " ".join("x" + str(i) if i in places else w for i, w in enumerate(words))


@pytest.mark.parametrize("share", [2048, 16])
def test_near_copies_of_five_word_shingles(spark, monkeypatch, share):
    monkeypatch.setattr(near_copies, "BUCKET_ROWS", share)
    texts = []
    for i in range(12):
        words = RNG.choice(VOCABULARY, 200).tolist()
        texts += [" ".join(words), changed(words, {20, 90, 150}), changed(words, {20, 60, 90, 120, 150, 180}), changed(words, range(0, 200, 10))]
    hot = RNG.choice(VOCABULARY, 120).tolist()
    texts += [changed(hot, {int(i)}) for i in RNG.integers(0, 120, 80)] + ["one", "ONE", "", None]
    sets = [plain(t) for t in texts]
    near = np.array([[x == y or len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets])
    label = np.arange(len(texts))
    for _ in range(len(texts)):
        label = np.where(near, label[None], len(texts)).min(axis=1)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.tolist())) and kept.columns == docs.columns
    assert near_copies.near_dedup(docs.limit(0)).collect() == []
