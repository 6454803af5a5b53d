"""How many planted pairs of a cosine from 0.95 to 1 share a bucket, and how many unrelated ones do, at several sizes."""

import numpy as np
import pytest

from tidemark.llm.embed_dups import Hashing, bucket_keys


def planted(n, size, rng):
    a = rng.standard_normal((n, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((n, size))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.95, 1, (n, 1))
    return a, cosine * a + np.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize(("rows", "crowd"), [(10_000, 0.07), (1_000_000, 0.003), (1_000_000_000, 0.0003)])
def test_recall_of_planted_pairs(rows, crowd):
    rng = np.random.default_rng(5)
    h = Hashing.for_rows(rows)
    a, b = planted(10_000, 64, rng)
    met, strangers = [], []
    for i in range(0, 10_000, 1000):
        x, y = bucket_keys(a[i : i + 1000], h), bucket_keys(b[i : i + 1000], h)
        met.append((x == y).any(axis=1))
        strangers.append((x == np.roll(y, 1, axis=0)).any(axis=1))
    recall, chance = np.mean(met), np.mean(strangers)
    print(f"{rows} rows, {h.projections} projections, {h.tables} tables: recall {recall:.4f}, unrelated pairs that meet {chance:.5f}")
    assert recall >= 0.998 and chance <= crowd
