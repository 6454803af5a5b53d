"""Reconstruction errors against singular vectors in numpy, and importances by exchanged columns against plain walks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detectors, reconstruction

NAMES = ("a", "b", "c", "d")


def cloud():
    rng = np.random.default_rng(21)
    inner = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 4)) + rng.normal(0, 0.05, (400, 4))
    return np.vstack([inner, rng.normal(0, 3, (12, 4))])


def table(spark, x):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(len(x), 1.0, None, 0.0, 0.0), (len(x) + 1, 1.0, float("nan"), 0.0, 0.0)]
    return spark.createDataFrame(rows, "i int, a double, b double, c double, d double").repartition(5)


@pytest.mark.parametrize("axes", [1, 2, 4])
def test_errors_equal_those_of_singular_vectors(spark, axes):
    x = cloud()
    got = {r.i: r for r in reconstruction.reconstruction_scores(table(spark, x), NAMES, axes).collect()}
    length = np.linalg.norm(x, axis=1)
    held = length <= np.quantile(length, 0.9)
    mean = x[held].mean(axis=0)
    v = np.linalg.svd(x[held] - mean, full_matrices=False)[2][:axes]
    miss = ((x - mean) - (x - mean) @ v.T @ v) ** 2
    error = miss.mean(axis=1)
    for i in range(len(x)):
        assert got[i].rebuilt_error == pytest.approx(error[i], abs=1e-10)
        assert [got[i][f"error_{n}"] for n in NAMES] == pytest.approx(miss[i], abs=1e-10)
        for s in (2, 3):
            cut = error[held].mean() + s * error[held].std()
            if abs(error[i] - cut) > 1e-9:
                assert got[i][f"flag_{s}sigma"] == int(error[i] > cut)
    assert got[len(x)].rebuilt_error is None and got[len(x)].flag_2sigma is None and got[len(x) + 1].rebuilt_error is None
    if axes == 2:
        assert np.mean([got[i].flag_3sigma for i in range(400, 412)]) > 0.8 > 0.2 > np.mean([got[i].flag_3sigma for i in range(400)])


def test_empty_tables_have_no_flags(spark):
    found = reconstruction.reconstruction_scores(table(spark, cloud()).limit(0), NAMES, 2)
    assert found.count() == 0 and {"flag_2sigma", "error_a", "rebuilt_error"} <= set(found.columns)


def test_exchange_gives_each_row_away_once(spark, monkeypatch):
    monkeypatch.setattr(reconstruction, "GROUP_ROWS", 50)
    rows = table(spark, cloud()).where("b is not null and not isnan(b)")
    got = reconstruction.exchanged(rows, NAMES, ("i",), 1).toPandas()
    own, other = got[list(NAMES)].to_numpy(), got[[f"other_{n}" for n in NAMES]].to_numpy()
    assert sorted(map(tuple, own)) == sorted(map(tuple, other)) and (own != other).any(axis=1).mean() > 0.9
    again = reconstruction.exchanged(rows.repartition(3), NAMES, ("i",), 1).toPandas()
    assert dict(zip(got.i, got.other_a)) == dict(zip(again.i, again.other_a))


def test_importance_against_plain_walks(spark):
    x = cloud()
    x[:, 3] = 1.0  # a column without a say
    rows = table(spark, x)
    forest = detectors.isolation_forest(rows.where("b is not null"), NAMES, trees=20, drawn=64)
    expected = detectors.mean_depth(64)

    def plain(values):
        row = dict(zip(NAMES, values, strict=True))
        return -(2 ** (-sum(forest.depth[at] for at in forest.trees.plain_ends(row.get)) / 20 / expected))

    base = np.array([plain(v) for v in x])
    cut = float(np.quantile(base, 0.1))
    got = {r.feature: r for r in reconstruction.importance(rows, NAMES, ("i",), forest.scored, "isolation", cut, 2).collect()}
    changed = {n: [] for n in NAMES}
    for r in range(2):
        other = reconstruction.exchanged(rows.where(reconstruction.whole(NAMES)).select("i", *NAMES), NAMES, ("i",), r).toPandas()
        for j, n in enumerate(NAMES):
            mixed = other[list(NAMES)].to_numpy().copy()
            before = np.array([plain(v) for v in mixed])
            mixed[:, j] = other[f"other_{n}"]
            changed[n].append(np.mean((np.array([plain(v) for v in mixed]) < cut) != (before < cut)))
    assert set(got) == set(NAMES) and got["d"].importance_mean == got["d"].mean_shift == 0
    for n in NAMES:
        assert got[n].importance_mean == pytest.approx(np.mean(changed[n]), abs=1e-9)
        assert got[n].importance_std == pytest.approx(np.std(changed[n]), abs=1e-9)
    assert min(got[n].mean_shift for n in "abc") > 0
