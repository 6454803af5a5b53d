"""Forests, boundaries, linear folds and contributions against plain walks and solvers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detectors, training

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(590, 3)), rng.normal(0, 6, (10, 3))])
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double").cache()


def test_forest_scores_equal_plain_walks(cloud):
    x, rows = cloud
    forest = detectors.isolation_forest(rows, NAMES, trees=30, drawn=64)
    again = detectors.isolation_forest(rows.repartition(5), NAMES, trees=30, drawn=64)
    assert (forest.trees.axis == again.trees.axis).all() and (forest.trees.cut == again.trees.cut).all()
    got = {r.i: r.isolation for r in forest.scored(rows).collect()}
    for i, values in enumerate(x):
        row = dict(zip(NAMES, values, strict=True))
        depth = sum(forest.depth[at] for at in forest.trees.plain_ends(row.get)) / 30
        assert got[i] == pytest.approx(-(2 ** (-depth / detectors.mean_depth(64))), rel=1e-12)
    assert np.mean([got[i] for i in range(590, 600)]) < np.mean([got[i] for i in range(590)]) - 0.1


def test_forest_trees_follow_from_chance_and_extremes(cloud):
    """Every cut lies where its chance says between the extremes of the rows that reach it, and ends hold what is left."""
    forest = detectors.isolation_forest(cloud[1], NAMES, trees=5, drawn=32)
    t = forest.trees
    assert t.levels == 5
    for tree in range(5):
        first = t.axis[tree * t.width + 1]
        assert first == math.floor(detectors.plain_chance(42, tree, 1, "axis") * 3)
        sizes = sum(2.0 ** -int(math.log2(at)) for at in range(1, t.width) if forest.depth[tree * t.width + at] > 0 and t.axis[tree * t.width + at] < 0)
        assert sizes == pytest.approx(1.0)  # the ends of a tree cover it once


def test_forest_of_odd_rows(spark):
    schema = "a double, b double, c double"
    same = detectors.isolation_scores(spark.createDataFrame([(1.0, 1.0, 1.0)] * 5 + [(None, 1.0, 1.0)], schema), NAMES, (0.5,), trees=3).collect()
    assert len({r.isolation for r in same if r.a}) == 1 and [r.isolation for r in same if r.a is None] == [None]
    assert detectors.isolation_scores(spark.createDataFrame([], schema), NAMES, (0.5,), trees=3).collect() == []


def pairwise_solver(z, nu, rounds=60_000):
    """Half the squared norm of a convex mix of rows, no share above 1 / (nu n), by steps along the most violating pair."""
    n = len(z)
    most = 1 / (nu * n)
    alpha = np.zeros(n)
    alpha[: int(nu * n)] = most
    alpha[int(nu * n)] = 1 - alpha.sum()
    kernel = z @ z.T
    slope = kernel @ alpha
    for _ in range(rounds):
        up = np.where(alpha < most - 1e-15, slope, np.inf).argmin()
        down = np.where(alpha > 1e-15, slope, -np.inf).argmax()
        if slope[down] - slope[up] < 1e-9:
            break
        step = min((slope[down] - slope[up]) / max(kernel[up, up] + kernel[down, down] - 2 * kernel[up, down], 1e-12), alpha[down], most - alpha[up])
        alpha[up] += step
        alpha[down] -= step
        slope += step * (kernel[up] - kernel[down])
    return -(alpha @ kernel @ alpha) / 2


@pytest.mark.parametrize("nu", [0.05, 0.2])
def test_boundary_is_as_good_as_a_dense_solver(cloud, nu):
    x, rows = cloud
    found = detectors.one_class_boundary(rows, NAMES, nu)
    z = math.sqrt(2 / len(found.phases)) * np.cos(x @ found.waves.T + found.phases)
    best = pairwise_solver(z, nu)
    gap = found.offset - z @ found.weights
    value = found.weights @ found.weights / 2 - found.offset + np.maximum(gap, 0).sum() / (nu * len(x))
    assert value == pytest.approx(found.objective, rel=1e-6) and best <= value <= best + 0.01 * abs(best)
    got = detectors.boundary_scores(rows, NAMES, nu).orderBy("i").toPandas()
    assert np.allclose(got.boundary, z @ found.weights - found.offset, atol=1e-9)
    assert abs(got.outside.mean() - nu) < 0.03


def test_walk_forward_equals_plain_folds(spark):
    rng = np.random.default_rng(9)
    days, tickers = 420, 12
    x = rng.normal(size=(days, tickers, 2)) * [1.0, 30.0]
    y = 0.2 * x[:, :, 0] - 0.004 * x[:, :, 1] + rng.normal(size=(days, tickers))
    day = lambda d: dt.date(2020, 1, 1) + dt.timedelta(days=d)
    rows = [(f"t{t:02}", day(d), float(y[d, t]), *map(float, x[d, t])) for d in range(days) for t in range(tickers)]
    got = {(r.ticker, r.date): (r.fold, r.p) for r in training.walk_forward_ensemble(spark.createDataFrame(rows, "ticker string, date date, y double, u double, v double"), ("u", "v"), "y", folds=6, purge=3, least=100).collect()}
    length, seen = days // 8, 0
    for fold in range(6):
        end = days - (6 - fold) * length
        if end < 100:
            continue
        ranks = []
        for q in training.TAILS:
            low, high = np.quantile(y[: end - 3], q, axis=1)[:, None], np.quantile(y[: end - 3], 1 - q, axis=1)[:, None]
            held = (y[: end - 3] <= low) | (y[: end - 3] >= high)
            z, label = x[: end - 3][held], (y[: end - 3] >= high)[held].astype(float)
            mean, sd = z.mean(axis=0), z.std(axis=0, ddof=1)
            design = np.column_stack([np.ones(len(z)), (z - mean) / sd])
            w, ridge = np.zeros(3), np.array([0, 0.1, 0.1])
            for _ in range(30):
                p = 1 / (1 + np.exp(-design @ w))
                w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) / len(z) + np.diag(ridge), design.T @ (p - label) / len(z) + ridge * w)
            m = ((x[end : end + length] - mean) / sd) @ w[1:]
            ranks.append((m.argsort(axis=1).argsort(axis=1) + 1) / tickers)
        for d in range(length):
            for t in range(tickers):
                assert got[f"t{t:02}", day(end + d)] == (fold, pytest.approx((ranks[0][d, t] + ranks[1][d, t]) / 2, abs=1e-9))
                seen += 1
    assert seen == len(got)


def test_parts_add_up_to_the_margin(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(800, 3))
    label = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=800)) > 0).astype(int)
    rows = spark.createDataFrame([(*map(float, r), int(v), None if v and i % 7 == 0 else int(v)) for i, (r, v) in enumerate(zip(x, label, strict=True))], "a double, b double, c double, l int, m int")
    models = training.fitted_trees(rows, NAMES, ("l", "m"), (1, 2), maxIter=4)
    assert len(models) == 4
    attribution = training.Attribution(models, NAMES)
    got = attribution.explained(rows).select("*", sum((F.col(f"part_{n}") for n in NAMES), F.lit(attribution.base)).alias("whole")).collect()
    theirs = training.mean_margin(models, rows, NAMES).collect()
    key = lambda r: (r.a, r.b, r.c)
    for g, t in zip(sorted(got, key=key), sorted(theirs, key=key), strict=True):
        assert g.margin == pytest.approx(t.margin, abs=1e-9) and g.whole == pytest.approx(g.margin, abs=1e-9)
    parts = {n: np.mean([abs(r[f"part_{n}"]) for r in got]) for n in NAMES}
    assert parts["a"] == max(parts.values()) and training.important_features(models, NAMES)[0] == "a"
