"""Exact neighbours, outlier factors, nearest patterns, ranks, quantiles and as-of joins against plain computations."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neighbours, order

XS = ("a", "b", "c")


def plain_factors(x, k):
    """Local outlier factors by the definition, all pairs; ties at the k-th distance go to the smaller values."""
    d2 = np.zeros((len(x), len(x)))
    for axis in range(x.shape[1]):
        gap = x[:, axis, None] - x[None, :, axis]
        d2 += gap * gap
    rank = np.empty(len(x), int)
    rank[np.lexsort(x.T[::-1])] = np.arange(len(x))
    near = []
    for i in range(len(x)):
        others = [j for j in sorted(range(len(x)), key=lambda j: (d2[i, j], rank[j])) if j != i]
        near.append(others[:k])
    reach = np.array([math.sqrt(d2[i, near[i][-1]]) for i in range(len(x))])
    density = np.array([1 / (np.mean([max(reach[j], math.sqrt(d2[i, j])) for j in near[i]]) + 1e-10) for i in range(len(x))])
    return np.array([np.mean(density[near[i]]) / density[i] for i in range(len(x))])


@pytest.mark.parametrize("cell_rows", [8, 256])
def test_outlier_factors_equal_all_pairs(spark, monkeypatch, cell_rows):
    """With many small cells, equal rows, ties, far outliers and rows that lack a value."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(neighbours, "GUESTS", 16)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(150, 3)), rng.integers(0, 3, (60, 3)), np.tile([5.0, 5, 5], (30, 1)), [[90, 0, 0], [0, -70, 3]]]).astype(float)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(1000, None, 0.0, 0.0), (1001, float("nan"), 0.0, 0.0), (1002, float("inf"), 0.0, 0.0)]
    got = neighbours.outlier_factors(spark.createDataFrame(rows, "i int, a double, b double, c double"), XS, (4, 10)).toPandas().set_index("i")
    for k in (4, 10):
        assert np.allclose(got.loc[range(len(x)), f"lof_{k}"], plain_factors(x, k), rtol=1e-9)
        assert got.loc[[1000, 1001, 1002], f"lof_{k}"].isna().all()


def test_few_rows_have_what_neighbours_there_are(spark):
    schema = "a double, b double, c double"
    assert neighbours.outlier_factors(spark.createDataFrame([(1.0, 2.0, 3.0)], schema), XS).first().lof_20 is None
    two = neighbours.outlier_factors(spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 2.0, 3.0)], schema), XS).collect()
    assert [round(r.lof_20, 6) for r in two] == [1.0, 1.0]
    assert neighbours.outlier_factors(spark.createDataFrame([], schema), XS).collect() == []


def test_neighbours_without_all_pairs(spark, monkeypatch):
    """Plans hold no product of the rows with themselves."""
    rows = spark.range(3000).select(*[F.rand(i).alias(x) for i, x in enumerate(XS)])
    plan = neighbours.outlier_factors(rows, XS)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("cell_rows", [8, 256])
def test_nearest_pattern_over_the_whole_history(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(2)
    series = {"A": rng.normal(size=180), "B": np.tile(rng.normal(size=7), 20), "C": rng.normal(size=29), "D": np.zeros(60)}
    day = dt.date(2020, 1, 1)
    rows = [(t, day + dt.timedelta(days=i), None if i == 0 else float(v)) for t, s in series.items() for i, v in enumerate(s)]
    got = {(r.ticker, r.date): r.pattern_similarity_score for r in neighbours.nearest_pattern(spark.createDataFrame(rows, "ticker string, date date, ret_1d double")).collect()}
    assert len(got) == len(rows)
    for ticker, s in series.items():
        s = np.concatenate(([0.0], s[1:]))
        patterns = [s[i - 10 : i] for i in range(10, len(s))]
        for i in range(len(s)):
            p, found = i - 10, got[ticker, day + dt.timedelta(days=i)]
            if p < 20:
                assert found is None
            else:
                assert found == pytest.approx(min(np.linalg.norm(patterns[p] - old) for old in patterns[: p - 5]), abs=1e-9)


def test_ranks_of_a_whole_table(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in np.concatenate([rng.normal(size=500), np.zeros(300), rng.integers(0, 5, 200)])] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.x: (r.rank, r.times) for r in order.average_ranks(rows, "x").collect()}
    held = sorted(v for v in values if v is not None)
    for v in set(held):
        at = [i + 1 for i, w in enumerate(held) if w == v]
        assert got[v] == (sum(at) / len(at), len(at))
    assert "SinglePartition" not in order.average_ranks(rows, "x")._jdf.queryExecution().executedPlan().toString()
    assert order.average_ranks(rows.limit(0), "x").collect() == []


@pytest.mark.parametrize("few", [3, 50, 2000])
def test_exact_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW", few)
    monkeypatch.setattr(order, "ACCURACY", 20)
    rng = np.random.default_rng(4)
    columns = {"a": rng.normal(size=3000), "b": np.where(rng.random(3000) < 0.6, 7.0, rng.lognormal(0, 30, 3000)), "c": np.full(3000, 2.5), "d": np.full(3000, np.nan)}
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values(), strict=True)] + [(None,) * 4, (math.inf, -math.inf, None, None)], "a double, b double, c double, d double")
    shares = (0.0, 0.01, 0.25, 0.5, 0.75, 1.0)
    got = order.exact_quantiles(rows, tuple(columns), shares)
    for c in "abc":
        assert got[c] == pytest.approx(list(np.quantile(columns[c], shares)), rel=1e-12)
    assert got["d"] == [None] * len(shares)


@pytest.mark.parametrize("clip", [False, True])
def test_next_event_by_key(spark, clip):
    rng = np.random.default_rng(5)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=int(n))
    rows = [(t, day(n)) for t in "ABC" for n in rng.integers(0, 400, 60)] + [("A", None), (None, day(3))]
    events = [("A", day(n)) for n in (5, 5, 40, 210, 211)] + [("B", day(399)), ("D", day(1)), (None, day(9)), ("B", None)]
    got = order.next_event(spark.createDataFrame(rows, "k string, on date"), spark.createDataFrame(events, "k string, due date"), "k", "on", "due", clip).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.k is None or r.on is None:
            continue
        mine = sorted(e for k, e in events if k == r.k and e)
        later = [e for e in mine if e >= r.on]
        assert r.due == (later[0] if later else mine[-1] if clip and mine else None)


def shuffled_bytes(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_outlier_factors_shuffle_no_lists_of_neighbours(spark):
    """Some 2 KB a row are shuffled for fifty neighbours, not an entry for each of them and each number of neighbours."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(6000, 3))], "a double, b double, c double")
    before = shuffled_bytes(spark)
    assert neighbours.outlier_factors(rows, XS, (10, 20, 50)).where("lof_10 > 0 AND lof_20 > 0 AND lof_50 > 0").count() == 6000
    taken = (shuffled_bytes(spark) - before) / 6000
    print(f"{taken:.0f} bytes a row")
    assert 100 < taken < 4000


def test_few_rows_in_a_cell_look_at_near_cells_only(spark, monkeypatch):
    """A cell of fewer rows than are wanted takes its bound from the boxes of others, not all rows as guests."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 32)
    rng = np.random.default_rng(7)
    x = np.concatenate([np.repeat(np.arange(40.0), 50) + rng.normal(size=2000) / 100, [100.0, 101.0, 102.0]])
    points = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(np.sort(x))], "id long, n long, a double")
    found = neighbours.neighbourhoods(points, ("a",), 11)
    assert found.where("near IS NOT NULL").count() == len(x) and found.where("near IS NULL").count() < len(x)
