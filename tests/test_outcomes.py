"""Outcomes of scores, significance by group, books followed by session and pooled neutral scores against plain arithmetic."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import books, labels, outcomes

DAY = dt.date(2020, 1, 1)


def test_outcomes_spread_and_excess(spark):
    rows = [(DAY, "a", 10, 0.04, None), (DAY, "b", 1, -0.02, 0.1), (DAY, "c", None, 0.01, 0.3), (DAY, "d", 10, 0.01, None)]
    rows = spark.createDataFrame(rows, "date date, ticker string, score int, fwd_1d double, fwd_5d double")
    long = outcomes.outcomes(rows, (1, 5)).cache()
    assert {(r.ticker, r.hold): round(r.excess, 9) for r in long.collect()} == {("a", 1): 0.03, ("b", 1): -0.03, ("c", 1): 0.0, ("d", 1): 0.0, ("b", 5): -0.1, ("c", 5): 0.1}
    (found,) = outcomes.spread(long).collect()  # no top score has an outcome after five days
    assert (found.hold, found.top_n, found.bottom_n) == (1, 2, 1) and found.spread == pytest.approx(0.045)
    assert sorted((r.hold, r.score, r.n) for r in outcomes.by_score(long).collect()) == [(1, 1, 1), (1, 10, 2), (5, 1, 1)]
    assert outcomes.spread(long.limit(0)).count() == outcomes.by_score(long.limit(0)).count() == 0


def test_significance_by_group(spark):
    rng = np.random.default_rng(3)
    series = {1: rng.normal(0.1, 1, 40), 4: np.cumsum(rng.normal(0, 1, 25)), 9: rng.normal(size=4)}
    rows = [(g, DAY + dt.timedelta(i), float(v)) for g, xs in series.items() for i, v in enumerate(xs)] + [(1, DAY - dt.timedelta(1), None)]
    rows = spark.createDataFrame(rows, "g int, date date, x double").repartition(3)
    got = {r.g: r for r in outcomes.significance(rows, "x", ("g",), F.greatest(F.col("g") - 1, F.lit(1)), 8).collect()}
    assert set(got) == {1, 4}  # a group of four is too few
    for g, r in got.items():
        x, lag = series[g], max(g - 1, 1)
        e = x - x.mean()
        total = e @ e + sum(2 * (1 - k / (lag + 1)) * (e[k:] @ e[:-k]) for k in range(1, lag + 1))
        assert r.n == len(x) and r.t == pytest.approx(x.mean() / np.sqrt(max(total / len(x), 1e-16) / len(x)))
        assert r.naive_t == pytest.approx(x.mean() / (x.std(ddof=1) + 1e-12) * np.sqrt(len(x)))


def followed_plainly(close, ranks, hold, entries):
    """Weights session by session, each entry overwriting what follows it."""
    n = len(close)
    weights = np.zeros((n, close.shape[1]))
    for i in entries:
        chosen = ranks[i] >= 0.9
        if chosen.any():
            weights[i : i + hold] = np.where(chosen, 1 / chosen.sum(), 0)
    moves = np.vstack([close[1:] / close[:-1] - 1, np.zeros(close.shape[1])])
    level = np.concatenate([[1], np.cumprod(1 + (weights * moves).sum(axis=1))])
    return np.log(level[-1]), (level / np.maximum.accumulate(level) - 1).min()


def test_later_entries_take_the_book_over(spark):
    rng = np.random.default_rng(11)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, (40, 4)), axis=0))
    ranks = rng.choice([0.2, 0.5, 1.0], (40, 4))
    ranks[[6, 12, 21]] = 0.1  # entries without picks
    rows = [(f"t{j}", DAY + dt.timedelta(i), i, float(close[i, j]), float(ranks[i, j])) for i in range(40) for j in range(4)]
    x = spark.createDataFrame(rows, "ticker string, date date, i int, close double, xs_rank double").cache()
    plan = {(5, 5): range(0, 40, 5), (5, 3): range(0, 40, 3), (2, 6): range(0, 40, 6)}
    entries = spark.createDataFrame([(h, e, i) for (h, e), at in plan.items() for i in at], "hold int, every int, i int")
    on = outcomes.latest_entries(x, books.equal_weights(x, F.col("xs_rank") >= 0.9), entries)
    got = {(r.hold, r.every): r for r in outcomes.followed(books.daily_returns(on, x, ("hold", "every")), ("hold", "every")).collect()}
    assert set(got) == set(plan)
    for (hold, every), at in plan.items():
        growth, fall = followed_plainly(close, ranks, hold, at)
        assert got[hold, every].log_growth == pytest.approx(growth) and got[hold, every].max_drawdown == pytest.approx(fall)


def test_fall_within_a_hold_counts(spark):
    """A book that falls by a quarter and recovers before it ends shows the fall."""
    path = [100, 90, 75, 90, 105]
    days = [("b", i, path[i + 1] / path[i] - 1) for i in range(4)]
    (found,) = outcomes.followed(spark.createDataFrame(days, "book string, i int, ret double"), ("book",)).collect()
    assert found.max_drawdown == pytest.approx(-0.25) and found.log_growth == pytest.approx(np.log(1.05)) and found.n_moved == 4


def test_pooled_neutral_against_least_squares(spark):
    rng = np.random.default_rng(5)
    n = 60
    sector, beta = rng.integers(0, 3, n), rng.normal(1, 0.3, n)
    score = 0.4 * beta + 0.1 * sector + rng.normal(0, 0.1, n)
    rows = [(0, DAY + dt.timedelta(i % 4), f"t{i}", f"s{sector[i]}", float(beta[i]), float(score[i])) for i in range(n)]
    rows.append((0, DAY, "new", "unseen", 1.0, 0.5))
    x = spark.createDataFrame(rows, "fold int, date date, ticker string, sector string, beta double, score double").cache()
    fit = labels.neutralise_fit(x.where("ticker <> 'new'"), "score", "beta", "fold")
    got = {r.ticker: r.neutral for r in outcomes.pooled_neutral(x, fit, "score", "beta", "fold").collect()}
    a = np.column_stack([np.ones(n), beta, sector == 1, sector == 2]).astype(float)
    rest = score - a @ np.linalg.lstsq(a, score, rcond=None)[0]
    for d in range(4):
        names = [f"t{i}" for i in range(d, n, 4)] + (["new"] if d == 0 else [])
        values = np.append(rest[d::4], [0.5] if d == 0 else [])  # a sector that the fit hasn't met keeps its score
        for name, v in zip(names, values, strict=True):
            assert got[name] == pytest.approx((values <= v).sum() / len(values))
