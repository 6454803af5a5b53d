"""Operators on small fixtures: drawdowns, folds, weights, streams of quotes, parsing and neutral scores."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import books, cleaning, labels, trend, validation
from tidemark.streaming import quotes

DAY = dt.date(2021, 1, 4)


def panel_of(spark, paths, **more):
    """Rows (ticker, date, close, xs_rank) of price paths by ticker, all at the top rank."""
    rows = [(t, DAY + dt.timedelta(days=i), float(p), more.get("rank", 1.0)) for t, path in paths.items() for i, p in enumerate(path)]
    return books.on_sessions(spark.createDataFrame(rows, "ticker string, date date, close double, xs_rank double"))


def drawdown(spark, paths, hold):
    x = panel_of(spark, paths)
    on = books.held(books.on_grid(books.equal_weights(x, F.col("xs_rank") >= 0.9), hold), hold)
    days = books.daily_returns(on, x).withColumn("book", F.lit("b"))
    equity = np.concatenate(([1.0], np.cumprod([1 + r.ret for r in days.orderBy("i").collect()])))
    return float((equity / np.maximum.accumulate(equity) - 1).min()), books.summary(days, F.lit(0.0)).first()


@pytest.mark.parametrize(
    ("paths", "hold", "fall"),
    [({"A": [100, 95, 85, 75, 65, 60, 70, 80, 90, 100, 100]}, 10, -0.4), ({"A": [100, 95, 90, 85, 80, 75]}, 5, -0.25), ({"A": [100] * 6}, 5, 0.0), ({"A": [100, 60, 60, 60, 60, 100, 100], "B": [100] * 7}, 6, -0.2)],
)
def test_drawdown_of_daily_paths(spark, paths, hold, fall):
    found, row = drawdown(spark, paths, hold)
    assert abs(found - fall) < 0.02 and row.n_days == len(next(iter(paths.values())))


def test_nothing_selected_earns_nothing(spark):
    x = panel_of(spark, {"A": [100, 101, 102]}, rank=0.5)
    days = books.daily_returns(books.held(books.equal_weights(x, F.col("xs_rank") >= 0.9), 2), x)
    assert [r.ret for r in days.collect()] == [0.0] * 3


def test_folds_are_disjoint_and_purged(spark):
    rows = spark.range(2000).select(F.lit("A").alias("ticker"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"))
    found = labels.walk_forward(rows, 6, 3).groupBy("fold").pivot("role", ["train", "test"]).agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("fold").collect()
    assert len(found) == 6
    for r in found:
        assert r.test_n == 250 and (r.test_lo - r.train_hi).days == 4
    assert all(a.test_hi < b.test_lo for a, b in zip(found, found[1:], strict=False))


def test_uniqueness_weights(spark):
    rows = spark.range(6).select(F.lit("A").alias("ticker"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"))
    got = [r.uniqueness for r in labels.uniqueness_weights(rows, 3).orderBy("date").collect()]
    opened = np.array([1, 2, 3, 4, 4, 4])
    assert np.allclose(got, [1 / opened[i : i + 4].mean() for i in range(6)])
    assert [r.uniqueness for r in labels.uniqueness_weights(rows, 0).collect()] == [1.0] * 6


def test_neutral_scores_are_least_squares_residuals(spark):
    rng = np.random.default_rng(4)
    n = 300
    beta, sector = rng.uniform(0.5, 1.5, n), rng.choice(list("ABC"), n)
    score = 0.3 * beta + (sector == "B") * 0.2 + rng.normal(0, 0.1, n)
    rows = spark.createDataFrame([(str(i), DAY, s, float(b), float(y)) for i, (s, b, y) in enumerate(zip(sector, beta, score, strict=True))] + [("none", DAY, "A", None, 0.5)], "ticker string, date date, sector string, beta double, score double")
    got = {r.ticker: r.neutral for r in labels.neutralise(rows, labels.neutralise_fit(rows, "score", "beta"), "score", "beta").collect()}
    design = np.column_stack([beta, *(sector == s for s in "ABC")]).astype(float)
    want = score - design @ np.linalg.lstsq(design, score, rcond=None)[0]
    assert np.allclose([got[str(i)] for i in range(n)], want, atol=1e-9) and got["none"] == 0.5


def test_expected_best_of_normals():
    for n, want in ((1, 0.0), (10, 1.539), (20, 1.867), (50, 2.249), (100, 2.508)):
        assert abs(validation.expected_best(n) - want) < 0.002


def test_smoothing_over_several_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(1, 9, 3 * trend.BLOCK + 17)
    rows = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "ticker string, k int, x double")
    got = [(r.a, r.b) for r in trend.smoothed(rows, {"a": ("x", 2 / 27, 0), "b": ("x", 0.5, 1)}).orderBy("k").collect()]
    slow, fast = x[0], None
    for i, v in enumerate(x):
        slow = slow + (v - slow) * 2 / 27 if i else v
        fast = None if not i else v if i == 1 else fast + (v - fast) / 2
        assert abs(got[i][0] - slow) < 1e-9 and (got[i][1] is None if fast is None else abs(got[i][1] - fast) < 1e-9)


def test_numbers_in_dirty_strings(spark):
    rows = spark.createDataFrame([(" 12 ",), ("-",), (" - ",), ("",), ("x",), (None,), ("1e3",)], "t string")
    assert [r.n for r in rows.select(cleaning.number(F.col("t")).alias("n")).collect()] == [12.0, None, None, None, None, None, 1000.0]


def test_class_weights_without_labels(spark):
    rows = spark.createDataFrame([], "target int")
    assert [r.weight for r in validation.class_weights(rows, "target").collect()] == [1.0] * 5


def test_quotes_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 9)
    rows = [(f"T{i % 7}", at + dt.timedelta(minutes=i * 13 % 101), i, float(i)) for i in range(60)]
    table = spark.createDataFrame(rows, "ticker string, ts timestamp, quote_id long, price double")
    closes = spark.createDataFrame([(f"T{i}", 10.0 * i) for i in range(6)], "ticker string, prior double")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = quotes.with_change(quotes.latest_quotes(stream), closes).writeStream.format("memory").queryName("quotes").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = quotes.with_change(quotes.latest_quotes(table), closes)
    assert sorted(map(str, spark.table("quotes").collect())) == sorted(map(str, want.collect()))
    newest = quotes.freshness(want, F.lit(at + dt.timedelta(minutes=100)), 5)
    assert 0 < newest.where("live").count() < 7


def test_only_new_dates_run(spark):
    seen = []
    each = quotes.on_new_date(lambda rows: seen.append(rows.count()))
    for days in ([1, 2, 2], [2], [3]):
        each(spark.createDataFrame([(DAY + dt.timedelta(days=d),) for d in days], "date date"), 0)
    assert seen == [2, 1]
