"""Texts of reasons, meta-labels and comparisons of configurations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import reasons, training


def said(spark, values):
    rows = spark.createDataFrame([(n, float(v)) for n, v in values], "name string, v double")
    names = tuple(dict.fromkeys(n for n, _ in values))
    return [r[0] for r in rows.select(reasons.feature_text(names, F.col("name"), F.col("v"))).collect()]


def test_formats(spark):
    values = [
        ("rsi_14", 63.4), ("momentum_12_1", 0.1234), ("reversal_5d", 0.021), ("amihud_illiq", 0.001234), ("amihud_illiq", 12.345), ("amihud_illiq", 0.0000123456), ("amihud_illiq", 0.5), ("is_expiry_week", 1), ("is_expiry_week", 0),
        ("day_of_week", 4), ("month", 12), ("xs_rank_delivery_pct", 0.87), ("xs_z_vol_20d", -1.26), ("di_minus_14", 18.2), ("my_own", 0.00345), ("my_own", 0), ("my_own", 0.5), ("my_own", 12.34), ("my_own", 123456.7), ("xs_rank_my_own", 0.5),
    ]
    assert said(spark, values) == [
        "RSI 63", "12m momentum +12%", "5d reversal -2.1%", "illiquidity 0.00123", "illiquidity 12.35", "illiquidity 1.23e-05", "illiquidity 0.5", "in F&O expiry week", "outside expiry week",
        "Fri", "Dec", "delivery in 87%ile of universe", "volatility -1.3σ vs universe", "-DI 18", "my own +0.345%", "my own ~0", "my own +0.50", "my own 12.3", "my own 123,457", "my own in 50%ile of universe",
    ]


def one(spark, values, parts, label):
    names = tuple(f"n{i}" if isinstance(v, float) else v[0] for i, v in enumerate(values))
    numbers = [v if isinstance(v, float) else v[1] for v in values]
    schema = ", ".join(f"{n} double" for n in names) + ", " + ", ".join(f"p{i} double" for i in range(len(parts)))
    rows = spark.createDataFrame([(*numbers, *parts)], schema)
    row = reasons.with_reasons(rows, names, tuple(f"p{i}" for i in range(len(parts))), F.lit(label)).first()
    return row.reason, [s.feature for s in row.signals]


def test_signals_are_ranked_and_reasons_built(spark):
    text, found = one(spark, [("rsi_14", 50.0), ("beta_60d", 1.0), ("adx_14", 25.0)], [0.01, -0.9, 0.4], "BUY")
    assert found == ["beta_60d", "adx_14", "rsi_14"] and text == "ADX 25; RSI 50. Offset by beta 1.00."
    assert one(spark, [("rsi_14", 50.0), ("delivery_pct_z20", 1.2)], [0.3, 0.3], "BUY")[1] == ["delivery_pct_z20", "rsi_14"]
    assert one(spark, [("rsi_14", float("nan")), ("beta_60d", 1.0), ("adx_14", 25.0)], [0.9, 0.5, float("inf")], "SELL") == ("beta 1.00.", ["beta_60d"])
    assert one(spark, [("rsi_14", None)], [0.5], "HOLD") == (reasons.NOTHING, [])
    assert one(spark, [("rsi_14", 20.0), ("adx_14", 30.0)], [-0.5, -0.1], "STRONG SELL")[0] == "RSI 20; ADX 30."


def test_texts_never_grow_past_the_limit(spark):
    long = ("a_feature_with_a_name_that_is_so_long_that_it_fills_much_of_the_room_there_is", 5.0)
    names = [(f"{long[0]}_{i}", 5.0 + i) for i in range(3)]
    text, _ = one(spark, names, [0.5, 0.4, 0.3], "BUY")
    assert len(text) == reasons.MOST_CHARS and text.endswith(".")
    text, _ = one(spark, names, [0.5, 0.4, -0.3], "BUY")
    assert "Offset" not in text and len(text) <= reasons.MOST_CHARS


def test_broken_explanations_are_found(spark):
    rows = spark.createDataFrame([(1, "RSI 50.", [1], "BUY", 0.5), (2, "", [1], "BUY", 0.5), (3, "x" * 201, [1], "BUY", 0.5), (4, "x", [1, 2, 3, 4], "BUY", 0.5), (5, "x", [1], "MAYBE", 0.5), (6, "x", [1], "BUY", 1.5), (7, None, None, None, None)], "id int, reason string, signals array<int>, label string, confidence double")
    assert sorted(r.id for r in reasons.broken_explanations(rows).collect()) == [2, 3, 4, 5, 6, 7]


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(12)
    days, tickers = 300, 10
    x, z = rng.normal(size=(2, days, tickers))
    y = 0.4 * x + rng.normal(size=(days, tickers))
    day = lambda d: dt.date(2020, 1, 1) + dt.timedelta(days=d)
    rows = [(f"t{t:02}", day(d), float(y[d, t]), float(x[d, t]), float(z[d, t]), 0.5 + t / 10) for d in range(days) for t in range(tickers)]
    return x, y, spark.createDataFrame(rows, "ticker string, date date, y double, u double, v double, beta double").cache()


def test_meta_labels_shrink_scores(market):
    got = training.meta_labelled(market[2], ("u", "v"), "y", folds=2, least=50).toPandas()
    assert len(got) == 2 * 75 * 10 and got.confidence.between(0, 1).all()
    assert np.allclose(got.p, 0.5 + (got.primary - 0.5) * got.confidence)
    far = (got.primary - 0.5).abs() > 0.3
    assert got.confidence.mean() > 0.5 and (got.p - 0.5).abs()[far].mean() < (got.primary - 0.5).abs()[far].mean()


def test_configurations_are_compared_on_the_same_days(market):
    x, y, panel = market
    good = panel.select("ticker", "date", F.col("u").alias("p"))
    bad = panel.select("ticker", "date", (-F.col("beta")).alias("p"))
    got = {r.config: r for r in training.compared({"good": good, "beta": bad}, panel, "y").collect()}
    ranks = lambda a: a.argsort(axis=1).argsort(axis=1)
    want = np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(ranks(x), ranks(y), strict=True)])
    assert got["good"].mean_ic == pytest.approx(want) and got["good"].t > 5 and got["good"].n_days == 300
    assert got["beta"].beta_tilt == pytest.approx(0.55 - 1.4)  # of ten names two have a rank of 0.9 or more
