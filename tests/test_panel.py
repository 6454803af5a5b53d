"""Every panel query against its SQL, and operators on small fixtures."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import panel
from tidemark.plans import catalog
from tidemark.streaming.bars import event_bars

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "part", "events", "orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    keys = [c for c in ("ticker", "event_type", "date", "start", "score", "target") if c in frame.columns]
    keys += [c for c in frame.columns if c not in keys and frame[c].dtype.kind != "f"]  # reports have keys of their own
    return frame.sort_values(keys or list(frame.columns), ignore_index=True, key=lambda c: c.astype(str) if c.dtype == object else c)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = ordered(catalog.QUERIES[name](spark, SF).toPandas()), ordered(duck.execute(catalog.ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours.columns:
        if pd.api.types.is_numeric_dtype(theirs[c]):
            assert np.allclose(ours[c].astype(float), theirs[c].astype(float), atol=2e-6, rtol=1e-9, equal_nan=True), c
        else:
            text = [frame[c].astype(str).str[:10].where(frame[c].notna(), "") for frame in (ours, theirs)]  # missing dates read differently
            assert (text[0] == text[1]).all(), c


def test_classes_at_their_bounds(spark):
    given = [0.05, 0.03, 0.025, 0.01, 0.005, 0.0, -0.005, -0.01, -0.015, -0.03, -0.05, None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, r double")
    found = [r.c for r in rows.select("i", panel.return_class(F.col("r")).alias("c")).orderBy("i").collect()]
    assert found == [4, 3, 3, 2, 2, 2, 2, 2, 1, 1, 0, None]


def test_expiry_moves_to_tuesday(spark):
    days = spark.createDataFrame([(dt.date(2025, 8, 1),), (dt.date(2025, 9, 1),), (dt.date(2025, 9, 30),), (dt.date(2024, 2, 29),)], "d date")
    assert [r.x for r in days.select(panel.days_to_expiry(F.col("d")).alias("x")).collect()] == [27, 29, 0, 0]


def test_bars_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    stream = event_bars(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, event_bars(table).collect()))
