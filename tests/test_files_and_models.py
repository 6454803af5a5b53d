"""Round trips of files, and models on small panels."""

import datetime as dt
import zipfile

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.sources import archives, files
from tidemark.streaming import quotes

DAY = dt.date(2020, 1, 1)


def test_bars_of_a_folder_of_csv_files(spark, tmp_path):
    for name in ("ABC.NS", "IDX_NSEI", "data_quality_report"):
        (tmp_path / f"{name}.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,100\n2024-01-03,1,2,0.5,,\n")
    got = files.csv_bars(spark, str(tmp_path))
    assert {r.ticker for r in got.collect()} == {"ABC.NS", "^NSEI"} and got.where("close is null").count() == 2


def test_tables_by_ticker_and_caches(spark, tmp_path):
    rows = spark.createDataFrame([("A", DAY, 1.0), ("B", DAY, 2.0)], "ticker string, date date, close double")
    files.save_by_ticker(rows, str(tmp_path / "t"))
    assert [r.close for r in files.load_tickers(spark, str(tmp_path / "t"), ("B",)).collect()] == [2.0]
    built = []
    for _ in range(2):
        got = files.cached(spark, str(tmp_path / "c"), lambda: built.append(1) or rows)
    assert got.count() == 2 and built == [1]
    files.save_report(rows, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    files.save_metrics(rows.agg(F.struct(F.max("close").alias("best")).alias("m")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().m.best == 2.0


def test_bars_within_days(spark, tmp_path):
    for name in ("ABC.NS_5m", "IDX_NSEI_5m", "ABC.NS_1h"):
        (tmp_path / f"{name}.csv").write_text("at,open,high,low,close,volume\n2024-01-02 09:15:00,1,2,0.5,1.5,100\n2024-01-02 09:20:00,1,2,0.5,,\n")
    got = files.intraday_bars(spark, str(tmp_path)).orderBy("ticker", "at").collect()
    assert [(r.ticker, r.at.minute) for r in got] == [("ABC.NS", 15), ("ABC.NS", 20), ("^NSEI", 15), ("^NSEI", 20)]
    assert files.intraday_bars(spark, str(tmp_path), "1m").count() == 0


def test_daily_files_of_some_symbols(spark, tmp_path):
    for day in ("2024-01-05", "2024-01-06", "2024-01-08", "2024-01-10", "2023-12-29", "notes-of-day"):
        (tmp_path / f"{day}.csv").write_text("symbol,close\n ABC ,1.5\nXYZ,2\n,3\n")
    symbols = spark.createDataFrame([("ABC.NS",), ("ABC",), (" QQQ",), (None,)], "symbol string")
    got = files.daily_files(spark, str(tmp_path), "2024-01-01", "2024-01-09", symbols, "symbol string, close double")
    assert sorted((r.date.day, r.symbol, r.close) for r in got.collect()) == [(5, "ABC", 1.5), (8, "ABC", 1.5)]


def test_sorted_tables_panels_and_predictions(spark, tmp_path):
    rows = spark.createDataFrame([(f"T{i % 7}", DAY + dt.timedelta(days=i), float(i)) for i in range(70)], "ticker string, date date, close double")
    files.save_sorted(rows.repartition(5), str(tmp_path / "s"), "ticker", "date")
    parts = {}
    for r in spark.read.parquet(str(tmp_path / "s")).select("*", "_metadata.file_name").collect():
        parts.setdefault(r.file_name, []).append((r.ticker, r.date))
    spans = sorted((p[0], p[-1]) for p in parts.values())
    assert all(p == sorted(p) for p in parts.values()) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    schema = "ticker string, date date, close double"
    assert files.load_panel(spark, str(tmp_path / "s"), schema).count() == 70
    files.save_report(rows, str(tmp_path / "p.csv"))
    assert sorted(files.load_panel(spark, str(tmp_path / "p"), schema).collect()) == sorted(rows.collect())
    assert files.load_panel(spark, str(tmp_path / "none"), schema).count() == 0
    predictions = spark.createDataFrame([("T1", DAY + dt.timedelta(days=1), 0.7, -1.0), ("T9", DAY, 0.2, -2.0)], "ticker string, date date, p double, close double")
    panel = rows.withColumn("vol", F.col("close") * 2)
    assert sorted((r.ticker, r.p, r.close, r.vol) for r in files.on_panel(predictions, panel).collect()) == [("T1", 0.7, -1.0, 2.0), ("T9", 0.2, -2.0, None)]
    files.save_lines(spark.createDataFrame([(3, None)], "n_consensus int, note string"), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["n_consensus: 3", "note: "]
    files.save_metrics(spark.createDataFrame([(0.5, None)], "ic double, note string"), str(tmp_path / "m"))
    assert files.load_metrics(spark, str(tmp_path / "m"), "ic double, note string").first().ic == 0.5


def test_weekdays(spark):
    assert [r.date.day for r in files.weekdays_between(spark, "2024-01-05", "2024-01-09").collect()] == [5, 8, 9]


def test_walk_forward_models_learn_a_signal(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(400):
        for t in range(6):
            x = float(rng.normal())
            rows.append((f"T{t}", DAY + dt.timedelta(days=d), x, float(rng.normal()), int(x + rng.normal() > 0)))
    panel = spark.createDataFrame(rows, "ticker string, date date, x double, noise double, label int")
    for kind in ("linear", "trees"):
        got = models.walk_forward_scores(panel, ("x", "noise"), kind, folds=1, purge=3, least=100).join(panel, ["ticker", "date"])
        means = {r.label: r.p for r in got.groupBy("label").agg(F.avg("p").alias("p")).collect()}
        assert got.count() == 133 * 6 and means[1] > means[0] + 0.15
        assert got.agg(F.min("date")).first()[0] == DAY + dt.timedelta(days=267)
    mixed = models.blended(got.select("ticker", "date", "p"), panel.select("ticker", "date", F.col("x").alias("q")))
    assert mixed.where("p between 0 and 1").count() == 133 * 6


def test_bootstrap_keeps_the_mean_and_reruns_agree(spark):
    rng = np.random.default_rng(1)
    days = spark.createDataFrame([(i, float(r)) for i, r in enumerate(rng.normal(0.01, 0.02, 100))], "i int, ret double")
    a, b = (models.block_bootstrap(days, 50, 10).orderBy("sim").collect() for _ in range(2))
    assert a == b and len(a) == 50
    assert abs(np.mean([r.mean_ret for r in a]) - days.agg(F.avg("ret")).first()[0]) < 0.003
    assert all(-1 <= r.max_drawdown <= 0 for r in a)


def test_clusters_of_patterns_by_ticker(spark):
    """Every pattern belongs to the nearest of its ticker's centres, which are its clusters' means; a short past is one cluster."""
    rng = np.random.default_rng(6)
    series = {"A": 0.1 * rng.normal(size=90), "B": np.repeat([-3.0, 0.0, 4.0], 40) + rng.normal(size=120), "C": rng.normal(size=39), "D": np.zeros(60), "E": np.ones(4)}
    rows = [(t, DAY + dt.timedelta(days=i), None if i == 0 else float(v)) for t, s in series.items() for i, v in enumerate(s)]
    panel = spark.createDataFrame(rows, "ticker string, date date, ret_1d double")
    found = {(r.ticker, r.date): r.cluster for r in models.pattern_clusters(panel).collect()}
    assert found == {(r.ticker, r.date): r.cluster for r in models.pattern_clusters(panel.repartition(3)).collect()}
    for ticker, s in series.items():
        s = np.concatenate(([0.0], s[1:]))
        labels = [found[ticker, DAY + dt.timedelta(days=i)] for i in range(len(s))]
        assert labels[:10] == [None] * min(10, len(s))
        patterns = np.array([s[i - 10 : i] for i in range(10, len(s))])
        mine = np.array(labels[10:])
        if len(patterns) < 30 or ticker == "D":
            assert set(mine.tolist()) <= {0}
            continue
        assert set(mine) == {0, 1, 2}
        centres = np.array([patterns[mine == c].mean(axis=0) for c in range(3)])
        assert (np.diff(centres.sum(axis=1)) >= 0).all()
        assert (((patterns[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) == mine).all()


def _archive(path, text, name="fo.csv"):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "not this one")
        z.writestr(name, text)


def test_zipped_files_of_a_span_of_days(spark, tmp_path):
    head = "INSTRUMENT,SYMBOL , STRIKE_PR,OPEN_INT,\n"
    _archive(tmp_path / "fo05JAN2021bhav.csv.zip", head + "OPTSTK,ABC,100,7,\nOPTIDX,NIFTY,1,1,\n FUTSTK ,XYZ,,9,\n")
    _archive(tmp_path / "fo06JAN2021bhav.csv.zip", head + "".join(f"OPTSTK,S{i},{i}.5,{i},\n" for i in range(50_000)))
    _archive(tmp_path / "fo07JAN2021bhav.csv.zip", "SYMBOL,OPEN_INT\nABC,3\n")
    _archive(tmp_path / "fo09JAN2021bhav.csv.zip", head + "OPTSTK,LATE,1,1,\n")
    (tmp_path / "fo08JAN2021bhav.csv.zip").write_bytes((tmp_path / "fo06JAN2021bhav.csv.zip").read_bytes()[:2000])
    (tmp_path / "fo32JAN2021bhav.csv.zip").write_bytes(b"no day")
    (tmp_path / "notes.txt").write_text("05JAN2021")
    rows, broken = archives.zipped_rows(spark, str(tmp_path), "SYMBOL string, STRIKE_PR double, OPEN_INT long", dt.date(2021, 1, 5), dt.date(2021, 1, 8))
    counts = {r["date"]: (r["n"], r["s"]) for r in rows.groupBy("date").agg(F.count("*").alias("n"), F.sum("OPEN_INT").alias("s")).collect()}
    assert counts == {dt.date(2021, 1, 5): (2, 16), dt.date(2021, 1, 6): (50_000, 49_999 * 25_000), dt.date(2021, 1, 7): (1, 3)}
    assert rows.where("SYMBOL = 'XYZ'").first().STRIKE_PR is None and rows.where("SYMBOL = 'S7'").first().STRIKE_PR == 7.5
    assert [r.file for r in broken.collect()] == ["fo08JAN2021bhav.csv.zip"]
    assert len(archives.archives_between(spark, str(tmp_path), dt.date(2021, 1, 6), dt.date(2021, 1, 7))) == 2
    none, _ = archives.zipped_rows(spark, str(tmp_path), "SYMBOL string", dt.date(2030, 1, 1), dt.date(2030, 1, 2))
    assert none.collect() == [] and none.columns == ["SYMBOL", "date", "file"]


def test_a_stream_that_is_stopped_and_started_again(spark, tmp_path):
    """The sink's last date and the keys of repeats come back from what was written, not from the driver."""
    ts = lambda day, hour: dt.datetime(2024, 1, day, hour)
    schema = "quote_id long, ticker string, ts timestamp, price double"
    done = []

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        events = quotes.without_repeats(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), "quote_id", late="2 days")

        def scores(batch):
            done.append(batch.count())
            return batch.groupBy("date").agg(F.count("*").alias("n"), F.sum("price").alias("total"))

        sink = quotes.latest_date_sink(scores, str(tmp_path / "out"))
        stream = events.withColumn("date", F.to_date("ts")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        return sink

    def table():
        return sorted((r.date, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive("a", [(1, "A", ts(2, 9), 1.0), (2, "A", ts(3, 9), 2.0), (2, "A", ts(3, 9), 2.0)])
    run()
    first = (dt.date(2024, 1, 3), 1, 2.0)
    assert table() == [first]
    arrive("b", [(2, "A", ts(3, 9), 2.0), (3, "A", ts(3, 10), 50.0)])  # a repeat, and more of a date that isn't new
    run()
    assert table() == [first]
    arrive("c", [(4, "A", ts(4, 9), 4.0), (5, "B", ts(4, 9), 5.0), (3, "A", ts(3, 10), 50.0)])
    sink = run()
    assert table() == [first, (dt.date(2024, 1, 4), 2, 9.0)]
    number = max(r.batch for r in spark.read.parquet(str(tmp_path / "out")).collect())
    again = spark.createDataFrame([(dt.date(2024, 1, 4), 4.0), (dt.date(2024, 1, 4), 5.0)], "date date, price double")
    sink(again, number)  # the same batch once more, as after a failure
    sink(again, number + 1)  # another batch of a date that is known
    assert table() == [first, (dt.date(2024, 1, 4), 2, 9.0)]
