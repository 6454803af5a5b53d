"""Files in and out: bars from a folder of CSV files, a table partitioned by ticker, reports and metrics, and build-once caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "date date, open double, high double, low double, close double, volume double"
INTRADAY = "at timestamp, open double, high double, low double, close double, volume double"
#: Files that hold reports, not bars.
REPORTS = ("data_quality_report", "combined", "summary")


def csv_bars(spark: SparkSession, folder: str, schema: str = BARS) -> DataFrame:
    """Bars of all CSV files of a folder in one scan; a file's name is its ticker, ``IDX_`` standing for a caret."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
    return rows.select(F.regexp_replace(name, "^IDX_", "^").alias("ticker"), "*").where(~F.lower("ticker").isin(*REPORTS))


def intraday_bars(spark: SparkSession, folder: str, interval: str = "5m", schema: str = INTRADAY) -> DataFrame:
    """Bars within days of all files ``<ticker>_<interval>.csv`` of a folder, in one scan; files of other intervals aren't
    opened. A folder without such files gives an empty table."""
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", f"*_{interval}.csv").csv(folder)
    name = F.regexp_replace(F.col("_metadata.file_name"), rf"_{interval}\.csv$", "")
    return rows.select(F.regexp_replace(name, "^IDX_", "^").alias("ticker"), "*")


def daily_files(spark: SparkSession, folder: str, first: str, last: str, symbols: DataFrame, schema: str) -> DataFrame:
    """Rows of the weekdays from ``first`` to ``last`` of files ``<yyyy-mm-dd>.csv``, with their file's date, whose
    ``symbol``, without blanks around it, is one of ``symbols(symbol)``.

    One scan takes the place of a loop over days: the condition on names is met before files are opened, days without a
    file are no fault, and symbols repeated in the list repeat no rows.
    """
    day = F.try_to_date(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2}-\d{2})\.csv$", 1))
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*-*-*.csv").csv(folder).withColumn("date", day)
    rows = rows.where(F.col("date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))) & (F.weekday("date") < 5))
    wanted = symbols.select(F.regexp_replace(F.trim("symbol"), r"\.NS$", "").alias("symbol"))
    return rows.withColumn("symbol", F.trim("symbol")).join(wanted, "symbol", "left_semi")


def weekdays_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """``date``: the weekdays from ``first`` to ``last``, ends included; files of other days aren't asked for."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date"))
    return days.where(F.weekday("date") < 5)


def save_by_ticker(rows: DataFrame, path: str) -> None:
    """A Parquet table with a folder per ticker, so that a scan of some tickers reads no others."""
    rows.repartition("ticker").write.mode("overwrite").partitionBy("ticker").parquet(path)


def load_tickers(spark: SparkSession, path: str, tickers: tuple[str, ...] = ()) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("ticker").isin(*tickers)) if tickers else rows


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table below ``path``; built and written first where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_report(rows: DataFrame, path: str) -> None:
    """A CSV folder with headers."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def save_metrics(row: DataFrame, path: str) -> None:
    """Nested metrics as JSON lines, nulls kept."""
    row.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_metrics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Metrics as ``save_metrics`` wrote them; without a schema Spark finds one in the files."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def save_sorted(rows: DataFrame, path: str, *order: str) -> None:
    """A Parquet table in the order of its columns, over files as well as within them: a range of keys is a range of files,
    and statistics of row groups let scans pass the others by. No task sorts the whole table."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def load_panel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A feature panel below ``path``: Parquet if it is there, else the CSV folder ``<path>.csv``, else an empty table."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda p: of(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(of(p))
    if there(path):
        return spark.read.parquet(path)
    if there(f"{path}.csv"):
        return spark.read.schema(schema).option("header", True).csv(f"{path}.csv")
    return spark.createDataFrame([], schema)


def save_lines(row: DataFrame, path: str) -> None:
    """Each column of a summary as a line ``name: value``; null values as empty ones."""
    lines = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in row.columns])
    row.select(F.explode(lines).alias("value")).coalesce(1).write.mode("overwrite").text(path)  # a line per column


def on_panel(predictions: DataFrame, panel: DataFrame) -> DataFrame:
    """Saved predictions with their rows of the panel by date and ticker. Predictions without a row stay; columns that both
    hold are those of the predictions."""
    keys = ["date", "ticker"]
    return predictions.join(panel.drop(*[c for c in predictions.columns if c not in keys]), keys, "left")
