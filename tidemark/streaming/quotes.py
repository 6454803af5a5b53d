"""Live quotes: one plan for tables and streams; the latest price per name, its change, freshness, and sessions of use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_quotes(quotes: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, price, ts, n)``: the newest price of each name; of equal times the highest id. State is a row per name.

    As a stream it runs in update mode: each trigger gives the names whose price is new.
    """
    newest = F.struct("ts", "quote_id")
    return quotes.groupBy(key).agg(F.max_by("price", newest).alias("price"), F.max("ts").alias("ts"), F.count("*").alias("n"))


def with_change(quotes: DataFrame, closes: DataFrame, key: str = "ticker") -> DataFrame:
    """Quotes, streamed or not, with the change in percent against a static table ``closes(key, prior)``; null without a prior."""
    return quotes.join(closes, key, "left").withColumn("change_pct", F.try_divide(F.col("price"), F.nullif(F.col("prior"), F.lit(0.0))) * 100 - 100)


def freshness(quotes: DataFrame, now: Column, minutes: int) -> DataFrame:
    """``live``: whether the quote is at most so many minutes old."""
    return quotes.withColumn("live", F.coalesce(F.col("ts") >= now - F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(False)))


def sessions_of(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(user_id, start, stop, n, total)``: runs of a user's events less than ``gap`` apart; events later than ``late`` are left out of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def without_repeats(events: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """Events of which each key is met once within ``late``; as a stream the keys are state that a restart finds again."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if not events.isStreaming:
        return rows.dropDuplicates(list(keys))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def newest_date(spark: SparkSession, path: str) -> tuple[object, int | None]:
    """The last date below ``path`` and the batch that wrote it, as the table itself says; nothing where there is no table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target) or not any(f.isDirectory() and f.getPath().getName().startswith("date=") for f in files.listStatus(target)):
        return None, None
    row = spark.read.parquet(path).agg(F.max(F.struct("date", "batch")).alias("last")).first()
    return (row["last"]["date"], row["last"]["batch"]) if row["last"] else (None, None)


def latest_date_sink(run: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes ``run`` of the rows of a batch's latest date below ``path``, only if that date is new.

    The table is its own memory: the last date is read from it, so that nothing is lost when the driver is. A date is a
    folder that is replaced as a whole; a batch that is run again, since it failed before Spark noted it, writes the same.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.agg(F.max("date")).first()[0]
        known, written_by = newest_date(spark, path)
        if latest is None or (known is not None and (latest < known or (latest == known and written_by != number))):
            return
        found = run(batch.where(F.col("date") == F.lit(latest)))
        found = found.withColumns({"date": F.lit(latest), "batch": F.lit(number).cast("long")})
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    return each


def on_new_date(run: Callable[[DataFrame], None], column: str = "date") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that calls ``run`` with the rows of the latest date, only when that date is new."""
    seen: list = []

    def each(batch: DataFrame, _: int) -> None:
        latest = batch.agg(F.max(column)).first()[0]
        if latest is not None and (not seen or latest > seen[-1]):
            seen[:] = [latest]
            run(batch.where(F.col(column) == latest))

    return each
