"""Daily exchange files in zip archives, read where Spark reads: any file system, an archive per task row."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as compute
import pyarrow.csv as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Stock options and stock futures, by the exchange's names.
STOCK_INSTRUMENTS = ("OPTSTK", "FUTSTK")
#: A day such as 05JAN2021 in a file's name.
NAME_DAY, NAME_FORMAT = r"(\d{2}[A-Z]{3}\d{4})", "%d%b%Y"
#: Bytes of a member that are parsed at once.
BLOCK = 1 << 20


def day_of(name: str) -> dt.date | None:
    """The day in a file's name, none where there isn't a valid one."""
    found = re.search(NAME_DAY, name.upper())
    try:
        return dt.datetime.strptime(found[1].title(), NAME_FORMAT).date() if found else None
    except ValueError:
        return None


def archives_between(spark: SparkSession, folder: str, first: dt.date, last: dt.date) -> list[str]:
    """Paths of the archives whose names hold a day from ``first`` to ``last``: a listing, no file is opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath() for f in files if f.isFile() and f.getPath().getName().lower().endswith(".zip")]
    return sorted(p.toString() for p in names if (day := day_of(p.getName())) and first <= day <= last)


def _members(content: bytes, schema: pa.Schema, instrument: str, wanted: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of an archive's first CSV member, parsed block by block; names are stripped, absent columns are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        member = next(n for n in archive.namelist() if n.lower().endswith(".csv"))
        with archive.open(member) as stream:
            kinds = {f.name: f.type for f in schema}
            header = stream.readline().decode("utf-8-sig").strip().split(",")
            names = [h.strip().strip('"') for h in header]
            options = pc.ConvertOptions(column_types={n: kinds[n] for n in names if n in kinds}, include_columns=[n for n in names if n in kinds or n == instrument], strings_can_be_null=True)
            for batch in pc.open_csv(stream, pc.ReadOptions(column_names=names, block_size=BLOCK), convert_options=options):
                rows = pa.Table.from_batches([batch])
                if instrument in rows.column_names:
                    rows = rows.filter(compute.is_in(compute.utf8_trim_whitespace(rows.column(instrument).cast(pa.string())), pa.array(wanted)))
                columns = [rows.column(f.name).cast(f.type) if f.name in rows.column_names else pa.nulls(rows.num_rows, f.type) for f in schema]
                yield from pa.Table.from_arrays(columns, schema=schema).to_batches()


def zipped_rows(spark: SparkSession, folder: str, schema: str, first: dt.date, last: dt.date, instrument: str = "INSTRUMENT", wanted: tuple[str, ...] = STOCK_INSTRUMENTS) -> tuple[DataFrame, DataFrame]:
    """``(rows, broken)``: rows of the wanted instruments in the archives from ``first`` to ``last``, with the ``date`` and
    ``file`` they come from; and ``(file, error)`` of archives that can't be read to their end, whose rows are left out.

    Files of other days aren't opened. Members stream through a task in blocks; an archive itself, some megabytes a day,
    is held as a whole. A member without the instrument column is taken whole.
    """
    kinds = StructType.fromDDL(schema)
    inner = to_arrow_schema(kinds)
    out = StructType.fromDDL(f"{schema}, date date, file string, error string")
    outer = to_arrow_schema(out)
    paths = archives_between(spark, folder, first, last)
    if not paths:
        none = spark.createDataFrame([], out)
        return none.drop("error"), none.select("file", "error")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name, failed = path.rsplit("/", 1)[-1], None
                try:
                    held = list(_members(content.as_py(), inner, instrument, wanted))
                except (zipfile.BadZipFile, StopIteration, pa.ArrowInvalid, EOFError, OSError, UnicodeDecodeError, RuntimeError) as fault:
                    held, failed = [], f"{type(fault).__name__}: {fault}"
                for rows in held:
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([day_of(name)] * n, pa.date32()), pa.array([name] * n), pa.nulls(n, pa.string())], schema=outer)
                if failed:
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in inner], pa.array([day_of(name)], pa.date32()), pa.array([name]), pa.array([failed])], schema=outer)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    found = files.mapInArrow(read, out)
    return found.where(F.col("error").isNull()).drop("error"), found.where(F.col("error").isNotNull()).select("file", "error")
