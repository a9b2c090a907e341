"""A data source for folders of learner files, ``u<id>.csv``, to read and to write.

``spark.read.format("learner_files").load(folder)`` plans byte ranges of about ``rangeBytes``
over all files: many small files share a task, a large file is cut over several. A line
belongs to the range its first byte lies in, and every range reads the header at the head of
its file. Each row carries its range and its number inside it; ``read`` turns these into row
numbers of the file. A file that can't be used gives one row with ``error``. With
``content=false`` only names and sizes are read.

``df.write.format("learner_files").save(folder)`` writes one file per learner from rows that
are together and in order. Files appear under their name when complete, so a task that is run
again replaces equal files by equal ones.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Required columns, and the names of learner files.
LOG_COLUMNS = ["timestamp", "solving_id", "question_id", "user_answer", "elapsed_time"]
FILE_NAME = re.compile(r"^u([0-9]+)\.csv$", re.IGNORECASE)

RANGE_BYTES = 32 << 20
BATCH_ROWS = 20_000
_PLACE = "source_file string, learner_id long, bytes long, range_start long, ranges int, number long, error string"
SCHEMA = f"{_PLACE}, {', '.join(c + ' string' for c in LOG_COLUMNS)}"


@dataclass
class Ranges(InputPartition):
    """(path, bytes of the file, first byte, end, ranges of the file) to read in one task."""

    files: list[tuple[str, int, int, int, int]]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:///") else path)


def _listed(path: str) -> list[tuple[str, int]]:
    system, root = _opened(path)
    found = system.get_file_info(fs.FileSelector(root))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.lower().endswith(".csv"))


def planned(files: list[tuple[str, int]], range_bytes: int) -> list[list[tuple[str, int, int, int, int]]]:
    """Tasks of about ``range_bytes``: small files together, large ones cut."""
    tasks, now, held = [], [], 0
    for path, size in files:
        ranges = max(1, -(-size // range_bytes))
        for k in range(ranges):
            start, end = size * k // ranges, size * (k + 1) // ranges
            if now and held + end - start > range_bytes:
                tasks.append(now)
                now, held = [], 0
            now.append((path, size, start, end, ranges))
            held += end - start
    return [*tasks, now] if now else tasks


def file_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _header(handle) -> tuple[list[str] | None, int]:
    """(names, first byte after the header); blank lines before it don't count."""
    handle.seek(0)
    for line in iter(handle.readline, b""):
        text = line.decode("utf-8-sig").strip("\r\n")
        if text:
            return next(csv.reader([text])), handle.tell()
    return None, handle.tell()


def _rows(handle, start: int, end: int) -> Iterator[list[str]]:
    """Fields of the lines that begin in [start, end)."""
    handle.seek(max(start - 1, 0))
    if start:
        handle.readline()
    while handle.tell() < end:
        line = handle.readline()
        if not line:
            return
        text = line.decode("utf-8").strip("\r\n")
        if text:
            yield next(csv.reader([text]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()] + [pa.string()] * len(LOG_COLUMNS)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("rangeBytes", RANGE_BYTES))
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        files = _listed(self.path)
        if self.content:
            return [Ranges(t) for t in planned(files, self.size)]
        return [Ranges([(p, s, 0, 0, 1) for p, s in files[i : i + 50_000]]) for i in range(0, len(files), 50_000)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        system, _ = _opened(self.path)
        for path, size, start, end, ranges in partition.files:
            name = file_name(path)
            known = FILE_NAME.match(name)
            place = (name, int(known[1]) if known else None, size, start, ranges)
            nothing = [None] * len(LOG_COLUMNS)
            if not self.content:
                rows.append((*place, None, None, *nothing))
            elif known:
                rows += self._file(system, path, start, end, place, nothing)
            while len(rows) >= BATCH_ROWS:
                yield _batch(rows[:BATCH_ROWS])
                rows = rows[BATCH_ROWS:]
        if rows:
            yield _batch(rows)

    @staticmethod
    def _file(system: fs.FileSystem, path: str, start: int, end: int, place: tuple, nothing: list) -> list[tuple]:
        out: list[tuple] = []
        try:
            with system.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as handle:
                names, after = _header(handle)
                if names is None:
                    return [(*place, None, "missing CSV header", *nothing)]
                known = [n.strip() for n in names]
                missing = [c for c in LOG_COLUMNS if c not in known]
                if missing:
                    return [(*place, None, "missing required columns " + ", ".join(missing), *nothing)] if start == 0 else []
                at = [names.index(c) if c in names else -1 for c in LOG_COLUMNS]
                for number, fields in enumerate(_rows(handle, max(start, after), end)):
                    out.append((*place, number, None, *[fields[i] if 0 <= i < len(fields) else None for i in at]))
        except (UnicodeDecodeError, csv.Error) as fault:
            return [(*place, None, f"{type(fault).__name__}: {fault}", *nothing)]
        return out


@dataclass
class Written(WriterCommitMessage):
    files: int


class Writer(DataSourceArrowWriter):
    """Columns: learner_id, then those of the file; ``header=false`` leaves the header line out."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.header = options.get("header", "true").lower() == "true"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        names, files, at = [c for c in self.columns if c != "learner_id"], 0, self.columns.index("learner_id")
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for learner, own in groupby(rows, key=lambda r: r[at]):
            hidden = f"{root}/.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(hidden) as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
                out = csv.writer(text, lineterminator="\n")
                if self.header:
                    out.writerow(names)
                out.writerows([v for i, v in enumerate(row) if i != at] for row in own)
            system.move(hidden, f"{root}/u{learner}.csv")
            files += 1
        return Written(files)


class LearnerFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "learner_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(dict(self.options), schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LearnerFiles)


def write(df: DataFrame, path: str, header: bool = True) -> None:
    """One file per learner_id from the other columns of ``df`` but ``source_row``, in its order."""
    register(df.sparkSession)
    rows = df.repartition("learner_id").sortWithinPartitions("learner_id", "source_row").drop("source_row")
    rows.write.format("learner_files").option("header", str(header).lower()).mode("append").save(path)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(responses, errors) of all learner files of a folder.

    Responses: learner_id, source_file, source_row (2 for the first row after the header; blank
    lines aren't counted) and the five raw string fields. Errors: one row per file that can't be
    used, which has no responses. Quoted fields may hold commas, not line breaks.
    """
    register(spark)
    rows = spark.read.format("learner_files").option("rangeBytes", str(range_bytes)).load(path)
    errors = rows.filter("error is not null").groupBy("learner_id", "source_file").agg(F.min("error").alias("error"))
    errors = errors.select("learner_id", "source_file", F.lit("read").alias("stage"), "error")
    good = rows.filter("error is null and learner_id is not null")
    # Files of several ranges: rows of the ranges before, one row per range.
    cut = rows.filter("ranges > 1").groupBy("source_file", "range_start").agg(F.count("number").alias("n"), F.count("error").alias("faults"))
    over = Window.partitionBy("source_file")
    before = F.sum("n").over(over.orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.select("source_file", "range_start", F.coalesce(before, F.lit(0)).alias("before"), F.sum("faults").over(over).alias("faults"))
    placed = good.filter("ranges = 1").withColumn("before", F.lit(0).cast("long")).unionByName(
        good.filter("ranges > 1").join(cut.filter("faults = 0").drop("faults"), ["source_file", "range_start"])
    )
    return placed.select("learner_id", "source_file", (F.col("number") + F.col("before") + 2).alias("source_row"), *LOG_COLUMNS), errors


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """source_file, bytes and learner_id (null for other names) of every CSV file; no content is read."""
    register(spark)
    return spark.read.format("learner_files").option("content", "false").load(path).select("source_file", "bytes", "learner_id")
