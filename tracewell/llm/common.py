"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# Rows that one range of a global order holds on average.
RANGE_ROWS = 200_000

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "path" not in _LOCAL:
        _LOCAL["path"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL["path"]


class Scratch:
    """Tables written to the shared folder and read back, so that their lineage ends there.

    Used as a context: on leaving it, all tables are deleted but those that were saved with
    ``keep=True``, which the returned DataFrame still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.drop: list[str] = []
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.drop:
            self._delete(path)
        self.drop = []

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def save(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not keep:
            self.drop.append(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (path, back)
        return back

    def forget(self, saved: DataFrame) -> None:
        """Delete a saved table before the context ends."""
        path, _ = self.paths.pop(id(saved))
        self._delete(path)
        self.drop.remove(path)


def one(df: DataFrame):
    """The single row of an aggregate without groups."""
    return df.collect()[0]


def running_total(scratch: Scratch, df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the inclusive running sum of ``value`` (long) in a global order.

    Rows are cut into ranges of the order; each range is summed, and a window inside the
    range adds what lies before it. No range depends on one key, so a hot key is split, and
    the totals do not depend on where the cuts fall. The offsets of the ranges are one row
    per ``RANGE_ROWS`` rows.
    """
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    keys = [f"__o{i}" for i in range(len(order))]
    plain = df.columns
    parts = df.select("*", value.cast("long").alias("__v"), *[c.alias(k) for c, k in zip(order, keys)])
    if ranges > 1:
        parts = parts.repartitionByRange(ranges, *[F.col(k).asc_nulls_first() for k in keys])
        parts = parts.withColumn("__p", F.spark_partition_id())
    else:
        parts = parts.withColumn("__p", F.lit(0))
    parts = scratch.save(parts)
    sums = parts.groupBy("__p").agg(F.sum("__v").alias("__s")).collect()
    offsets, before = [], 0
    for p, s in sorted(sums):
        offsets.append((p, before))
        before += s
    in_range = Window.partitionBy("__p").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    total = F.sum("__v").over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    if ranges > 1:
        table = scratch.spark.createDataFrame(offsets, "__p int, __before long")
        parts = parts.join(F.broadcast(table), "__p")
        total = total + F.col("__before")
    return parts.withColumn(name, total).select(*plain, name)


def slices(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to ``limit`` at most (a larger item stands alone)."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
