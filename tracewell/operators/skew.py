"""Building blocks that stay correct and balanced when one key holds most rows.

Every ordered operator of the package goes through :func:`prefix`. Ordinarily it is a
plain window with one exchange on the group key. When a group is larger than one task
should hold, it is a scan of two levels: one exchange by ranges of (group, order), a window
inside every range, and partial states of the groups that straddle ranges, which a broadcast
of at most two rows per range adds. No row is dropped in either case.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A group up to this many rows is always left in one task.
TASK_ROWS_CONF = "spark.tracewell.taskRows"
TASK_ROWS_DEFAULT = 5_000_000
# Upper bound on the ranges of a table.
MAX_RANGES = 10_000
# Lookup tables up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS_CONF = "spark.tracewell.broadcastRows"
BROADCAST_ROWS_DEFAULT = 500_000

_RANGE = "__range"
_LOCAL_DIR: dict[str, str] = {}


def _conf_int(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables; set here only when unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if "path" not in _LOCAL_DIR:
        _LOCAL_DIR["path"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIR["path"]


# Folders of the running query, innermost last; see ``tables_dropped``.
_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted with the tables of the running query."""
    path = f"{shared_dir(spark)}/tracewell-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_dropped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` so that the tables it wrote on the way are deleted; its result is written in their place.

    A query that wrote none returns its result as it is."""

    @wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        _OPEN.append([])
        try:
            result = query(spark, sf)
            if _OPEN[-1]:
                kept = f"{shared_dir(spark)}/tracewell-{uuid.uuid4().hex}"
                result.write.parquet(kept)
                result = spark.read.schema(result.schema).parquet(kept)
            return result
        finally:
            for path in _OPEN.pop():
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    return run


def task_rows(df: DataFrame) -> tuple[int, int]:
    """(rows in ``df``, rows of one group that one task may hold, whatever the size of ``df``)."""
    return df.count(), _conf_int(df.sparkSession, TASK_ROWS_CONF, TASK_ROWS_DEFAULT)


def hot_groups(df: DataFrame, keys: Sequence[str]) -> tuple[list, int]:
    """Groups larger than one task should hold: at most one comes back per so many rows of ``df``."""
    rows, limit = task_rows(df.select(*keys))
    if rows <= limit:
        return [], limit
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > limit).collect(), limit


def _same(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def _key_frame(df: DataFrame, keys: Sequence[str], hot: list) -> DataFrame:
    fields = [T.StructField(f"__k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    rows = [tuple(row[k] for k in keys) for row in hot]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def split_hot(df: DataFrame, keys: Sequence[str], hot: list) -> tuple[DataFrame, DataFrame]:
    """(rows of the hot groups, all other rows)."""
    frame = F.broadcast(_key_frame(df, keys, hot))
    condition = _same(df, frame, [(k, f"__k{i}") for i, k in enumerate(keys)])
    return df.join(frame, condition, "left_semi"), df.join(frame, condition, "left_anti")


def _with_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """``df`` stored with ``__range``: the number of its range of (group, order), of about ``limit`` rows.

    The order columns must be non-null."""
    stored = materialise(df)
    ranges = min(MAX_RANGES, max(2, math.ceil(stored.count() / limit)))
    return materialise(stored.repartitionByRange(ranges, *group, *order).withColumn(_RANGE, F.spark_partition_id()))


def prefix(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    count: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    hot: tuple[list, int] | None = None,
) -> DataFrame:
    """Running values over the rows *before* each row of its group.

    ``count``: rows before (0-based position). ``sums``: sum of a column over the rows
    before. ``lasts``: last non-null value before. ``totals``: sum over the whole group.
    ``order`` columns are ascending, non-null and should identify a row. Without ``group``
    columns the order is that of the whole table, always in ranges.
    """
    sums, lasts, totals = dict(sums or {}), dict(lasts or {}), dict(totals or {})
    hot_list, limit = hot if hot is not None else hot_groups(df, group) if group else ([], _conf_int(df.sparkSession, TASK_ROWS_CONF, TASK_ROWS_DEFAULT))
    ranged = bool(hot_list) or not group
    keep = df.columns
    if ranged:
        df = _with_ranges(df, group, order, limit)
    partition = [*group, _RANGE] if ranged else list(group)
    position = Window.partitionBy(*partition).orderBy(*order)
    before = position.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*partition)

    local = {}
    if count:
        local[count] = (F.row_number().over(position) - 1).cast("long")
    for name, column in sums.items():
        local[name] = F.coalesce(F.sum(column).over(before), F.lit(0).cast("long"))
    for name, column in lasts.items():
        local[name] = F.last(column, ignorenulls=True).over(before)
    for name, column in totals.items():
        local[name] = F.sum(column).over(whole)
    if not ranged:
        return df.withColumns(local).select(*keep, *local)

    # States of the groups that straddle ranges: at most two rows per range, MAX_RANGES of them.
    sort_key = F.struct(*[F.col(o) for o in order])
    aggregates = [F.count(F.lit(1)).alias("__c")]
    aggregates += [F.sum(c).alias(f"__s_{n}") for n, c in sums.items()]
    aggregates += [F.max_by(c, F.when(c.isNotNull(), sort_key)).alias(f"__l_{n}") for n, c in lasts.items()]
    aggregates += [F.sum(c).alias(f"__t_{n}") for n, c in totals.items()]
    straddles = F.count(F.lit(1)).over(Window.partitionBy(*group)) > 1
    summary = df.groupBy(*group, _RANGE).agg(*aggregates).withColumn("__straddles", straddles).where("__straddles")
    over = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    all_ranges = Window.partitionBy(*group)
    columns = [F.col(k).alias(f"__k{i}") for i, k in enumerate(group)] + [F.col(_RANGE).alias("__r")]
    if count:
        columns.append(F.sum("__c").over(over).alias(f"__carry_{count}"))
    columns += [F.sum(f"__s_{n}").over(over).alias(f"__carry_{n}") for n in sums]
    columns += [F.last(f"__l_{n}", ignorenulls=True).over(over).alias(f"__carry_{n}") for n in lasts]
    columns += [F.sum(f"__t_{n}").over(all_ranges).alias(f"__carry_{n}") for n in totals]
    carry = F.broadcast(summary.select(*columns))
    near = df.withColumns(local)
    pairs = [(k, f"__k{i}") for i, k in enumerate(group)] + [(_RANGE, "__r")]
    joined = near.join(carry, _same(near, carry, pairs), "left")
    result = {}
    for name in ([count] if count else []) + list(sums):
        result[name] = F.col(name) + F.coalesce(F.col(f"__carry_{name}"), F.lit(0).cast("long"))
    for name in lasts:
        result[name] = F.coalesce(F.col(name), F.col(f"__carry_{name}"))
    for name in totals:
        result[name] = F.coalesce(F.col(f"__carry_{name}"), F.col(name))
    return joined.withColumns(result).select(*keep, *local)


def fits_broadcast(df: DataFrame) -> bool:
    cap = _conf_int(df.sparkSession, BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT)
    return df.limit(cap + 1).count() <= cap


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join a large table to one that is unique on ``keys`` (inner, left, left_semi, left_anti).

    The look-up side is counted first and broadcast only below the cap. Above it, rows of
    hot keys (at most one per ``taskRows`` rows) meet a broadcast of just those look-up rows and
    the remaining rows take a shuffle join, so no key can overload a task."""
    keys = list(keys)
    if fits_broadcast(lookup):
        return facts.join(F.broadcast(lookup), keys, how)
    hot, _ = hot_groups(facts, keys)
    if not hot:
        return facts.join(lookup, keys, how)
    hot_facts, cold_facts = split_hot(facts, keys, hot)
    hot_lookup, _ = split_hot(lookup, keys, hot)
    return hot_facts.join(F.broadcast(hot_lookup), keys, how).unionByName(
        cold_facts.join(lookup, keys, how)
    )


def bottom_k(
    df: DataFrame,
    strata: Sequence[str],
    order: Sequence[Column],
    k: Column | int,
    spread_by: Sequence[str],
    salts: int = 64,
) -> DataFrame:
    """The first ``k`` rows of every stratum by ``order`` (a total order).

    Ranked first inside ``salts`` parts of each stratum and then over the survivors, so a
    stratum with most of the rows is ranked by many tasks. Spark prunes each step with its
    window group limit before the exchange."""
    limit = k if isinstance(k, Column) else F.lit(k)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    first = Window.partitionBy(*strata, "__salt").orderBy(*order)
    second = Window.partitionBy(*strata).orderBy(*order)
    parts = df.withColumn("__salt", salt).withColumn("__rank", F.row_number().over(first))
    survivors = parts.where(F.col("__rank") <= limit).drop("__salt", "__rank")
    ranked = survivors.withColumn("__rank", F.row_number().over(second))
    return ranked.where(F.col("__rank") <= limit).drop("__rank")


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float], name: str = "quantiles"
) -> DataFrame:
    """Linear-interpolation quantiles per group: ``name`` is an array aligned with
    ``probabilities``. The histogram of the values is ranked with :func:`prefix`, at every size,
    so no task holds the values of a group."""
    present = df.where(F.col(value).isNotNull())
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    histogram = present.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__w"))
    ranked = prefix(
        histogram, group, [value], sums={"__before": F.col("__w")}, totals={"__n": F.col("__w")}
    )
    spots = F.transform(
        wanted,
        lambda p: F.struct(
            p.alias("p"),
            F.floor((F.col("__n") - 1) * p).alias("lo"),
            F.ceil((F.col("__n") - 1) * p).alias("hi"),
            ((F.col("__n") - 1) * p).alias("at"),
        ),
    )
    inside = lambda x: (x >= F.col("__before")) & (x < F.col("__before") + F.col("__w"))
    hits = ranked.withColumn("__spot", F.explode(F.filter(spots, lambda s: inside(s.lo) | inside(s.hi))))
    parts = hits.groupBy(*group, F.col("__spot.p").alias("__p"), F.col("__spot.lo").alias("__lo"), F.col("__spot.at").alias("__at")).agg(
        F.min(value).alias("__v0"), F.max(value).alias("__v1")
    )
    each = parts.withColumn("__q", F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__at") - F.col("__lo")))
    return each.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__p", "__q"))), lambda s: s["__q"]).alias(name)
    )
