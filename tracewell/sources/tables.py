"""Stage tables: typed readers, writers and the build manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARAMETER_SCHEMA = "skill_id int, parameter string, shrunk_value double, transformed_se double"
ITEM_COLUMNS = ["question_id", "skill_id", "shrunk_item_shift", "item_shift_se", "eligible_item", "interaction_rows"]
BUNDLE = ["learner_splits", "selected_pairs", "selected_questions", "reference_interactions"]


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def require_columns(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    if missing_columns(df, columns) or (exact and list(columns) != df.columns):
        raise ValueError(f"expected columns {list(columns)}, found {df.columns}")
    return df


def write_parquet(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """zstd Parquet, sorted inside files when ``order`` is given; see ``write_ordered`` for a total order."""
    out = df.sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_ordered(df: DataFrame, path: str, order: Sequence[str]) -> DataFrame:
    """zstd Parquet in a total order: the rows of file after file, each in turn, are sorted by ``order``.

    Files hold ranges of the order and are numbered by it. Beside them, ``_manifest`` has
    per file its rows and first and last key; it is also returned."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").option("compression", "zstd").parquet(path)
    key = F.struct(*order)
    files = _numbered(df.sparkSession, path).groupBy("file_number").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    files.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return df.sparkSession.read.schema(files.schema).json(f"{path}/_manifest")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``file_number`` and ``file_row``, their place in the file."""
    number = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("int")
    return spark.read.parquet(path).select("*", number.alias("file_number"), F.col("_metadata.row_index").alias("file_row"))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``write_ordered`` with ``position``, their place in the order of files and rows."""
    rows = _numbered(spark, path)
    # One row per file.
    counts = rows.groupBy("file_number").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file_number", F.coalesce(before, F.lit(0)).alias("start"))
    joined = rows.join(F.broadcast(starts), "file_number")
    return joined.withColumn("position", F.col("start") + F.col("file_row")).drop("file_number", "file_row", "start")


def order_inversions(manifest: DataFrame) -> DataFrame:
    """(files, rows, inversions): files whose first key comes before the last key of the file before."""
    last = F.lag("last_key").over(Window.orderBy("file_number"))
    return manifest.withColumn("wrong", F.col("first_key") < last).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.count_if("wrong").alias("inversions"))


def write_one_csv(df: DataFrame, path: str) -> None:
    """A table that is one file by contract (question metadata) as CSV of that very name."""
    folder = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)
    spark = df.sparkSession
    source = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    part = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*"))[0].getPath()
    files.rename(part, spark._jvm.org.apache.hadoop.fs.Path(path))
    files.delete(source, True)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("overwrite").option("compression", "gzip").json(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Long skill-parameter CSV (other columns are ignored)."""
    raw = require_columns(spark.read.csv(path, header=True), ["skill_id", "parameter", "shrunk_value", "transformed_se"])
    typed = [F.col(f.split()[0]).cast(f.split()[1]) for f in PARAMETER_SCHEMA.split(", ")]
    return raw.select(*typed)


def read_item_effects(spark: SparkSession, path: str) -> DataFrame:
    raw = require_columns(spark.read.csv(path, header=True), ITEM_COLUMNS)
    return raw.select(
        "question_id", F.col("skill_id").cast("int"), F.col("shrunk_item_shift").cast("double"), F.col("item_shift_se").cast("double"),
        F.col("eligible_item").cast("boolean"), F.col("interaction_rows").cast("long"),
    )


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write the four bundle tables and a manifest with their row counts."""
    require = [n for n in BUNDLE if n not in tables]
    if require:
        raise ValueError(f"bundle lacks {require}")
    for name in BUNDLE:
        write_parquet(tables[name], f"{path}/{name}")
    spark = tables[BUNDLE[0]].sparkSession
    rows = [(n, spark.read.parquet(f"{path}/{n}").count()) for n in BUNDLE]
    manifest = spark.createDataFrame(rows, "table_name string, table_rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four bundle tables, after checking their row counts against the manifest."""
    manifest = {r.table_name: r.table_rows for r in spark.read.schema("table_name string, table_rows long").json(f"{path}/manifest").collect()}
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in BUNDLE}
    for name, df in tables.items():
        if manifest.get(name) != df.count():
            raise ValueError(f"{name}: row count differs from the manifest")
    return tables


def build_manifest(reference: DataFrame, pairs: DataFrame, items: DataFrame, splits: DataFrame) -> DataFrame:
    """Counts of one reference build in one row."""
    totals = reference.agg(F.count(F.lit(1)).alias("reference_rows"))
    pair_totals = pairs.agg(
        F.count(F.lit(1)).alias("selected_pairs"), F.sum("event_count").cast("long").alias("pair_events"),
        F.count_distinct("skill_id").alias("selected_skills"),
    )
    learners = splits.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_learners") for s in ("train", "calibration", "test")])
    counted = items.agg(F.count(F.lit(1)).alias("candidate_items"))
    # Four one-row tables.
    return totals.crossJoin(pair_totals).crossJoin(learners).crossJoin(counted)
