"""Question metadata, and reports on inventories and tables; learner logs are in ``learner_files``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: required columns.
QUESTION_COLUMNS = ["question_id", "bundle_id", "explanation_id", "correct_answer", "part", "tags", "deployed_at"]


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Raw question metadata from the only ``questions.csv`` at or under ``path``."""
    reader = {"recursiveFileLookup": True, "pathGlobFilter": "[qQ]uestions.csv"}
    found = spark.read.format("binaryFile").options(**reader).load(path).select("path")
    found = [r.path for r in found.where(~F.contains("path", F.lit("__MACOSX"))).limit(2).collect()]
    if len(found) != 1:
        raise ValueError("expected exactly one questions.csv")
    raw = spark.read.csv(found[0], header=True, multiLine=False)
    absent = [c for c in QUESTION_COLUMNS if c not in raw.columns]
    if absent:
        raise ValueError(f"questions.csv lacks columns {absent}")
    return raw.select(*QUESTION_COLUMNS)


_LANES = [f"lane{i}" for i in range(8)]


def _canonical(df: DataFrame) -> Column:
    """Every column of a row by name, type and value, in the order of names; times as microseconds."""
    parts = []
    for field in sorted(df.schema.fields, key=lambda f: f.name):
        kind, value = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind.startswith("timestamp"):
            kind, value = "timestamp", _micros(value)
        elif kind.startswith(("array", "map", "struct")):
            value = F.to_json(value)
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.lit(f"{field.name}:{kind}="), F.length(text).cast("string"), F.lit(":"), text), F.lit(f"{field.name}:{kind}=~")))
    return F.concat_ws(";", *parts)


def _micros(value: Column) -> Column:
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", epoch, value.cast("timestamp_ntz"))


def digest_state(df: DataFrame) -> DataFrame:
    """rows and eight lanes of the multiset of ``df``'s rows: sums of the words of each row's SHA-256.

    States of parts of a table add up (``merged_state``), and a row can be added or taken out
    without the others, so no order and no collection of rows is needed."""
    row = df.select(F.sha2(_canonical(df), 256).alias("row"))
    words = [F.sum(F.conv(F.substring("row", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]
    return row.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(w, F.lit(0)).cast("decimal(38,0)").alias(n) for w, n in zip(words, _LANES)])


def merged_state(states: DataFrame) -> DataFrame:
    return states.agg(F.sum("rows").alias("rows"), *[F.sum(n).cast("decimal(38,0)").alias(n) for n in _LANES])


def digest(state: DataFrame) -> DataFrame:
    """(rows, digest) of a state."""
    return state.select("rows", F.sha2(F.concat_ws("-", *[F.col(n).cast("string") for n in _LANES]), 256).alias("digest"))


def inventory_report(inventory: DataFrame) -> DataFrame:
    """Totals, id range, unexpected names and duplicate ids of an inventory, with its fingerprint."""
    known = F.col("learner_id").isNotNull()
    totals = inventory.agg(
        F.count_if(known).alias("learner_files"),
        F.count_if(~known).alias("unexpected_files"),
        F.min("learner_id").alias("minimum_learner_id"),
        F.max("learner_id").alias("maximum_learner_id"),
        F.sum(F.when(known, F.col("bytes"))).alias("total_bytes"),
    )
    repeated = inventory.where(known).groupBy("learner_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    duplicates = repeated.agg(F.count(F.lit(1)).alias("duplicate_learner_ids"))
    fingerprint = digest(digest_state(inventory)).select(F.col("digest").alias("fingerprint"))
    # Three one-row tables.
    return totals.crossJoin(F.broadcast(duplicates)).crossJoin(F.broadcast(fingerprint))


def require_clean_inventory(inventory: DataFrame) -> DataFrame:
    report = inventory_report(inventory).first()
    if not report["learner_files"] or report["unexpected_files"] or report["duplicate_learner_ids"]:
        raise ValueError(f"learner log folder rejected: {report.asDict()}")
    return inventory


def data_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): a fingerprint of the table's rows that doesn't depend on their order."""
    return digest(digest_state(df))
