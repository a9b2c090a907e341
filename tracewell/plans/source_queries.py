"""Sources and sinks as queries: views of the shared tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import bayes, prepare
from tracewell.operators.skew import materialise, scratch_path
from tracewell.plans import views as V
from tracewell.plans.bayes_queries import bquery, transformed
from tracewell.plans.prepare_queries import R
from tracewell.plans.registry import register
from tracewell.plans.sql import query
from tracewell.sources import learner_files, logs, tables

FILE = ["timestamp", "solving_id", "question_id", "user_answer", "elapsed_time"]
# Small ranges, so that files are cut over tasks here, too.
RANGE_BYTES = 4096
LINES = {
    "lines_v": """
select learner_id, 'u' || learner_id || '.csv' as source_file, source_row, coalesce(timestamp_ms::varchar, '') as "timestamp", solving_id::varchar as solving_id,
  question_id, user_answer, elapsed_time_ms::varchar as elapsed_time from raw_v""",
    "fault_v": """
select *, case when learner_id % 7 = 0 then 'missing required columns elapsed_time'
  when learner_id % 11 = 0 then 'missing required columns timestamp, solving_id, question_id, user_answer, elapsed_time' end as error from lines_v""",
    "file_v": """
select learner_id, source_file, (length('timestamp,solving_id,question_id,user_answer,elapsed_time') + 1
  + sum(length("timestamp") + length(solving_id) + length(question_id) + length(user_answer) + length(elapsed_time) + 5))::bigint as bytes from lines_v group by 1, 2""",
}


def digest_sql(source: str, columns: dict[str, tuple[str, str]]) -> str:
    """(rows, digest) of ``source``; ``columns`` has each column's type and its value as text."""
    parts = " || ';' || ".join(
        f"coalesce('{name}:{kind}=' || length({text}) || ':' || {text}, '{name}:{kind}=~')" for name, (kind, text) in sorted(columns.items())
    )
    lanes = " || '-' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint)::varchar" for i in range(8))
    return f"select count(*) as rows, sha256({lanes}) as digest from (select sha256({parts}) as h from {source})"


EVENTS = {
    "event_id": ("bigint", "event_id::varchar"), "user_id": ("bigint", "user_id::varchar"), "ts": ("timestamp", "epoch_us(ts)::varchar"),
    "event_type": ("string", "event_type"), "value": ("double", "value::varchar"), "props": ("string", "props"),
}
INVENTORY = {"learner_id": ("bigint", "learner_id::varchar"), "source_file": ("string", "source_file"), "bytes": ("bigint", "bytes::varchar")}


def log_rows(spark, sf):
    return materialise(V.raw_responses(spark, sf)).select("learner_id", "source_row", *FILE)


def log_folder(spark, sf):
    path = scratch_path(spark)
    learner_files.write(log_rows(spark, sf), path)
    return path


def faulty_folder(spark, sf):
    """A folder in which some files lack a column and some the header."""
    path, rows = scratch_path(spark), log_rows(spark, sf)
    lacking, headless = F.col("learner_id") % 7 == 0, F.col("learner_id") % 11 == 0
    learner_files.write(rows.where(~lacking & ~headless), path)
    learner_files.write(rows.where(lacking).drop("elapsed_time"), path)
    learner_files.write(rows.where(~lacking & headless), path, header=False)
    return path


@register("a1_learner_files", query("select * from lines_v", **LINES))
def learner_file_rows(spark, sf):
    return learner_files.read(spark, log_folder(spark, sf), RANGE_BYTES)[0]


@register("a2_bad_files", query("select learner_id, source_file, case when error is null then count(*) else 0 end as raw_rows, error as file_error from fault_v group by learner_id, source_file, error", **LINES))
def bad_files(spark, sf):
    rows, errors = learner_files.read(spark, faulty_folder(spark, sf), RANGE_BYTES)
    good = rows.groupBy("learner_id", "source_file").agg(F.count(F.lit(1)).alias("raw_rows"), F.lit(None).cast("string").alias("file_error"))
    bad = errors.select("learner_id", "source_file", F.lit(0).cast("long").alias("raw_rows"), F.col("error").alias("file_error"))
    return good.unionByName(bad)


@register("a3_questions_file", query("select question_id, bundle_id, correct_answer, part, skill_ids, skill_count::integer as skill_count, primary_skill_id, deployed_at_ms from questions_v"))
def questions_file(spark, sf):
    path = scratch_path(spark)
    tables.write_one_csv(materialise(V.raw_questions(spark, sf)), f"{path}/contents/questions.csv")
    found = prepare.normalize_questions(logs.read_questions(spark, path))
    return found.select("question_id", "bundle_id", "correct_answer", F.col("part").cast("int").alias("part"), "skill_ids", F.col("skill_count").cast("int").alias("skill_count"), "primary_skill_id", "deployed_at_ms")


@register("a6_parameter_files", bquery("select skill_id, parameter, round(shrunk_value, 6) as shrunk_value, round(transformed_se, 6) as transformed_se from shrunk_v"))
def parameter_files(spark, sf):
    path, known = scratch_path(spark), transformed(spark, sf)
    tables.write_csv(bayes.shrink(known, bayes.hyperparameters(known)), path)
    read = tables.read_parameters(spark, path)
    return read.select("skill_id", "parameter", R("shrunk_value", 6).alias("shrunk_value"), R("transformed_se", 6).alias("transformed_se"))


@register("a6_item_effect_files", bquery("select question_id, skill_id, round(shrunk_item_shift, 7) as shrunk_item_shift, round(item_shift_se, 7) as item_shift_se, interaction_rows >= 20 as eligible_item, interaction_rows from effect_v"))
def item_effect_files(spark, sf):
    path = scratch_path(spark)
    marked = V.effects(spark, sf).withColumn("eligible_item", F.col("interaction_rows") >= 20)
    tables.write_csv(marked.select(*tables.ITEM_COLUMNS), path)
    read = tables.read_item_effects(spark, path)
    return read.withColumns({c: R(c, 7) for c in ("shrunk_item_shift", "item_shift_se")})


@register("a7_parquet_sink", query("select learner_id, sequence_index, timestamp_ms, question_id, is_correct, elapsed_time_ms, quality_flags from cleaned_v"))
def parquet_sink(spark, sf):
    path, columns = scratch_path(spark), ["learner_id", "sequence_index", "timestamp_ms", "question_id", "is_correct", "elapsed_time_ms", "quality_flags"]
    tables.write_parquet(V.cleaned(spark, sf), path, ["learner_id", "sequence_index"])
    return spark.read.parquet(path).select(*columns)


@register("a8_csv_sink", query("select learner_id, skill_id, event_count, correct_count, max_positive_gap_ms from groups_v"))
def csv_sink(spark, sf):
    path = scratch_path(spark)
    found = V.groups(spark, sf).select("learner_id", "skill_id", "event_count", "correct_count", "max_positive_gap_ms")
    tables.write_csv(found, path, gzip=True)
    return spark.read.schema(found.schema).csv(path, header=True)


@register("a9_error_sink", query("select distinct learner_id, source_file, 'read' as stage, error from fault_v where error is not null", **LINES))
def error_sink(spark, sf):
    path = scratch_path(spark)
    tables.write_errors(learner_files.read(spark, faulty_folder(spark, sf), RANGE_BYTES)[1], path)
    return spark.read.schema("learner_id long, source_file string, stage string, error string").json(path)


@register("a10_file_inventory", query(
    "select count(*) as learner_files, 0::bigint as unexpected_files, min(learner_id) as minimum_learner_id, max(learner_id) as maximum_learner_id, sum(bytes)::bigint as total_bytes,"
    f" count(*) - count(distinct learner_id) as duplicate_learner_ids, (select digest from ({digest_sql('file_v', INVENTORY)})) as fingerprint from file_v", **LINES))
def file_inventory(spark, sf):
    return logs.inventory_report(learner_files.inventory(spark, log_folder(spark, sf)))


@register("a12_data_fingerprint", digest_sql("events", EVENTS))
def data_fingerprint(spark, sf):
    return logs.data_fingerprint(V.table(spark, sf, "events"))


@register("f9_ordered_sink", query("select learner_id, sequence_index, row_number() over (order by learner_id, sequence_index) - 1 as position from cleaned_v"))
def ordered_sink(spark, sf):
    path = scratch_path(spark)
    tables.write_ordered(V.cleaned(spark, sf), path, ["learner_id", "sequence_index"])
    return tables.read_ordered(spark, path).select("learner_id", "sequence_index", "position")


@register("f9_order_manifest", query("select 0::bigint as inversions, count(*)::bigint as rows from cleaned_v"))
def order_manifest(spark, sf):
    manifest = tables.write_ordered(V.cleaned(spark, sf), scratch_path(spark), ["learner_id", "sequence_index"])
    return tables.order_inversions(manifest).select("inversions", "rows")


# Columns that stages need of the shared tables; the last of each is not among them.
REQUIRED = {"events": ["event_id", "user_id", "ts", "value", "props", "elapsed_time"], "lineitem": ["l_orderkey", "l_quantity", "l_reason"], "conversations": ["conv_id", "turn", "role", "text", "score"]}


@register("o1_required_columns", " union all ".join(
    f"select '{t}' as table_name, c as column_name, c in (select column_name from (describe select * from {t})) as present from (select unnest({cs}) as c)" for t, cs in REQUIRED.items()))
def required_columns(spark, sf):
    rows = [(t, c, c not in tables.missing_columns(V.table(spark, sf, t), cs)) for t, cs in REQUIRED.items() for c in cs]
    return spark.createDataFrame(rows, "table_name string, column_name string, present boolean")
