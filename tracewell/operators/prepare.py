"""Raw responses -> validated, quality-flagged, sequenced interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import cleaning as C
from tracewell.operators.skew import hot_groups, lookup_join, prefix, split_hot

EVENT_KEY = ["timestamp_ms", "solving_id", "question_id", "user_answer", "elapsed_time_ms"]

# Learner summary counters and the quality bit each one counts.
COUNTERS = {
    "non_monotonic_count": "NON_MONOTONIC_INPUT",
    "duplicate_count": "DUPLICATE_EVENT",
    "unknown_question_count": "UNKNOWN_QUESTION",
    "invalid_response_count": "INVALID_RESPONSE",
    "missing_skill_count": "MISSING_SKILL_TAG",
    "negative_elapsed_count": "NEGATIVE_ELAPSED_TIME",
    "extreme_elapsed_count": "EXTREME_ELAPSED_TIME",
    "question_before_deployment_count": "QUESTION_BEFORE_DEPLOYMENT",
}


def normalize_questions(raw: DataFrame) -> DataFrame:
    """Question rows with parsed tags. Bad ids and answers are left for :func:`question_report`."""
    tags = C.tag_list(F.col("tags"))
    answer = C.normalize_answer(F.col("correct_answer"))
    deployed = C.parse_int(F.col("deployed_at"))
    return raw.withColumn("__tags", tags).select(
        C.trimmed(F.coalesce(F.col("question_id"), F.lit(""))).alias("question_id"),
        C.blank_to_null(F.col("bundle_id")).alias("bundle_id"),
        C.blank_to_null(F.col("explanation_id")).alias("explanation_id"),
        F.when(answer.isin(*C.VALID_ANSWERS), answer).alias("correct_answer"),
        C.parse_int(F.col("part")).cast("int").alias("part"),
        C.tag_text(F.col("__tags")).alias("skill_ids"),
        F.size("__tags").alias("skill_count"),
        C.only_tag(F.col("__tags")).cast("int").alias("primary_skill_id"),
        F.when(deployed >= 0, deployed).alias("deployed_at_ms"),
    )


def question_report(questions: DataFrame) -> DataFrame:
    """One row of counts; the first three must be zero before the questions may be used."""
    by_id = questions.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("correct_answer").isNull()).alias("bad_answer"),
        F.count_if(F.col("skill_count") == 0).alias("no_skill"),
        F.count_if(F.col("deployed_at_ms").isNull()).alias("no_deploy"),
    )
    valid = F.col("question_id").rlike(r"^q\d+$")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_id.agg(
        total(F.when(valid, F.col("n") - 1)).alias("duplicate_ids"),
        total(F.when(~valid, F.col("n"))).alias("invalid_ids"),
        total(F.when(valid, F.col("bad_answer"))).alias("invalid_answers"),
        total("n").alias("question_rows"),
        total(F.when(valid, 1)).alias("unique_questions"),
        total(F.when(valid, F.col("no_skill"))).alias("missing_skill_rows"),
        total(F.when(valid, F.col("no_deploy"))).alias("missing_deployed_rows"),
    )


def require_valid_questions(questions: DataFrame) -> DataFrame:
    """Raise on duplicate ids, bad ids or bad answers; otherwise return the input."""
    report = question_report(questions).first()
    problems = {k: report[k] for k in ("duplicate_ids", "invalid_ids", "invalid_answers") if report[k]}
    if problems or not report["unique_questions"]:
        raise ValueError(f"question metadata rejected: {problems or 'no valid questions'}")
    return questions


def parse_responses(raw: DataFrame) -> DataFrame:
    """String fields -> typed fields. Negative and unparsable timestamps become null."""
    ts = C.parse_int(F.col("timestamp"))
    elapsed = C.parse_int(F.col("elapsed_time"))
    filled = C.trimmed(F.coalesce(F.col("elapsed_time"), F.lit(""))) != ""
    return raw.select(
        "learner_id",
        "source_file",
        "source_row",
        F.when(ts >= 0, ts).alias("timestamp_ms"),
        C.parse_int(F.col("solving_id")).alias("solving_id"),
        C.trimmed(F.coalesce(F.col("question_id"), F.lit(""))).alias("question_id"),
        C.normalize_answer(F.col("user_answer")).alias("user_answer"),
        elapsed.alias("elapsed_time_ms"),
        (elapsed.isNull() & filled).alias("elapsed_unparsed"),
    )


def _flag_repeats(events: DataFrame, hot: tuple[list, int]) -> DataFrame:
    """``is_repeat``: an equal event (nulls equal) of the learner comes earlier in output order."""
    repeat = Window.partitionBy("learner_id", *EVENT_KEY).orderBy("source_row")
    if not hot[0]:
        return events.withColumn("is_repeat", F.row_number().over(repeat) > 1)
    # Copies of one event can fill a hot learner, so there the first row of each repeated
    # event is found with partial aggregation and joined back: copy groups too large for a
    # task are few enough to broadcast, the rest are shuffled by the event key.
    busy, calm = split_hot(events, ["learner_id"], hot[0])
    key = ["learner_id", *EVENT_KEY]
    renamed = [F.col(c).alias(f"__{c}") for c in key]
    firsts = busy.groupBy(*key).agg(F.min("source_row").alias("__first"), F.count(F.lit(1)).alias("__copies"))
    firsts = firsts.where(F.col("__copies") > 1).select(*renamed, "__first", "__copies")
    limit = F.lit(hot[1])

    def attach(df: DataFrame, lookup: DataFrame, name: str) -> DataFrame:
        same = F.lit(True)
        for c in key:
            same = same & df[c].eqNullSafe(lookup[f"__{c}"])
        joined = df.join(lookup, same, "left").withColumn(name, F.col("__first"))
        return joined.select(*df.columns, name)

    large = F.broadcast(firsts.where(F.col("__copies") > limit))
    marked = attach(busy, large, "__large_first")
    settled = marked.where(F.col("__large_first").isNotNull()).withColumn("__small_first", F.lit(None).cast("long"))
    pending = marked.where(F.col("__large_first").isNull())
    rest = attach(pending, firsts.where(F.col("__copies") <= limit), "__small_first")
    first = F.coalesce("__large_first", "__small_first")
    flagged = settled.unionByName(rest).withColumn("is_repeat", F.coalesce(F.col("source_row") > first, F.lit(False)))
    return calm.withColumn("is_repeat", F.row_number().over(repeat) > 1).unionByName(
        flagged.select(*events.columns, "is_repeat")
    )


def sequence_responses(parsed: DataFrame, hot: tuple[list, int] | None = None) -> DataFrame:
    """Add file-order monotonicity, output position and repeat flags.

    All windows partition by learner, so one exchange serves them all. ``hot`` is the result
    of ``hot_groups`` on learner_id when the caller already has it."""
    hot = hot if hot is not None else hot_groups(parsed, ["learner_id"])
    step = prefix(parsed, ["learner_id"], ["source_row"], lasts={"__previous": F.col("timestamp_ms")}, hot=hot)
    keyed = step.withColumns(
        {
            "out_of_order": F.coalesce(F.col("timestamp_ms") < F.col("__previous"), F.lit(False)),
            "__late": F.col("timestamp_ms").isNull().cast("int"),
            "__ts": F.coalesce("timestamp_ms", F.lit(0).cast("long")),
        }
    ).drop("__previous")
    placed = prefix(keyed, ["learner_id"], ["__late", "__ts", "source_row"], count="sequence_index", hot=hot)
    return _flag_repeats(placed.drop("__late", "__ts"), hot)


def interactions(
    raw: DataFrame, questions: DataFrame, extreme_elapsed_ms: int = 3_600_000, hot: tuple[list, int] | None = None
) -> DataFrame:
    """The full cleaning step: one output row per raw row, with the quality bit mask."""
    ordered = sequence_responses(parse_responses(raw), hot)
    columns = [
        "question_id", "bundle_id", "correct_answer", "part", "skill_ids", "skill_count",
        "primary_skill_id", "deployed_at_ms",
    ]
    lookup = questions.select(*columns, F.lit(True).alias("known"))
    joined = lookup_join(ordered, lookup, ["question_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    known, ts, answer = F.col("known"), F.col("timestamp_ms"), F.col("user_answer")
    elapsed = F.col("elapsed_time_ms")
    bad_answer = ~F.coalesce(answer.isin(*C.VALID_ANSWERS), F.lit(False))
    unscored = known & F.col("correct_answer").isNull()
    early = F.coalesce(ts < F.col("deployed_at_ms"), F.lit(False))
    flags = [
        C.bit("UNKNOWN_QUESTION", ~known),
        C.bit("MISSING_CORRECT_ANSWER", ~known | unscored),
        C.bit("MISSING_SKILL_TAG", ~known | (F.col("skill_count") == 0)),
        C.bit("NON_MONOTONIC_INPUT", F.col("out_of_order")),
        C.bit("DUPLICATE_EVENT", F.col("is_repeat")),
        C.bit("INVALID_RESPONSE", bad_answer & ~unscored),
        C.bit("NEGATIVE_ELAPSED_TIME", elapsed < 0),
        C.bit("EXTREME_ELAPSED_TIME", elapsed > extreme_elapsed_ms),
        C.bit("QUESTION_BEFORE_DEPLOYMENT", early),
        C.bit("INVALID_TIMESTAMP", ts.isNull()),
        C.bit("INVALID_SOLVING_ID", F.col("solving_id").isNull()),
        C.bit("INVALID_ELAPSED_TIME", F.col("elapsed_unparsed")),
    ]
    mask = flags[0]
    for flag in flags[1:]:
        mask = mask + flag
    return joined.select(
        "learner_id",
        "sequence_index",
        "timestamp_ms",
        "solving_id",
        F.nullif(F.col("question_id"), F.lit("")).alias("question_id"),
        "bundle_id",
        "user_answer",
        "correct_answer",
        C.is_correct(known, F.col("correct_answer"), answer).alias("is_correct"),
        "elapsed_time_ms",
        "part",
        F.coalesce("skill_ids", F.lit("")).alias("skill_ids"),
        F.coalesce("skill_count", F.lit(0)).alias("skill_count"),
        "primary_skill_id",
        "deployed_at_ms",
        "source_file",
        "source_row",
        mask.alias("quality_flags"),
    )


def learner_summary(cleaned: DataFrame) -> DataFrame:
    """Per-learner totals and flag counters."""
    flags = F.col("quality_flags")
    counters = [F.count_if(C.has_bit(flags, b)).alias(n) for n, b in COUNTERS.items()]
    return cleaned.groupBy("learner_id").agg(
        F.min("source_file").alias("source_file"),
        F.count(F.lit(1)).alias("raw_rows"),
        F.count(F.lit(1)).alias("output_rows"),
        F.count("is_correct").alias("valid_correctness_rows"),
        F.count_if("is_correct").alias("correct_rows"),
        F.min("timestamp_ms").alias("first_timestamp_ms"),
        F.max("timestamp_ms").alias("last_timestamp_ms"),
        *counters,
        F.lit(None).cast("string").alias("file_error"),
    )


def _zero_rows(summary: DataFrame, learners: DataFrame, error: Column) -> DataFrame:
    """A summary row per learner (learner_id, source_file) whose counters are all zero."""
    zeros = {f.name: F.lit(0).cast(f.dataType) for f in summary.schema if f.name.endswith(("_rows", "_count"))}
    columns = {
        **{n: F.col(n) for n in ("learner_id", "source_file")},
        **zeros,
        "first_timestamp_ms": F.lit(None).cast("long"),
        "last_timestamp_ms": F.lit(None).cast("long"),
        "file_error": error.cast("string"),
    }
    return learners.select(*[c.alias(n) for n, c in columns.items()])


def add_failed_learners(summary: DataFrame, errors: DataFrame) -> DataFrame:
    """Append an all-zero summary row per unreadable file (learner_id, source_file, error)."""
    return summary.unionByName(_zero_rows(summary, errors, F.col("error")))


def add_silent_learners(summary: DataFrame, inventory: DataFrame) -> DataFrame:
    """Append an all-zero row, without an error, per learner file that has no response."""
    files = inventory.where(F.col("learner_id").isNotNull()).select("learner_id", F.concat(F.lit("u"), "learner_id", F.lit(".csv")).alias("source_file"))
    silent = files.join(summary.select("learner_id").distinct(), "learner_id", "left_anti")
    return summary.unionByName(_zero_rows(summary, silent, F.lit(None)))


def run_totals(summary: DataFrame, shard: str = "shard_id") -> DataFrame:
    """Row, learner and error totals per shard and overall (null shard), with the run status."""
    failed = F.count_if(F.col("file_error").isNotNull())
    totals = summary.rollup(shard).agg(
        F.count(F.lit(1)).alias("learner_rows"),
        F.sum("output_rows").cast("long").alias("interaction_rows"),
        failed.alias("file_errors"),
    )
    status = F.when(F.col("file_errors") > 0, "COMPLETED_WITH_FILE_ERRORS").otherwise("COMPLETED")
    return totals.withColumn("status", status)
