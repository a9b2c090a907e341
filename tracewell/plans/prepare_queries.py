"""Cleaning, scalar functions and hashing over the response log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import bins as B
from tracewell.functions import cleaning as C
from tracewell.functions import hashing as H
from tracewell.functions import numeric as N
from tracewell.operators import prepare, reference
from tracewell.operators.skew import lookup_join
from tracewell.plans import views as V
from tracewell.plans.registry import register
from tracewell.plans.sql import query, hash_steps

R = lambda c, d=9: N.round_half(F.col(c) if isinstance(c, str) else c, d)


@register("a4_projected_scan", query("select learner_id, question_id, is_correct from cleaned_v where is_correct"))
def projected_scan(spark, sf):
    return V.cleaned(spark, sf).where("is_correct").select("learner_id", "question_id", "is_correct")


@register(
    "a11_run_totals",
    query("""
select s as shard_id, count(*) as learner_rows, sum(n)::bigint as interaction_rows, 0::bigint as file_errors, 'COMPLETED' as status
from (select learner_id, learner_id // 100 as s, count(*) as n from raw_v group by 1, 2) group by rollup (s)"""),
)
def run_totals(spark, sf):
    summary = prepare.learner_summary(V.cleaned(spark, sf))
    return prepare.run_totals(summary.withColumn("shard_id", F.floor(F.col("learner_id") / 100)))


@register(
    "b1_parse_int",
    """select event_id, case when event_id % 7 = 0 then null when event_id % 7 = 1 then null when event_id % 7 = 2 then event_id
 when event_id % 7 = 3 then -event_id when event_id % 7 = 4 then event_id * 100 + 7 when event_id % 7 = 5 then null else event_id end as parsed from events""",
)
def parse_int(spark, sf):
    e = V.event_rows(spark, sf)
    digits = F.col("event_id").cast("string")
    way = F.col("event_id") % 7
    text = (
        F.when(way == 0, "  ")
        .when(way == 1, F.concat(digits, F.lit(".7")))
        .when(way == 2, F.concat(F.lit(" +"), digits, F.lit("\t")))
        .when(way == 3, F.concat(F.lit("-"), digits))
        .when(way == 4, F.concat(digits, F.lit("_07")))
        .when(way == 5, F.concat(digits, F.lit("_")))
        .otherwise(digits)
    )
    return e.select("event_id", C.parse_int(text).alias("parsed"))


@register("b2_normalize_answer", "select event_id, nullif(lower(trim(case when event_id % 5 = 0 then '  ' else ' '||event_type||' ' end)), '') as answer from events")
def normalize_answer(spark, sf):
    e = V.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")))
    return e.select("event_id", C.normalize_answer(text).alias("answer"))


@register(
    "b3_parse_tags",
    """select p_partkey, case p_partkey % 4 when 0 then '' when 1 then (p_size||'') when 2 then case when p_size = 7 then '7' else p_size||';7' end else p_size||'' end as skill_ids,
 case p_partkey % 4 when 0 then 0 when 1 then 1 when 2 then case when p_size = 7 then 1 else 2 end else 1 end as skill_count,
 case p_partkey % 4 when 0 then null when 1 then p_size when 2 then case when p_size = 7 then 7 end else p_size end::bigint as primary_skill_id from part""",
)
def parse_tags(spark, sf):
    size = F.col("p_size").cast("string")
    way = F.col("p_partkey") % 4
    text = (
        F.when(way == 0, "-1")
        .when(way == 1, F.concat(size, F.lit("; "), size))
        .when(way == 2, F.concat(size, F.lit(";x;-3; 7 ;"), size))
        .otherwise(F.concat(F.lit(" ;"), size, F.lit(";")))
    )
    tags = V.table(spark, sf, "part").select("p_partkey", C.tag_list(text).alias("tags"))
    return tags.select(
        "p_partkey", C.tag_text(F.col("tags")).alias("skill_ids"), F.size("tags").alias("skill_count"),
        C.only_tag(F.col("tags")).alias("primary_skill_id"),
    )


@register("b4_normalized_questions", query("select *, null::varchar as explanation_id from questions_v"))
def normalized_questions(spark, sf):
    return V.questions(spark, sf)


@register(
    "b5_question_report",
    query("""select 0::bigint as duplicate_ids, 0::bigint as invalid_ids, 0::bigint as invalid_answers, count(*) as question_rows, count(*) as unique_questions,
 count(*) filter (where skill_count = 0) as missing_skill_rows, count(*) filter (where deployed_at_ms is null) as missing_deployed_rows from questions_v"""),
)
def question_report(spark, sf):
    return prepare.question_report(V.questions(spark, sf))


@register("b6_correctness", query("select learner_id, source_row, is_correct from cleaned_v"))
def correctness(spark, sf):
    return V.cleaned(spark, sf).select("learner_id", "source_row", "is_correct")


@register("b7_cleaned_interactions", query("select * from cleaned_v"))
def cleaned_interactions(spark, sf):
    return V.cleaned(spark, sf)


@register(
    "b8_flag_names",
    query("""select learner_id, source_row, array_to_string(list_filter([case when quality_flags & 1 <> 0 then 'UNKNOWN_QUESTION' end, case when quality_flags & 2 <> 0 then 'MISSING_CORRECT_ANSWER' end,
 case when quality_flags & 4 <> 0 then 'MISSING_SKILL_TAG' end, case when quality_flags & 8 <> 0 then 'NON_MONOTONIC_INPUT' end, case when quality_flags & 16 <> 0 then 'DUPLICATE_EVENT' end,
 case when quality_flags & 32 <> 0 then 'INVALID_RESPONSE' end, case when quality_flags & 64 <> 0 then 'NEGATIVE_ELAPSED_TIME' end, case when quality_flags & 128 <> 0 then 'EXTREME_ELAPSED_TIME' end,
 case when quality_flags & 256 <> 0 then 'QUESTION_BEFORE_DEPLOYMENT' end, case when quality_flags & 512 <> 0 then 'INVALID_TIMESTAMP' end], lambda x: x is not null), ',') as names from cleaned_v"""),
)
def flag_names(spark, sf):
    names = F.array_join(C.flag_names(F.col("quality_flags")), ",")
    return V.cleaned(spark, sf).select("learner_id", "source_row", names.alias("names"))


@register("b9_usable_rows", query("select learner_id, sequence_index, question_id, primary_skill_id, is_correct, quality_flags from usable_v"))
def usable_rows(spark, sf):
    return V.usable(spark, sf).select(
        "learner_id", "sequence_index", "question_id", "primary_skill_id", "is_correct", "quality_flags"
    )


@register("b10_candidate_events", query("select learner_id, sequence_index, question_id, primary_skill_id as skill_id from usable_v where question_id in (select question_id from items_v)"))
def candidate_events(spark, sf):
    build = V.Build(spark, sf)
    events = reference.candidate_events(build.usable, build.items)
    return events.select("learner_id", "sequence_index", "question_id", "skill_id")


@register("c1_known_questions", query("select r.learner_id, r.source_row, r.question_id, q.skill_ids, q.question_id is not null as known from raw_v r left join questions_v q using (question_id)"))
def known_questions(spark, sf):
    q = V.questions(spark, sf).select("question_id", "skill_ids", F.lit(True).alias("known"))
    joined = lookup_join(V.raw_responses(spark, sf), q, ["question_id"], "left")
    return joined.select("learner_id", "source_row", "question_id", "skill_ids", F.coalesce("known", F.lit(False)).alias("known"))


@register(
    "d1_learner_summary",
    query("""select learner_id, min(source_file) as source_file, count(*) as raw_rows, count(*) as output_rows, count(is_correct) as valid_correctness_rows,
 count(*) filter (where is_correct) as correct_rows, min(timestamp_ms) as first_timestamp_ms, max(timestamp_ms) as last_timestamp_ms,
 count(*) filter (where quality_flags & 8 <> 0) as non_monotonic_count, count(*) filter (where quality_flags & 16 <> 0) as duplicate_count,
 count(*) filter (where quality_flags & 1 <> 0) as unknown_question_count, count(*) filter (where quality_flags & 32 <> 0) as invalid_response_count,
 count(*) filter (where quality_flags & 4 <> 0) as missing_skill_count, count(*) filter (where elapsed_time_ms < 0) as negative_elapsed_count,
 count(*) filter (where elapsed_time_ms > 300000) as extreme_elapsed_count, count(*) filter (where timestamp_ms < deployed_at_ms) as question_before_deployment_count,
 null::varchar as file_error from cleaned_v group by 1"""),
)
def learner_summary(spark, sf):
    return prepare.learner_summary(V.cleaned(spark, sf))


@register("e1_out_of_order", query("select learner_id, source_row, out_of_order from ordered_v"))
def out_of_order(spark, sf):
    return V.sequenced(spark, sf).select(
        "learner_id", "source_row", "out_of_order"
    )


@register("e2_repeated_events", query("select learner_id, source_row, is_repeat from ordered_v"))
def repeated_events(spark, sf):
    return V.sequenced(spark, sf).select(
        "learner_id", "source_row", "is_repeat"
    )


@register("e3_sequence_index", query("select learner_id, source_row, sequence_index from ordered_v"))
def sequence_index(spark, sf):
    return V.sequenced(spark, sf).select(
        "learner_id", "source_row", "sequence_index"
    )


@register("f1_avalanche_hash", query("select event_id, h::decimal(20,0) as h from event_hash_v", **hash_steps("events", "event_id::UBIGINT", "event_hash_v", "eh")))
def avalanche_hash(spark, sf):
    hashed = V.table(spark, sf, "events").select("event_id", H.splitmix64("event_id").alias("h"))
    return hashed.withColumn("h", H.unsigned_decimal(F.col("h")))


@register("f2_learner_split", query("select distinct learner_id, split_code from groups_v"))
def learner_split(spark, sf):
    learners = V.sequences(spark, sf).select("learner_id").distinct()
    return learners.withColumn("split_code", H.learner_split("learner_id"))


@register("f3_pair_priority", query("select learner_id, skill_id, h::decimal(20,0) as priority from all_prio_v", **hash_steps(
    "groups_v", "xor(xor(learner_id::UBIGINT, skill_id::UBIGINT << 32), xor((case when event_count >= 3 then 1 else 0 end)::UBIGINT << 60, 7822362180758744021::UBIGINT))", "all_prio_v", "ap")))
def pair_priority(spark, sf):
    coded = V.groups(spark, sf).withColumn("class_code", reference.class_code(F.col("event_count")))
    priority = H.sample_priority("learner_id", "skill_id", "class_code")
    hashed = coded.select("learner_id", "skill_id", priority.alias("priority"))
    return hashed.withColumn("priority", H.unsigned_decimal(F.col("priority")))


@register("f4_gap_priority", query("select learner_id, skill_id, within_skill_index, h::decimal(20,0) as priority from gap_prio_v"))
def gap_priority(spark, sf):
    gaps = reference.positive_gaps(V.sequences(spark, sf))
    priority = H.gap_priority("learner_id", "skill_id", "timestamp_ms")
    hashed = gaps.select("learner_id", "skill_id", "within_skill_index", priority.alias("priority"))
    return hashed.withColumn("priority", H.unsigned_decimal(F.col("priority")))


KEYED = {
    "ku_s": f"select *, ((((l_linenumber + 1)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT) % 18446744073709551616::UHUGEINT))::UBIGINT as s, ((((l_suppkey + 1)::UHUGEINT * {0xD2B74407B1CE6E93}::UHUGEINT) % 18446744073709551616::UHUGEINT))::UBIGINT as i from lineitem",
    "ku_0": f"select *, xor(xor(l_orderkey::UBIGINT, {((7 + 0x9E3779B97F4A7C15 * 6) & (2**64 - 1)) ^ ((4 * 0xBF58476D1CE4E5B9) & (2**64 - 1))}::UBIGINT), xor(s, i)) as x from ku_s",
    "ku_1": f"select *, ((xor(x, x >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT as y from ku_0",
    "ku_2": f"select *, ((xor(y, y >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT as z from ku_1",
}


@register("f10_keyed_uniform", query("select l_orderkey, l_linenumber, l_suppkey, (xor(z, z >> 31) >> 11)::double / 9007199254740992.0 as u from ku_2", **KEYED))
def keyed_uniform(spark, sf):
    lines = V.table(spark, sf, "lineitem")
    u = H.keyed_uniform(7, 5, "l_orderkey", 3, "l_linenumber", "l_suppkey")
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey", u.alias("u"))


@register(
    "h1_logit_expit",
    "select l_orderkey, l_linenumber, l_suppkey, l_partkey, round(ln(p/(1-p)), 9) as logit_p, round(1/(1+exp(-(l_quantity-25)/10)), 9) as expit_x from (select *, greatest(1e-10, least(1-1e-10, l_discount)) as p from lineitem)",
)
def logit_expit(spark, sf):
    lines = V.table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", R(N.logit(F.col("l_discount"))).alias("logit_p"),
        R(N.expit((F.col("l_quantity") - 25) / 10)).alias("expit_x"),
    )


@register("h2_bounded_sigmoid", "select event_id, round(0.49/(1+exp(-(value-30)/20)), 9) as emission from events")
def bounded_sigmoid(spark, sf):
    return V.table(spark, sf, "events").select("event_id", R(N.bounded_sigmoid((F.col("value") - 30) / 20)).alias("emission"))


@register("h3_half_life", "select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when l_tax > 0 then round(ln(2)/l_tax, 9) else 'Infinity'::double end as half_life from lineitem")
def half_life(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        F.when(F.col("l_tax") > 0, R(N.half_life(F.col("l_tax")))).otherwise(N.half_life(F.col("l_tax"))).alias("half_life"),
    )


@register("h4_entropy", "select l_orderkey, l_linenumber, l_suppkey, l_partkey, round(-(q*ln(q)+(1-q)*ln(1-q)), 9) as entropy from (select *, greatest(1e-10, least(1-1e-10, l_quantity/50)) as q from lineitem)")
def entropy(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", R(N.entropy(F.col("l_quantity") / 50)).alias("entropy")
    )


@register("h5_retention", query("select learner_id, skill_id, within_skill_index, round(exp(-0.02 * gap_ms / 86400000.0), 9) as retention from seq_v"))
def retention(spark, sf):
    days = F.col("gap_ms") / C.DAY_MS
    return V.sequences(spark, sf).select("learner_id", "skill_id", "within_skill_index", R(N.retention(F.lit(0.02), days)).alias("retention"))


_LEFT = "case " + " ".join(f"when gap_ms >= {low} then '{name}'" for name, low in reversed(B.GAP_BINS[1:])) + " when gap_ms > 0 then 'gt0_lt1min' end"
_RIGHT = "case when gap_ms <= 0 then 'first_or_zero' " + " ".join(
    f"when gap_ms <= {B.GAP_BINS[i + 1][1]} then '{B.GAP_BINS[i][0]}'" for i in range(len(B.GAP_BINS) - 1)
) + " else '30d_plus' end"


@register("h7_gap_bin_left_closed", query(f"select learner_id, skill_id, within_skill_index, {_LEFT} as gap_bin from seq_v"))
def gap_bin_left(spark, sf):
    return V.sequences(spark, sf).select("learner_id", "skill_id", "within_skill_index", B.gap_bin_left_closed(F.col("gap_ms")).alias("gap_bin"))


@register("h8_gap_bin_right_closed", query(f"select learner_id, skill_id, within_skill_index, {_RIGHT} as gap_bin from seq_v"))
def gap_bin_right(spark, sf):
    return V.sequences(spark, sf).select("learner_id", "skill_id", "within_skill_index", B.gap_bin_right_closed(F.col("gap_ms")).alias("gap_bin"))


@register("h11_question_number", query("select learner_id, source_row, substr(question_id, 2)::bigint as question_num from raw_v"))
def question_number(spark, sf):
    return V.raw_responses(spark, sf).select("learner_id", "source_row", C.question_number(F.col("question_id")).alias("question_num"))


@register("h13_text_digest", "select doc_id, sha256(text) as digest from documents")
def text_digest(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@register(
    "h14_days_and_bytes",
    query("""select learner_id, skill_id, within_skill_index, round(gap_ms / 86400000.0, 12) as gap_days,
 case when gap_ms < 1024 then format('{:.2f} B', gap_ms::double) when gap_ms < 1048576 then format('{:.2f} KiB', gap_ms / 1024.0)
 when gap_ms < 1073741824 then format('{:.2f} MiB', gap_ms / 1048576.0) when gap_ms < 1099511627776 then format('{:.2f} GiB', gap_ms / 1073741824.0) else format('{:.2f} TiB', gap_ms / 1099511627776.0) end as size_text from seq_v"""),
)
def days_and_bytes(spark, sf):
    return V.sequences(spark, sf).select(
        "learner_id", "skill_id", "within_skill_index", R(F.col("gap_ms") / C.DAY_MS, 12).alias("gap_days"),
        N.human_bytes(F.col("gap_ms")).alias("size_text"),
    )


@register("h15_practice_day", query("select learner_id, sequence_index, round(sequence_index // 10 + (sequence_index % 10) * 1.5 / 1440, 9) as practice_day from ordered_v"))
def practice_day(spark, sf):
    ordered = V.sequenced(spark, sf)
    return ordered.select("learner_id", "sequence_index", R(N.practice_day(F.col("sequence_index"), 10, 1.5)).alias("practice_day"))


@register(
    "h16_challenge_weight",
    """select l_orderkey, l_linenumber, l_suppkey, l_partkey, round(w, 9) as weight, round(1 - pow(1 - l_tax, 1.3 * w), 9) as learning
 from (select *, 0.2 + 0.8 * exp(-0.5 * pow((l_quantity/50 - 0.7)/0.15, 2)) as w from lineitem)""",
)
def challenge_weight(spark, sf):
    w = N.challenge_weight(F.col("l_quantity") / 50, 0.7, 0.15, 0.2)
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", R(w).alias("weight"),
        R(N.effective_learning(F.col("l_tax"), F.lit(1.3), w)).alias("learning"),
    )


@register("h17_code_labels", query("select learner_id, skill_id, case split_code when 0 then 'train' when 1 then 'calibration' else 'test' end as split, case when event_count >= 3 then 'repeat_3_plus' else 'cold_1_2' end as sample_class from groups_v"))
def code_labels(spark, sf):
    return V.groups(spark, sf).select(
        "learner_id", "skill_id", B.label(F.col("split_code"), B.SPLITS).alias("split"),
        B.label(reference.class_code(F.col("event_count")), B.CLASSES).alias("sample_class"),
    )
