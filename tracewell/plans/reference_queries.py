"""Reference-build statistics, samples and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import bins as B
from tracewell.operators import reference
from tracewell.operators.skew import materialise
from tracewell.plans import views as V
from tracewell.plans.prepare_queries import _LEFT, R
from tracewell.plans.registry import register
from tracewell.plans.sql import query


@register("c2_items_of_candidate_skills", query("select question_id, skill_id, part, interaction_rows, correct_rows, round(accuracy, 9) as accuracy from items_v"))
def items_of_candidate_skills(spark, sf):
    return V.Build(spark, sf).items.withColumn("accuracy", R("accuracy"))


@register("c3_reference_interactions", query("select * from refint_v"))
def reference_interactions(spark, sf):
    return V.Build(spark, sf).reference_interactions


@register("d2_item_counts", query("select * from item_counts_v"))
def item_counts(spark, sf):
    return reference.item_counts(V.usable(spark, sf))


@register("d3_candidate_skills", query("select skill_id, count(*) as eligible_items from items_v group by 1"))
def candidate_skills(spark, sf):
    build = V.Build(spark, sf)
    skills = reference.candidate_skills(reference.eligible_items(build.counts, build.questions, build.config), build.config)
    return reference.require_enough_skills(skills, build.config)


@register("d4_learner_skill_groups", query("select * from groups_v"))
def learner_skill_groups(spark, sf):
    return V.groups(spark, sf)


@register("d5_skill_statistics", query("select * replace (round(accuracy, 9) as accuracy) from stats_v"))
def skill_statistics(spark, sf):
    return reference.skill_statistics(V.groups(spark, sf)).withColumn("accuracy", R("accuracy"))


@register(
    "d6_gap_histogram",
    query(f"""select g.skill_id, g.gap_bin, count(s.gap_ms) as gap_count
 from (select distinct skill_id, unnest({[n for n, _ in B.GAP_BINS]}) as gap_bin from items_v) g
 left join (select *, {_LEFT} as gap_bin from posgap_v) s on s.skill_id = g.skill_id and s.gap_bin = g.gap_bin group by 1, 2"""),
)
def gap_histogram(spark, sf):
    build = V.Build(spark, sf)
    return reference.gap_histogram(build.sequences, build.items.select("skill_id").distinct())


_P = "item_accuracy_p"


@register("d7_item_accuracy_distribution", query(f"select * replace (round({_P}10, 9) as {_P}10, round({_P}50, 9) as {_P}50, round({_P}90, 9) as {_P}90, round({_P}90_p10_spread, 9) as {_P}90_p10_spread) from dist_v"))
def item_accuracy_distribution(spark, sf):
    d = reference.item_distribution(V.Build(spark, sf).items)
    return d.withColumns({c: R(c) for c in d.columns if c.startswith(_P)})


def _gap_quantiles(spark, sf):
    sample = reference.gap_sample(V.sequences(spark, sf), F.floor(F.col("learner_id") / 10), reference.SMALL_CONFIG)
    return reference.gap_quantiles(materialise(sample))


@register("d8_gap_quantiles", query("select skill_id, probability, round(gap_ms, 3) as gap_ms, sample_size from gap_quantiles_v"))
def gap_quantiles(spark, sf):
    return _gap_quantiles(spark, sf).withColumn("gap_ms", R("gap_ms", 3))


@register(
    "d9_pair_summary",
    query("""select g.skill_id, g.split, g.sample_class, g.quota, count(p.learner_id) as pairs, coalesce(sum(p.event_count), 0)::bigint as events
 from (select skill_id, s.split, c.sample_class, case when c.sample_class = 'cold_1_2' then 500 when s.split = 'train' then 5000 else 2000 end as quota
  from selected_v, (select unnest(['train','calibration','test']) as split) s, (select unnest(['cold_1_2','repeat_3_plus']) as sample_class) c) g
 left join pairs_v p using (skill_id, split, sample_class) group by 1, 2, 3, 4"""),
)
def pair_summary(spark, sf):
    build = V.Build(spark, sf)
    return reference.pair_summary(build.pairs, build.selected, reference.SMALL_CONFIG)


@register(
    "d10_split_counts",
    query("""select coalesce(split, 'all') as split, count(*) as learners, min(learner_id) as min_learner_id, max(learner_id) as max_learner_id
 from all_splits_v group by rollup (split)"""),
)
def split_counts(spark, sf):
    """Every learner of the log, with or without usable rows."""
    return reference.split_counts(V.event_rows(spark, sf))


@register(
    "d13_retention_support",
    query("""select skill_id, round(max(d) filter (where probability = 0.9), 9) as q90_gap_days, round(max(d) filter (where probability = 0.95), 9) as q95_gap_days, round(max(d) filter (where probability = 0.99), 9) as q99_gap_days,
 max(d) filter (where probability = 0.9) < 30 as q90_below_30d, max(d) filter (where probability = 0.95) < 30 as q95_below_30d, max(d) filter (where probability = 0.99) < 30 as q99_below_30d
 from (select *, gap_ms / 86400000.0 as d from gap_quantiles_v) group by 1"""),
)
def retention_support(spark, sf):
    s = reference.retention_support(_gap_quantiles(spark, sf))
    return s.withColumns({c: R(c) for c in s.columns if c.endswith("_days")})


@register(
    "d13_retention_support_summary",
    query("""select count(*) as n_skills, count(*) filter (where a < 30) as skills_q90_below_30d, count(*) filter (where b < 30) as skills_q95_below_30d, count(*) filter (where c < 30) as skills_q99_below_30d
 from (select skill_id, max(gap_ms / 86400000.0) filter (where probability = 0.9) as a, max(gap_ms / 86400000.0) filter (where probability = 0.95) as b, max(gap_ms / 86400000.0) filter (where probability = 0.99) as c from gap_quantiles_v group by 1)"""),
)
def retention_support_summary(spark, sf):
    return reference.retention_support_summary(reference.retention_support(_gap_quantiles(spark, sf)))


@register(
    "d20_sequence_summary",
    query("""select split, coalesce(sample_class, 'all') as sample_class, count(*) as n_sequences, sum(event_count)::bigint as n_events, max(event_count) as max_length
 from (select case split_code when 0 then 'train' when 1 then 'calibration' else 'test' end as split, case when event_count >= 3 then 'repeat_3_plus' else 'cold_1_2' end as sample_class, event_count from groups_v)
 group by grouping sets ((split, sample_class), (split))"""),
)
def sequence_summary(spark, sf):
    return reference.sequence_summary(V.groups(spark, sf))


@register("e4_within_skill_index", query("select learner_id, skill_id, sequence_index, within_skill_index from seq_v"))
def within_skill_index(spark, sf):
    return V.sequences(spark, sf).select("learner_id", "skill_id", "sequence_index", "within_skill_index")


@register("e5_event_gap", query("select learner_id, skill_id, sequence_index, gap_ms from seq_v"))
def event_gap(spark, sf):
    return V.sequences(spark, sf).select("learner_id", "skill_id", "sequence_index", "gap_ms")


@register("e6_positive_gaps", query("select learner_id, skill_id, sequence_index, timestamp_ms, gap_ms from posgap_v"))
def positive_gaps(spark, sf):
    return reference.positive_gaps(V.sequences(spark, sf)).select("learner_id", "skill_id", "sequence_index", "timestamp_ms", "gap_ms")


@register("f5_stratified_pairs", query("select * from pairs_v"))
def stratified_pairs(spark, sf):
    return V.Build(spark, sf).pairs


@register("f6_gap_sample", query("select skill_id, learner_id, timestamp_ms, gap_ms from gap_sample_v"))
def gap_sample(spark, sf):
    sample = reference.gap_sample(V.sequences(spark, sf), F.floor(F.col("learner_id") / 10), reference.SMALL_CONFIG)
    return sample.select("skill_id", "learner_id", "timestamp_ms", "gap_ms")


@register("f7_top_skills", query("select skill_id, round(selection_score, 9) as selection_score, selection_rank from selected_v"))
def top_skills(spark, sf):
    return V.Build(spark, sf).selected.withColumn("selection_score", R("selection_score"))


@register("f8_evenly_spaced_sample", """select o_orderkey, o_totalprice from (select *, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders)
 where pos in (select round_even(i * (n - 1) / 100.0, 0) from range(101) t(i), (select count(*) as n from orders))""")
def evenly_spaced_sample(spark, sf):
    return reference.evenly_spaced(V.table(spark, sf, "orders"), ["o_orderkey"], 101).select("o_orderkey", "o_totalprice")


@register("h6_selection_score", query("select t.skill_id, round(s.selection_score, 9) as selection_score from tiers_v t left join scores_v s using (skill_id)"))
def selection_score(spark, sf):
    scored = V.Build(spark, sf).scored
    return scored.select("skill_id", R("selection_score").alias("selection_score"))


@register("h9_skill_tiers", query("select skill_id, strict_eligible, relaxed_eligible, selection_tier from tiers_v"))
def skill_tiers(spark, sf):
    return V.Build(spark, sf).tiers.select("skill_id", "strict_eligible", "relaxed_eligible", "selection_tier")


@register("g1_union_of_parts", query("select skill_id, count(*) as events, count(distinct learner_id) as learners from seq_v group by 1"))
def union_of_parts(spark, sf):
    """Per-split parts united again give the same totals as the whole."""
    from tracewell.functions.hashing import learner_split

    coded = V.sequences(spark, sf).withColumn("split_code", learner_split("learner_id"))
    parts = [coded.where(F.col("split_code") == i).drop("split_code") for i in range(3)]
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    pairs = united.groupBy("skill_id", "learner_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("skill_id").agg(F.sum("n").cast("long").alias("events"), F.count(F.lit(1)).alias("learners"))
