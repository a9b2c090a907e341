"""Contract checks, inventories and fingerprints as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import bins as B
from tracewell.functions.hashing import learner_split
from tracewell.operators import bkt, contracts
from tracewell.operators.skew import materialise
from tracewell.plans import views as V
from tracewell.plans.experiment_queries import _METRICS
from tracewell.plans.experiment_queries import SQL_VIEWS as CELL_VIEWS
from tracewell.plans.registry import register
from tracewell.plans.sql import query
from tracewell.sources import tables


def both(*bodies: str) -> str:
    """Checks in SQL over the reference rows ({t}) as built and with faults."""
    inputs = {"as built": "refint_v", "broken": "broken_v"}
    return query(" union all ".join(f"select '{name}' as input, * from ({body.format(t=t)})" for name, t in inputs.items() for body in bodies))


def row_checks(table: str, conditions: dict[str, str]) -> list[str]:
    """One body per check that counts the rows where the condition isn't true."""
    return [f"select '{name}' as check, count(*) filter (where ({ok}) is not true)::bigint as violations from {table}" for name, ok in conditions.items()]


def broken(rows):
    """Reference rows with one fault of each kind, to see that the checks find them."""
    c = F.col
    at, learner, index = c("sequence_index"), c("learner_id"), c("within_skill_index")
    kept = rows.where(~((learner % 5 == 0) & (index == 1)))
    return kept.withColumns(
        {
            "skill_id": F.when(learner % 17 == 0, 99).otherwise(c("skill_id")),
            "split": F.when((learner % 7 == 0) & (index == 1), "other").otherwise(c("split")),
            "sample_class": F.when(learner % 19 != 0, c("sample_class")),
            "gap_ms": F.when(at % 23 == 0, -1).when((learner % 3 == 0) & (index == 0), 5).otherwise(c("gap_ms")),
            "question_id": F.when(at % 13 == 0, "q99").otherwise(c("question_id")),
            "is_correct": F.when(at % 29 != 0, c("is_correct")),
            "quality_flags": F.when(at % 31 == 0, c("quality_flags").bitwiseOR(F.lit(1))).otherwise(c("quality_flags")),
        }
    )


class Bundle:
    def __init__(self, spark, sf):
        build = V.Build(spark, sf)
        self.build = build
        self.pairs = materialise(build.pairs)
        self.splits = V.event_rows(spark, sf).select("learner_id").distinct().withColumn("split", B.label(learner_split("learner_id"), B.SPLITS))
        kept = V.reference.selected_questions(build.sequences, build.selected_items)
        self.reference = materialise(V.reference.reference_interactions(kept, self.pairs))

    def check(self, check):
        """The check on the reference rows as built and with faults."""
        reports = [check(rows).select(F.lit(name).alias("input"), "*") for name, rows in (("as built", self.reference), ("broken", broken(self.reference)))]
        return contracts.combined(reports)


@register("a5_bundle_contracts", query("select (select count(*) from refint_v) as reference_rows, (select count(*) from pairs_v) as selected_pairs, (select sum(event_count)::bigint from pairs_v) as pair_events, (select count(distinct skill_id) from pairs_v) as selected_skills, (select count(*) from all_splits_v where split = 'train') as train_learners, (select count(*) from all_splits_v where split = 'calibration') as calibration_learners, (select count(*) from all_splits_v where split = 'test') as test_learners, (select count(*) from items_v) as candidate_items"))
def bundle_contracts(spark, sf):
    b = Bundle(spark, sf)
    return tables.build_manifest(b.reference, b.pairs, b.build.items, b.splits)


@register("a5_selected_questions", query("select question_id, bundle_id, correct_answer, part, skill_ids, skill_count, primary_skill_id from questions_v where question_id in (select question_id from selected_items_v)"))
def selected_questions(spark, sf):
    columns = ["question_id", "bundle_id", "correct_answer", "part", "skill_ids", "skill_count", "primary_skill_id"]
    return V.Build(spark, sf).selected_questions.select(*columns)


@register("c4_split_agreement", both("select 'split_agrees' as check, count(*) filter (where (r.split = s.split) is not true)::bigint as violations from (select distinct learner_id, skill_id, split from {t}) r left join all_splits_v s using (learner_id)"))
def split_agreement(spark, sf):
    b = Bundle(spark, sf)
    return b.check(lambda rows: contracts.split_agreement(rows.select(*contracts.PAIR, "split").distinct(), b.splits))


@register("c5_pair_keys_equal", both("select 'pair_keys' as check, ((select count(*) from (select learner_id, skill_id from pairs_v except select learner_id, skill_id from {t})) + (select count(*) from (select learner_id, skill_id from {t} except select learner_id, skill_id from pairs_v)))::bigint as violations"))
def pair_keys_equal(spark, sf):
    b = Bundle(spark, sf)
    return b.check(lambda rows: contracts.equal_keys(b.pairs, rows, contracts.PAIR, "pair_keys"))


@register("c9_question_membership", both("select 'question_selected' as check, count(*) as violations from {t} where question_id not in (select question_id from selected_items_v)"))
def question_membership(spark, sf):
    b = Bundle(spark, sf)
    return b.check(lambda rows: contracts.known_values(rows, "question_id", b.build.selected_items, "question_selected"))


@register("o2_row_counts", both("select 'pair_event_sum' as check, abs((select count(*) from {t}) - (select sum(event_count) from pairs_v))::bigint as violations"))
def row_counts(spark, sf):
    b = Bundle(spark, sf)
    return b.check(lambda rows: contracts.row_count(rows, F.sum("event_count"), b.pairs, "pair_event_sum"))


@register("o3_unique_keys", query("select 'event_key' as check, 0::bigint as violations union all select 'repeated_event', count(*) from (select 1 from raw_v group by learner_id, timestamp_ms, solving_id, question_id, user_answer, elapsed_time_ms having count(*) > 1)"))
def unique_keys(spark, sf):
    cleaned = materialise(V.cleaned(spark, sf))
    event = ["learner_id", "timestamp_ms", "solving_id", "question_id", "user_answer", "elapsed_time_ms"]
    return contracts.combined(
        [contracts.unique_key(cleaned, ["learner_id", "sequence_index"], "event_key"), contracts.unique_key(cleaned, event, "repeated_event")]
    )


@register("o4_reference_rows", both(*row_checks("{t}", {
    "no_excluded_flag": "quality_flags & 567 = 0", "no_negative_gap": "gap_ms >= 0", "first_gap_zero": "within_skill_index > 0 or gap_ms = 0",
    "split_known": "split in ('train', 'calibration', 'test')", "class_known": "sample_class in ('cold_1_2', 'repeat_3_plus')", "outcome_present": "is_correct is not null"})))
def reference_rows(spark, sf):
    return Bundle(spark, sf).check(contracts.reference_row_checks)


_SEQUENCES = """(select count(*) as n, list_sort(list(within_skill_index)) as i, count(distinct split) as splits, count(distinct sample_class) as classes, min(sample_class) as c
 from {t} group by learner_id, skill_id)"""


@register("o5_sequences", both(*row_checks(_SEQUENCES, {
    "index_from_zero": "i[1] = 0 and i[n] = n - 1", "index_sums": "i = range(n)", "split_constant": "splits = 1",
    "class_constant": "classes = 1", "class_matches_length": "c = case when n <= 2 then 'cold_1_2' else 'repeat_3_plus' end"})))
def sequences(spark, sf):
    return Bundle(spark, sf).check(contracts.sequence_checks)


@register("o6_known_labels", both("select 'skill_selected' as check, count(*) as violations from {t} where skill_id not in (select skill_id from selected_v)"))
def known_labels(spark, sf):
    b = Bundle(spark, sf)
    return b.check(lambda rows: contracts.known_values(rows, "skill_id", b.build.selected, "skill_selected"))


_RANGED = ["initial_latent", "delayed_expected", "delayed_observed"]
_CELL_CHECKS = (
    ["select 'one_row_per_cell' as check, count(*) filter (where n <> 1)::bigint as violations from (select count(*) as n from {t} group by world_model, policy, replicate, order_id)",
     "select 'cell_count' as check, abs(count(*) - 630)::bigint as violations from {t}"]
    + row_checks("{t}", {**{f"finite_{m}": f"isfinite({m})" for m in _METRICS}, **{f"range_{m}": f"{m} between -1e-12 and 1 + 1e-12" for m in _RANGED}})
)
_CELLS = {
    **CELL_VIEWS,
    "faulty_v": """
select world_model, policy, replicate, case when order_id = 2 and policy = 'p3' then 1 else order_id end as order_id, case when replicate = 5 then initial_latent + 2 else initial_latent end as initial_latent,
  case when replicate <> 7 then delayed_latent end as delayed_latent, delayed_expected, case when policy = 'p4' then -delayed_observed - 1 else delayed_observed end as delayed_observed,
  case when policy = 'p5' then 'Infinity'::double else practice_accuracy end as practice_accuracy from cell_v where not (replicate = 3 and policy = 'p2')""",
}


@register("o7_cell_completeness", query(" union all ".join(f"select '{name}' as input, * from ({body.format(t=t)})" for name, t in (("as built", "cell_v"), ("broken", "faulty_v")) for body in _CELL_CHECKS), **_CELLS))
def cell_completeness(spark, sf):
    keys, c = ["world_model", "policy", "replicate", "order_id"], F.col
    built = V.cells(spark, sf).select(*keys, *_METRICS)
    faulty = built.where(~((c("replicate") == 3) & (c("policy") == "p2"))).withColumns(
        {
            "order_id": F.when((c("order_id") == 2) & (c("policy") == "p3"), 1).otherwise(c("order_id")),
            "initial_latent": F.when(c("replicate") == 5, c("initial_latent") + 2).otherwise(c("initial_latent")),
            "delayed_latent": F.when(c("replicate") != 7, c("delayed_latent")),
            "delayed_observed": F.when(c("policy") == "p4", -c("delayed_observed") - 1).otherwise(c("delayed_observed")),
            "practice_accuracy": F.when(c("policy") == "p5", float("inf")).otherwise(c("practice_accuracy")),
        }
    )
    reports = [contracts.cell_checks(rows, keys, _METRICS, _RANGED, 3 * 7 * 10 * 3).select(F.lit(name).alias("input"), "*") for name, rows in (("as built", built), ("broken", materialise(faulty)))]
    return contracts.combined(reports)


_PIECES = """(select learner_id, skill_id, within_skill_index // 1024 as piece, list_sort(list(within_skill_index)) as i, list(gap_ms) as g, list(is_correct) as y
 from {t} group by 1, 2, 3)"""


@register("o8_sequence_pieces", both(*row_checks(_PIECES, {
    "piece_not_empty": "len(i) > 0", "piece_ordered": "i[-1] - i[1] = len(i) - 1",
    "gaps_present": "len(list_filter(g, lambda x: x is null or x < 0)) = 0", "outcomes_binary": "len(list_filter(y, lambda x: x is null)) = 0"})))
def sequence_pieces(spark, sf):
    return Bundle(spark, sf).check(lambda rows: contracts.piece_checks(bkt.sequence_pieces(rows, contracts.PAIR)))


@register("o9_shortfall_diagnostics", query("select t.skill_id, t.selection_tier, s.selection_rank is not null as selected, s.selection_rank from tiers_v t left join selected_v s using (skill_id)"))
def shortfall_diagnostics(spark, sf):
    build = V.Build(spark, sf)
    out = V.reference.skill_diagnostics(build.scored, materialise(build.selected))
    return out.select("skill_id", "selection_tier", "selected", "selection_rank")
