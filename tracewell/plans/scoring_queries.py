"""Next-item scoring over the belief table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import scoring as S
from tracewell.operators.skew import materialise
from tracewell.plans import views as V
from tracewell.plans.model_queries import RECURSIVE, rounded
from tracewell.plans.prepare_queries import R
from tracewell.plans.registry import register
from tracewell.plans.sql import query

_H = "(-(greatest(1e-10, least(1 - 1e-10, {p})) * ln(greatest(1e-10, least(1 - 1e-10, {p}))) + (1 - greatest(1e-10, least(1 - 1e-10, {p}))) * ln(1 - greatest(1e-10, least(1 - 1e-10, {p})))))"


def h_sql(p: str) -> str:
    return _H.format(p=f"({p})")


def info_sql(p0: str, p1: str) -> str:
    p = f"({p0} + belief * ({p1} - {p0}))"
    return f"greatest(0, {h_sql('belief')} - ({p} * {h_sql(f'belief * {p1} / {p}')} + (1 - {p}) * {h_sql(f'belief * (1 - {p1}) / (1 - {p})')}))"


def ends_sql(strength: float) -> tuple[str, str]:
    return f"1 / (1 + exp(-(ln(0.25::double) + shift * {strength})))", f"1 / (1 + exp(-(ln(9.0::double) + shift * {strength})))"


_LO, _HI, _ONE = ends_sql(0.75), ends_sql(1.25), ends_sql(1.0)
SQL_VIEWS = {
    **RECURSIVE,
    "belief_v": """
select learner_id, skill_id, arg_max(state, i) as belief, count(*) as practice_count, max(timestamp_ms) as last_practised_ms
from rec_v join (select learner_id, skill_id, within_skill_index as i, timestamp_ms from seq_v) using (learner_id, skill_id, i) where model = 'BKT-F' group by 1, 2""",
    "aged_v": "select * replace (belief * exp(-0.02 * (1735689600000 - last_practised_ms) / 86400000.0) as belief), (1735689600000 - last_practised_ms) / 86400000.0 as idle_days from belief_v",
    "bin_v": f"select skill_id, item_bin, shift, {_ONE[0]} as p0, {_ONE[1]} as p1, {_LO[0]} as p0_lo, {_LO[1]} as p1_lo, {_HI[0]} as p0_hi, {_HI[1]} as p1_hi from (select k::integer as skill_id, b::integer as item_bin, (b - 4) / 4.0::double + k * 0.01::double as shift from range(5) k(k), range(9) b(b))",
    "pred_v": "select a.*, b.* exclude (skill_id), p0 + belief * (p1 - p0) as predicted from aged_v a join bin_v b using (skill_id)",
    "mi_v": f"select learner_id, skill_id, item_bin, {info_sql('p0', 'p1')} as information, least({info_sql('p0_lo', 'p1_lo')}, {info_sql('p0_hi', 'p1_hi')}) as robust from pred_v",
    "target_v": "select learner_id, skill_id, belief, idle_days, practice_count, arg_min(item_bin, (abs(predicted - 0.7), item_bin)) as item_bin, min(abs(predicted - 0.7)) as distance from pred_v group by all",
}


def squery(body: str, **local: str) -> str:
    return query(body, recursive=True, **{**SQL_VIEWS, **local})


def aged(spark, sf):
    return S.decay_beliefs(V.beliefs(spark, sf), F.lit(V.NOW_MS))


def scored(spark, sf):
    """Aged beliefs with each skill's item bins."""
    return S.with_bins(aged(spark, sf), S.item_endpoints(V.item_bins(spark, sf)))


def robust_scored(spark, sf):
    columns = ("p0", "p1", "p0_lo", "p1_lo", "p0_hi", "p1_hi")
    return S.with_bins(aged(spark, sf), S.robust_bins(V.item_bins(spark, sf)), columns)


def per_bin(df):
    return df.withColumn("e", F.explode("bins")).select("*", "e.*").drop("bins", "e")


def _chosen(cost: str, ties: str = "skill_id") -> str:
    return f"qualify row_number() over (partition by learner_id order by {cost}, {ties}) = 1"


@register("h10_item_endpoints", squery("select skill_id, item_bin, round(p0, 9) as p0, round(p1, 9) as p1 from bin_v where skill_id in (select skill_id from belief_v)"))
def item_endpoints(spark, sf):
    bins = S.item_endpoints(V.item_bins(spark, sf))
    seen = V.sequences(spark, sf).select("skill_id").distinct()
    return bins.join(seen, "skill_id", "left_semi").select("skill_id", "item_bin", R("p0").alias("p0"), R("p1").alias("p1"))


@register("l1_decayed_beliefs", squery("select learner_id, skill_id, round(belief, 9) as belief, round(idle_days, 9) as idle_days from aged_v"))
def decayed_beliefs(spark, sf):
    return rounded(aged(spark, sf).select("learner_id", "skill_id", "belief", "idle_days"), digits=9)


@register("l2_predicted_success", squery("select learner_id, skill_id, item_bin, round(predicted, 9) as predicted from pred_v"))
def predicted_success(spark, sf):
    rows = per_bin(scored(spark, sf))
    p = S.predicted_success(F.col("belief"), F.col("p0"), F.col("p1"))
    return rows.select("learner_id", "skill_id", "item_bin", R(p).alias("predicted"))


@register("l3_updated_belief", squery("select learner_id, skill_id, item_bin, round(0.1 + 0.9 * belief * p1 / predicted, 9) as after_correct, round(0.1 + 0.9 * belief * (1 - p1) / (1 - predicted), 9) as after_wrong from pred_v"))
def updated_belief(spark, sf):
    b, p0, p1, learn = F.col("belief"), F.col("p0"), F.col("p1"), F.lit(0.1)
    return per_bin(scored(spark, sf)).select(
        "learner_id", "skill_id", "item_bin",
        R(S.updated_belief(b, p0, p1, F.lit(True), learn)).alias("after_correct"),
        R(S.updated_belief(b, p0, p1, F.lit(False), learn)).alias("after_wrong"),
    )


@register("l4_response_information", squery("select learner_id, skill_id, item_bin, round(information, 9) as information from mi_v"))
def response_information(spark, sf):
    value = S.response_information(F.col("belief"), F.col("p0"), F.col("p1"))
    return per_bin(scored(spark, sf)).select("learner_id", "skill_id", "item_bin", R(value).alias("information"))


@register("l5_robust_information", squery("select learner_id, skill_id, item_bin, round(robust, 9) as robust from mi_v"))
def robust_information(spark, sf):
    low, high = (F.col("p0_lo"), F.col("p1_lo")), (F.col("p0_hi"), F.col("p1_hi"))
    value = S.robust_information(F.col("belief"), low, high)
    return per_bin(robust_scored(spark, sf)).select("learner_id", "skill_id", "item_bin", R(value).alias("robust"))


def shown(df):
    return df.withColumn("cost", R("cost", 8))


@register("l6_least_mastery", squery(f"select learner_id, skill_id, item_bin, round(belief, 8) as cost from target_v {_chosen('belief')}"))
def least_mastery(spark, sf):
    return shown(S.least_mastery(scored(spark, sf)))


@register("l7_maximum_uncertainty", squery(f"select learner_id, skill_id, 4 as item_bin, round(-(belief * (1 - belief)), 8) as cost from aged_v {_chosen('-(belief * (1 - belief))')}"))
def maximum_uncertainty(spark, sf):
    return shown(S.maximum_uncertainty(scored(spark, sf)))


@register("l8_nearest_target", squery(f"select learner_id, skill_id, item_bin, round(distance, 8) as cost from target_v {_chosen('distance')}"))
def nearest_target(spark, sf):
    return shown(S.nearest_target(scored(spark, sf)))


_SCORE = "-((1 - belief) + 0.25 * belief * (1 - belief) + 0.18 * idle_days / (1 + idle_days) + 0.12 * (practice_count = 0)::integer - 0.015 * practice_count + 0.2 * (belief < 0.9)::integer)"


@register("l9_balanced_mastery", squery(f"select learner_id, skill_id, item_bin, round({_SCORE}, 8)::double as cost from target_v {_chosen(_SCORE)}"))
def balanced_mastery(spark, sf):
    return shown(S.balanced_mastery(scored(spark, sf)))


@register("l10_maximum_information", squery(f"select learner_id, skill_id, item_bin, round(-information, 8) as cost from mi_v {_chosen('-information', 'skill_id, item_bin')}"))
def maximum_information(spark, sf):
    return shown(S.maximum_information(scored(spark, sf)))


@register("l10_maximum_robust_information", squery(f"select learner_id, skill_id, item_bin, round(-robust, 8) as cost from mi_v {_chosen('-robust', 'skill_id, item_bin')}"))
def maximum_robust_information(spark, sf):
    return shown(S.maximum_information(robust_scored(spark, sf), robust=True))


@register("l11_curriculum_ties", squery("select learner_id, skill_id, item_bin, round(c, 8) as cost from (select *, round(belief, 1) as c from target_v) qualify row_number() over (partition by learner_id order by c, -skill_id) = 1"))
def curriculum_ties(spark, sf):
    rows = materialise(scored(spark, sf))
    order = rows.select("skill_id").distinct().withColumn("position", -F.col("skill_id"))
    return shown(S.recommend(rows, F.round("belief", 1), S.target_item().item_bin, order))


@register("l12_entropy_reduction", squery(f"select learner_id, skill_id, round({h_sql('a.belief')} - {h_sql('b.belief')}, 9) as reduction from aged_v b join belief_v a using (learner_id, skill_id)"))
def entropy_reduction(spark, sf):
    beliefs = materialise(V.beliefs(spark, sf))
    now = S.decay_beliefs(beliefs, F.lit(V.NOW_MS)).select("learner_id", "skill_id", F.col("belief").alias("later"))
    joined = beliefs.join(now, ["learner_id", "skill_id"])
    return joined.select("learner_id", "skill_id", R(S.entropy_reduction(F.col("belief"), F.col("later"))).alias("reduction"))


@register("l13_expected_scores", squery("select learner_id, round(avg(predicted), 9) as expected_score from pred_v where item_bin % 2 = 0 group by 1"))
def expected_scores(spark, sf):
    return S.expected_scores(scored(spark, sf), 9).withColumn("expected_score", R("expected_score"))


_WRAP = lambda x: f"((({x})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
_KEYS = [((11 + 0x9E3779B97F4A7C15 * (81 + pos)) & (2**64 - 1)) ^ ((20001 * 0xBF58476D1CE4E5B9) & (2**64 - 1)) for pos in range(5)]
DRAWS = {
    "sd_0": "select learner_id, predicted, xor(xor(learner_id::UBIGINT, case item_bin " + " ".join(f"when {2 * i} then {k}::UBIGINT" for i, k in enumerate(_KEYS)) + " end), "
    f"xor({_WRAP(f'(skill_id + 1)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT')}, {_WRAP(f'(item_bin + 1)::UHUGEINT * {0xD2B74407B1CE6E93}::UHUGEINT')})) as x from pred_v where item_bin % 2 = 0",
    "sd_1": f"select *, {_WRAP(f'xor(x, x >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT')} as y from sd_0",
    "sd_2": f"select *, {_WRAP(f'xor(y, y >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT')} as z from sd_1",
}


@register("l13_sampled_scores", squery("select learner_id, avg(case when (xor(z, z >> 31) >> 11)::double / 9007199254740992.0 < predicted then 1.0::double else 0 end) as observed_score from sd_2 group by 1", **DRAWS))
def sampled_scores(spark, sf):
    return S.sampled_scores(scored(spark, sf), 9, seed=11, stream=80)
