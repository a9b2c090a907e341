"""Experiment analytics over the replicate table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracewell.functions.intervals import t_critical
from tracewell.operators import bayes
from tracewell.operators import experiments as X
from tracewell.operators.skew import materialise
from tracewell.plans import views as V
from tracewell.plans.bayes_queries import SQL_VIEWS as BAYES_VIEWS
from tracewell.plans.model_queries import rounded
from tracewell.plans.registry import register
from tracewell.plans.sql import query

BASE, A, B = "p1", "p6", "p7"
WORLDS = ["A", "N", "R"]
_METRICS = ["initial_latent", "delayed_latent", "delayed_observed", "delayed_expected", "practice_accuracy"]
_T = "{" + ", ".join(f"{n}: {t_critical(n - 1)!r}" for n in range(2, 41)) + "}"


def interval_sql(value: str, name: str) -> str:
    half = f"case when count({value}) = 1 then 0 else (map {_T})[count({value})] * stddev_samp({value}) / sqrt(count({value})) end"
    return (
        f"round(avg({value}), 8) as {name}_mean, round(avg({value}) - {half}, 8) as {name}_low, round(avg({value}) + {half}, 8) as {name}_high,"
        f" round(avg(case when {value} > 0 then 1.0::double when {value} is not null then 0 end), 8) as {name}_positive_fraction"
    )


SQL_VIEWS = {
    "outcome_v": """
select l_returnflag as world_model, 'p'||l_linenumber as policy, l_orderkey % 10 as replicate, l_suppkey % 3 as order_id, l_quantity / 50 as initial_latent,
  l_extendedprice * (1 - l_discount) / 1e5 as delayed_latent, l_quantity * 0.02 as delayed_expected, l_discount * 10 as delayed_observed, l_tax as practice_accuracy, l_discount from lineitem""",
    "cell_v": "select world_model, policy, replicate, order_id, count(*) as n_learners, "
    + ", ".join(f"avg({m}) as {m}" for m in _METRICS)
    + ", "
    + ", ".join(
        f"count(*) filter (where {c}) as n_{g}, avg(delayed_latent) filter (where {c}) as delayed_latent_{g}"
        for g, c in (("low", "initial_latent <= 0.45"), ("middle", "initial_latent > 0.45 and initial_latent <= 0.60"), ("high", "initial_latent > 0.60"))
    )
    + " from outcome_v group by 1, 2, 3, 4",
    "paired_v": "select c.*, c.delayed_latent - r.delayed_latent as benefit, c.delayed_observed - r.delayed_observed as observed_benefit, c.delayed_expected - r.delayed_expected as expected_benefit,"
    " c.delayed_latent_low - r.delayed_latent_low as b_low, c.delayed_latent_middle - r.delayed_latent_middle as b_middle, c.delayed_latent_high - r.delayed_latent_high as b_high"
    " from cell_v c join cell_v r on r.policy = 'p1' and r.world_model = c.world_model and r.replicate = c.replicate and r.order_id = c.order_id",
    "rep_v": "select world_model, policy, replicate, avg(benefit) as benefit, avg(observed_benefit) as observed_benefit, avg(expected_benefit) as expected_benefit, avg(delayed_latent) as delayed_latent, avg(delayed_observed) as delayed_observed, avg(practice_accuracy) as practice_accuracy from paired_v group by 1, 2, 3",
    "mean_v": "select world_model, policy, round(avg(benefit), 12) as benefit_mean from rep_v group by 1, 2",
    "ranked_v": "select world_model, policy, benefit_mean, row_number() over (partition by world_model order by benefit_mean desc, policy)::integer as rank, rank() over (partition by world_model order by benefit_mean desc)::integer as tied_rank from mean_v",
    "diff_v": "select a.world_model, a.replicate, a.order_id, a.benefit - b.benefit as difference from paired_v a join paired_v b using (world_model, replicate, order_id) where a.policy = 'p6' and b.policy = 'p7'",
    "cohort_v": "select world_model, policy, order_id as draw, replicate, avg(benefit) as v, count(distinct order_id) as o from paired_v group by 1, 2, 3, 4",
    "draw_v": "select world_model, policy, draw, avg(v) as draw_mean, coalesce(stddev_samp(v), 0) as within_draw_sd, count(distinct replicate) as n_cohorts, min(o) as n_orders, coalesce(stddev_samp(v), 0) / sqrt(count(distinct replicate)) as within_draw_se from cohort_v group by 1, 2, 3",
    "sched_v": f"select world_model, order_id, policy, count(*) as n_replicates, {interval_sql('benefit', 'benefit')} from paired_v group by 1, 2, 3",
}


def xquery(body: str, **local: str) -> str:
    return query(body, **{**SQL_VIEWS, **local})


def paired(spark, sf):
    metrics = {"delayed_latent": "benefit", "delayed_observed": "observed_benefit", "delayed_expected": "expected_benefit"}
    return X.paired_benefit(V.cells(spark, sf), BASE, metrics)


def replicates(spark, sf):
    columns = ["benefit", "observed_benefit", "expected_benefit", "delayed_latent", "delayed_observed", "practice_accuracy"]
    return materialise(X.order_average(paired(spark, sf), ["world_model", "policy", "replicate"], columns))


def mean_benefit(spark, sf):
    means = replicates(spark, sf).groupBy("world_model", "policy").agg(F.round(F.avg("benefit"), 12).alias("benefit_mean"))
    return materialise(means)



def _with_draw(spark, sf):
    return paired(spark, sf).withColumn("draw", F.col("order_id"))


R8 = lambda df: rounded(df, digits=8)
R11 = lambda df: rounded(df, digits=11)  # noqa: E731  values with few digits, where 8 would meet ties


@register("b13_stress_scale_filter", xquery("select world_model, policy, order_id, scale, round(benefit, 11) as benefit from (select *, 0.5 + order_id * 0.5 as scale from paired_v) where scale <> 1.0").replace("0.5 + order_id * 0.5", "0.5::double + order_id * 0.5::double"))
def stress_scale_filter(spark, sf):
    rows = paired(spark, sf).withColumn("scale", 0.5 + F.col("order_id") * 0.5).where(F.col("scale") != 1.0)
    return R11(X.keep_existing(rows, ["world_model", "policy", "order_id", "scale", "grid_role", "benefit"]))


@register("c6_paired_reference", xquery("select world_model, policy, replicate, order_id, round(benefit, 11) as benefit, round(observed_benefit, 11) as observed_benefit, round(expected_benefit, 11) as expected_benefit from paired_v"))
def paired_reference(spark, sf):
    return R11(paired(spark, sf).select("world_model", "policy", "replicate", "order_id", "benefit", "observed_benefit", "expected_benefit"))


def _differences(spark, sf):
    return X.contrast(paired(spark, sf), A, B, "benefit", X.PAIRING)


@register("c7_policy_contrast", xquery("select world_model, replicate, order_id, round(difference, 8) as difference from diff_v"))
def policy_contrast(spark, sf):
    return R8(_differences(spark, sf))


@register("c8_world_rank_pairs", xquery("select a.world_model as world_1, b.world_model as world_2, policy, a.rank as rank_1, b.rank as rank_2 from ranked_v a join ranked_v b using (policy) where a.world_model < b.world_model"))
def world_rank_pairs(spark, sf):
    return X.rank_pairs(X.policy_ranks(mean_benefit(spark, sf), "benefit_mean")).select("world_1", "world_2", "policy", "rank_1", "rank_2")


@register("d14_error_summary", xquery("select world_model, order_id, round(avg(abs(benefit)), 8) as mean_abs_error, round(max(abs(benefit)), 8) as max_abs_error from paired_v group by 1, 2"))
def error_summary(spark, sf):
    return R8(X.error_summary(paired(spark, sf), ["world_model", "order_id"], "benefit"))


_CELL_ROUND = ", ".join(f"round({m}, 11) as {m}" for m in [*_METRICS, "delayed_latent_low", "delayed_latent_middle", "delayed_latent_high"])


@register("d15_replicate_means", xquery(f"select world_model, policy, replicate, order_id, n_learners, n_low, n_middle, n_high, {_CELL_ROUND} from cell_v"))
def replicate_means(spark, sf):
    return R11(V.cells(spark, sf))


@register("d16_order_average", xquery("select world_model, policy, replicate, round(benefit, 8) as benefit, round(observed_benefit, 8) as observed_benefit from rep_v"))
def order_average(spark, sf):
    return R8(replicates(spark, sf).select("world_model", "policy", "replicate", "benefit", "observed_benefit"))


@register("d17_nested_draws", xquery("select world_model, policy, draw, round(draw_mean, 8) as draw_mean, round(within_draw_sd, 8) as within_draw_sd, n_cohorts, n_orders, round(within_draw_se, 8) as within_draw_se from draw_v"))
def nested_draws(spark, sf):
    return R8(X.stress_cells(_with_draw(spark, sf), "draw", "benefit", ["world_model", "policy"]))


@register("d18_tertile_thresholds", xquery("""select world_model, lower_threshold, upper_threshold, quantile, n, round(n / sum(n) over (partition by world_model), 8) as prevalence from (
 select world_model, round(lo, 8) as lower_threshold, round(hi, 8) as upper_threshold, case when v <= lo then 'low' when v <= hi then 'middle' else 'high' end as quantile, count(*) as n
 from (select world_model, delayed_latent as v, lo, hi from outcome_v join (select world_model, quantile_cont(delayed_latent, 1/3) as lo, quantile_cont(delayed_latent, 2/3) as hi from outcome_v group by 1) using (world_model)) group by 1, 2, 3, 4)"""))
def tertile_thresholds(spark, sf):
    return R8(X.tertile_thresholds(V.learner_outcomes(spark, sf), "delayed_latent"))


def _schedule_cells(spark, sf):
    return X.interval_summary(paired(spark, sf), ["world_model", "order_id", "policy"], {"benefit": "benefit"})


@register("d19_schedule_summary", xquery("""select world_model, policy, count(*) as n_schedule_cells, min(benefit_mean) as min_benefit, max(benefit_mean) as max_benefit, count(*) filter (where benefit_mean > 0) as positive_cell_means,
 count(*) filter (where benefit_low > 0) as cells_interval_strictly_positive, count(*) filter (where benefit_high < 0) as cells_interval_strictly_negative from sched_v group by 1, 2"""))
def schedule_summary(spark, sf):
    return X.schedule_summary(R8(_schedule_cells(spark, sf)), ["world_model", "policy"], "benefit_mean", "benefit_low", "benefit_high")


@register("e7_policy_ranks", xquery("select * replace (round(benefit_mean, 8) as benefit_mean) from ranked_v"))
def policy_ranks(spark, sf):
    return R8(X.policy_ranks(mean_benefit(spark, sf), "benefit_mean"))


@register("e8_rank_frequencies", xquery("""select world_model, policy, count(*) as n_replications, round(avg(case when r = 1 then 1.0::double else 0 end), 8) as rank1_frequency, round(avg(case when r <= 3 then 1.0::double else 0 end), 8) as top3_frequency, round(avg(r), 8) as mean_replication_rank
 from (select world_model, policy, replicate, row_number() over (partition by world_model, replicate order by round(benefit, 12) desc, policy) as r from rep_v) group by 1, 2"""))
def rank_frequencies(spark, sf):
    rows = replicates(spark, sf).withColumn("benefit", F.round("benefit", 12))
    return R8(X.rank_frequencies(rows, "benefit"))


@register("e12_rank_order", xquery("""select world_model, order_id, string_agg(policy, ' > ' order by m desc, policy) as rank_order, first(policy order by m desc, policy) as best_policy, list(policy order by m desc, policy)[2] as runner_up
 from (select world_model, order_id, policy, round(avg(benefit), 12) as m from paired_v group by 1, 2, 3) group by 1, 2"""))
def rank_order(spark, sf):
    means = paired(spark, sf).groupBy("world_model", "order_id", "policy").agg(F.round(F.avg("benefit"), 12).alias("m"))
    return X.rank_order(means, ["world_model", "order_id"], "m")


_M = 2**64 - 1
_U = lambda x: f"(({x})::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
BOOTSTRAP = {
    "sized_v": "select world_model, policy, count(*) as n, list_sort(list(benefit)) as v, floor(0.025::double * (count(*) - 1))::bigint as lo, ('0x' || substr(sha256(world_model || '|' || policy), 1, 8))::bigint as key from rep_v group by 1, 2",
    "bd_0": f"select world_model, policy, n, lo, b, j, xor(xor(j::UBIGINT, {((17 + 0x9E3779B97F4A7C15) & _M) ^ 0xBF58476D1CE4E5B9}::UBIGINT), xor({_U(f'(b + 1)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT')}, {_U(f'(key + 1)::UHUGEINT * {0xD2B74407B1CE6E93}::UHUGEINT')})) as x"
    " from (select *, unnest(range(lo + 2)) as j from (select *, unnest(range(2000)) as b from sized_v where n >= 2))",
    "bd_1": f"select *, {_U(f'xor(x, x >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT')} as y from bd_0",
    "bd_2": f"select *, {_U(f'xor(y, y >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT')} as z from bd_1",
    "bd_t": "select *, ln(greatest((xor(z, z >> 31) >> 11)::double / 9007199254740992.0, pow(2.0, -54))) / (n - j) as term from bd_2",
    "bd_e": "select world_model, policy, b, sum(term) filter (where j <= lo) as s0, sum(term) as s1 from bd_t where j < n group by 1, 2, 3",
    "bd_q": "select world_model, policy, v[least(floor((1 - exp(s0)) * n)::bigint, n - 1) + 1] as v0, v[least(floor((1 - exp(s1)) * n)::bigint, n - 1) + 1] as v1, 0.025::double * (n - 1) - lo as part from bd_e join sized_v using (world_model, policy)",
}


@register("f11_bootstrap_quantile", xquery("select world_model, policy, round(quantile_cont(v0 + (v1 - v0) * part, 0.025), 8) as stability_low, round(quantile_cont(v0 + (v1 - v0) * part, 0.975), 8) as stability_high from bd_q group by 1, 2", **BOOTSTRAP))
def bootstrap_quantile(spark, sf):
    return R8(X.bootstrap_quantile(replicates(spark, sf), ["world_model", "policy"], "benefit", 0.025, 17, resamples=2000))


@register("f12_order_statistic_interval", xquery("""select world_model, policy, count(*) as n_draws, 1::bigint as rank_low, 4::bigint as rank_high, round(list(benefit order by benefit)[1], 8) as value_low, round(list(benefit order by benefit)[4], 8) as value_high,
 round(30 * 0.025 * pow(0.975, 29) + 435 * pow(0.025, 2) * pow(0.975, 28) + 4060 * pow(0.025, 3) * pow(0.975, 27), 8) as nominal_coverage from paired_v group by 1, 2"""))
def order_statistic_interval(spark, sf):
    return R8(X.order_statistic_interval(paired(spark, sf), ["world_model", "policy"], "benefit", 0.025))


_K1 = {"delayed_latent": "delayed_latent", "delayed_observed": "delayed_observed", "practice_accuracy": "practice_accuracy", "benefit": "benefit", "observed_benefit": "observed_benefit", "expected_benefit": "expected_benefit"}


@register("k1_interval", xquery(f"select world_model, policy, count(*) as n_replicates, {interval_sql('benefit', 'benefit')} from rep_v group by 1, 2"))
def interval(spark, sf):
    return R8(X.interval_summary(replicates(spark, sf), ["world_model", "policy"], {"benefit": "benefit"}))


@register("k2_policy_summary", xquery("select world_model, policy, count(*) as n_replicates, " + ", ".join(interval_sql(m, n) for m, n in _K1.items()) + " from rep_v group by 1, 2"))
def policy_summary(spark, sf):
    return R8(X.interval_summary(replicates(spark, sf), ["world_model", "policy"], _K1))


@register("k3_rank_concordance", xquery("""select world_1, world_2, n as n_policies, round(1 - 4.0::double * d / (n * (n - 1)), 8) as kendall_tau,
 round(case when 4 * d = n * (n - 1) then 1.0::double else least(1.0::double, 2 * (select count(*) from inversions_v i where i.n = c.n and i.k <= least(d, n * (n - 1) // 2 - d)) / (select count(*) from inversions_v i where i.n = c.n)::double) end, 8) as kendall_p_value from (
 select x.world_1, x.world_2, count(distinct x.policy) as n, count(*) filter (where (x.rank_1 < y.rank_1) and (x.rank_2 > y.rank_2)) as d from rp_v x join rp_v y using (world_1, world_2) group by 1, 2) c""",
    recursive=True,
    rp_v="select a.world_model as world_1, b.world_model as world_2, policy, a.rank as rank_1, b.rank as rank_2 from ranked_v a join ranked_v b using (policy) where a.world_model < b.world_model",
    # A row for each order of n policies, with its number of inversions k.
    inversions_v="select 1 as n, 0 as k union all select n + 1, k + j from inversions_v, (select unnest(range(7)) as j) where n < 7 and j <= n"))
def rank_concordance(spark, sf):
    return R8(X.rank_concordance(X.policy_ranks(mean_benefit(spark, sf), "benefit_mean")))


@register("k4_robustness", xquery("""select policy, round(avg(benefit_mean), 8) as mean_across_worlds, round(min(benefit_mean), 8) as minimum_across_worlds, round(max(benefit_mean), 8) as maximum_across_worlds, round(stddev_samp(benefit_mean), 8) as world_disagreement_sd,
 case when policy <> 'p1' then round(avg(case when benefit_mean > 0 then 1.0::double else 0 end), 8) end as positive_world_fraction from mean_v group by 1"""))
def robustness(spark, sf):
    return R8(X.robustness(mean_benefit(spark, sf), "benefit_mean", BASE))


@register("k5_subgroup_benefit", xquery(f"select world_model, policy, initial_group, count(*) as n_replicates, {interval_sql('v', 'benefit')} from (select world_model, policy, g as initial_group, replicate, avg(case g when 'low' then b_low when 'middle' then b_middle else b_high end) as v from paired_v, (select unnest(['low','middle','high']) as g) group by 1, 2, 3, 4) where v is not null group by 1, 2, 3"))
def subgroup_benefit(spark, sf):
    return R8(X.subgroup_benefit(V.cells(spark, sf), BASE))


@register("k6_order_sensitivity", xquery("select world_model, policy, order_id, round(avg(benefit), 8) as benefit_mean, round(coalesce(stddev_samp(benefit), 0), 8) as benefit_sd_across_replicates from paired_v group by 1, 2, 3"))
def order_sensitivity(spark, sf):
    return R8(X.order_sensitivity(paired(spark, sf), "benefit"))


@register("k6_order_range", xquery("select world_model, policy, round(avg(m), 8) as order_mean, round(min(m), 8) as order_min, round(max(m), 8) as order_max, round(stddev_samp(m), 8) as order_sd from (select world_model, policy, order_id, avg(benefit) as m from paired_v group by 1, 2, 3) group by 1, 2"))
def order_range(spark, sf):
    return R8(X.order_range(X.order_sensitivity(paired(spark, sf), "benefit")))


@register("k7_endpoint_tables", xquery(f"select world_model, policy, count(*) as n_replicates, {interval_sql('observed_benefit', 'observed')}, {interval_sql('expected_benefit', 'expected')}, round(100 * avg(expected_benefit), 8) as percentage_point_difference from rep_v group by 1, 2"))
def endpoint_tables(spark, sf):
    out = X.interval_summary(replicates(spark, sf), ["world_model", "policy"], {"observed_benefit": "observed", "expected_benefit": "expected"})
    return R8(out.withColumn("percentage_point_difference", F.col("expected_mean") * 100))


_BAND = "avg(difference) * 100 as percentage_point_difference, abs(avg(difference)) <= 0.001 as within_0_001_band, abs(avg(difference)) <= 0.002 as within_0_002_band"


@register("k8_direct_contrast", xquery(f"select world_model, count(*) as n_replicates, {interval_sql('difference', 'difference')}, {_BAND.replace('avg(difference) * 100', 'round(avg(difference) * 100, 8)')} from (select a.world_model, replicate, a.expected_benefit - b.expected_benefit as difference from rep_v a join rep_v b using (world_model, replicate) where a.policy = 'p6' and b.policy = 'p7') group by 1"))
def direct_contrast(spark, sf):
    differences = X.contrast(replicates(spark, sf), A, B, "expected_benefit", ["world_model", "replicate"])
    return R8(X.contrast_summary(differences, ["world_model"]))


@register("h12_indifference_bands", xquery(f"select world_model, order_id, count(*) as n_replicates, {interval_sql('difference', 'difference')}, {_BAND.replace('avg(difference) * 100', 'round(avg(difference) * 100, 8)')} from diff_v group by 1, 2"))
def indifference_bands(spark, sf):
    return R8(X.contrast_summary(_differences(spark, sf), ["world_model", "order_id"]))


@register("k9_factorial_summary", xquery(f"""select r.*, n_orders, positive_order_fraction, minimum_order_mean, maximum_order_mean from (select world_model, count(*) as n_replicates, {interval_sql('v', 'contrast')} from (select world_model, replicate, avg(difference) as v from diff_v group by 1, 2) group by 1) r
 join (select world_model, count(*) as n_orders, round(avg(case when m > 0 then 1.0::double else 0 end), 8) as positive_order_fraction, round(min(m), 8) as minimum_order_mean, round(max(m), 8) as maximum_order_mean from (select world_model, order_id, avg(difference) as m from diff_v group by 1, 2) group by 1) o using (world_model)"""))
def factorial_summary(spark, sf):
    return R8(X.factorial_summary(_differences(spark, sf)))


@register("k10_resolved_best", xquery(f"""select o.*, i.* exclude (world_model), best_minus_runner_up_low > 0 as resolved_best from (select world_model, string_agg(policy, ' > ' order by benefit_mean desc, policy) as rank_order, first(policy order by benefit_mean desc, policy) as best_policy, list(policy order by benefit_mean desc, policy)[2] as runner_up from mean_v group by 1) o
 join (select world_model, count(*) as n_replicates, {interval_sql('d', 'best_minus_runner_up')} from (select a.world_model, a.replicate, a.benefit - b.benefit as d from rep_v a join rep_v b using (world_model, replicate) join ranked_v x on x.world_model = a.world_model and x.policy = a.policy and x.rank = 1 join ranked_v y on y.world_model = b.world_model and y.policy = b.policy and y.rank = 2) group by 1) i using (world_model)"""))
def resolved_best(spark, sf):
    return R8(X.resolved_best(paired(spark, sf), ["world_model"], "benefit"))


@register("k11_sensitivity_summary", xquery(f"select world_model, order_id, policy, count(*) as n_replicates, {interval_sql('benefit', 'benefit')}, {interval_sql('observed_benefit', 'observed_benefit')} from paired_v group by 1, 2, 3"))
def sensitivity_summary(spark, sf):
    return R8(X.sensitivity_summary(paired(spark, sf), ["world_model", "order_id"], ["benefit", "observed_benefit"]))


_STRESS = """select world_model, policy, count(*) as n_draws, min(n_cohorts) as cohorts_per_draw, min(n_orders) as orders_per_cohort, round(avg(draw_mean), 8) as mean_over_draws, round(avg(case when draw_mean > 0 then 1.0::double else 0 end), 8) as positive_draw_fraction,
 round(stddev_samp(draw_mean), 8) as between_draw_sd, round(quantile_cont(draw_mean, 0.025), 8) as q025, round(quantile_cont(draw_mean, 0.975), 8) as q975, round(median(within_draw_sd), 8) as median_within_draw_sd, round(median(within_draw_se), 8) as median_within_draw_se,
 round(case when stddev_samp(draw_mean) > 0 then median(within_draw_se) / stddev_samp(draw_mean) else 0 end, 6) as median_se_to_between_draw_sd from draw_v group by 1, 2"""


@register("k12_stress_summary", xquery(_STRESS))
def stress_summary(spark, sf):
    cells = materialise(X.stress_cells(_with_draw(spark, sf), "draw", "benefit", ["world_model", "policy"]))
    out = X.stress_summary(cells, ["world_model", "policy"])
    return R8(out.withColumn("median_se_to_between_draw_sd", F.round("median_se_to_between_draw_sd", 6)))


@register("k13_variant_summary", xquery("select *, rank() over (partition by world_model, order_id order by mean_benefit desc)::integer as rank_within_variant from (select world_model, order_id, policy, round(avg(benefit), 8) as mean_benefit, round(stddev_samp(benefit), 8) as sd_across_replicates, round(min(benefit), 8) as min_benefit, round(max(benefit), 8) as max_benefit from paired_v group by 1, 2, 3)"))
def variant_summary(spark, sf):
    return R8(X.variant_summary(paired(spark, sf), ["world_model", "order_id", "policy"], "benefit", ["world_model", "order_id"]))


@register("k14_scale_summary", xquery("select world_model, policy, scale, count(*) as n_draws, round(avg(draw_mean), 8) as mean_over_draws, round(min(draw_mean), 8) as minimum_draw_mean, round(max(draw_mean), 8) as maximum_draw_mean, round(avg(case when draw_mean > 0 then 1.0::double else 0 end), 8) as positive_draw_fraction from (select world_model, policy, 0.5::double + (replicate % 3) * 0.5::double as scale, replicate as draw, avg(benefit) as draw_mean from paired_v group by 1, 2, 3, 4) where scale <> 1.0 group by 1, 2, 3"))
def scale_summary(spark, sf):
    scaled = paired(spark, sf).withColumn("scale", 0.5 + (F.col("replicate") % 3) * 0.5)
    averaged = scaled.groupBy("world_model", "policy", "scale", "replicate").agg(F.avg("benefit").alias("draw_mean"))
    return R8(X.scale_summary(averaged, ["world_model", "policy"], "scale"))


@register("k15_other_baseline", xquery(f"select world_model, policy, count(*) as n_replicates, {interval_sql('v', 'benefit')} from (select c.world_model, c.policy, c.replicate, avg(c.delayed_latent - r.delayed_latent) as v from cell_v c join cell_v r on r.policy = 'p2' and r.world_model = c.world_model and r.replicate = c.replicate and r.order_id = c.order_id group by 1, 2, 3) group by 1, 2"))
def other_baseline(spark, sf):
    rows = X.paired_benefit(V.cells(spark, sf), "p2", {"delayed_latent": "benefit"})
    averaged = X.order_average(rows, ["world_model", "policy", "replicate"], ["benefit"])
    return R8(X.interval_summary(averaged, ["world_model", "policy"], {"benefit": "benefit"}))


@register("k16_benefit_matrix", xquery("select policy, " + ", ".join(f"round(max(benefit_mean) filter (where world_model = '{w}'), 8) as \"{w}\"" for w in WORLDS) + " from mean_v group by 1"))
def benefit_matrix(spark, sf):
    return R8(X.benefit_matrix(mean_benefit(spark, sf), "benefit_mean", WORLDS))


@register("k16_design_table", xquery("select world_model, policy, round(avg(benefit), 8) as benefit_mean, 'order_average' as design from rep_v group by 1, 2 union all select world_model, policy, round(avg(m), 8), 'factorial' from (select world_model, policy, order_id, avg(benefit) as m from paired_v group by 1, 2, 3) group by 1, 2"))
def design_table(spark, sf):
    by = ["world_model", "policy"]
    first = replicates(spark, sf).groupBy(*by).agg(F.avg("benefit").alias("benefit_mean"))
    orders = X.order_sensitivity(paired(spark, sf), "benefit")
    return R8(X.design_table(first, orders.groupBy(*by).agg(F.avg("benefit_mean").alias("benefit_mean"))))


@register("k16_target_ranges", xquery("select policy, order_id as target, count(*) as n_settings, round(avg(m), 8) as mean_expected_benefit, round(min(m), 8) as min_expected_benefit, round(max(m), 8) as max_expected_benefit from (select policy, order_id, replicate % 3 as width, replicate // 3 as floor, avg(expected_benefit) as m from paired_v group by all) group by 1, 2"))
def target_ranges(spark, sf):
    grid = paired(spark, sf).select("policy", F.col("order_id").alias("target"), (F.col("replicate") % 3).alias("width"), F.floor(F.col("replicate") / 3).alias("floor"), "expected_benefit")
    return R8(X.target_ranges(grid, ["policy", "target"], ["width", "floor"], "expected_benefit"))


_SEEN = "select distinct case when world_model = 'N' and f = 1 then 'X' else world_model end as w, f from outcome_v, (select unnest([0, 1]) as f)"


@register("g3_label_completeness", xquery("select case f when 0 then 'as built' else 'broken' end as input, 3 - count(*) filter (where w in ('A', 'N', 'R')) as missing_labels, count(*) filter (where w not in ('A', 'N', 'R')) as unknown_labels from seen_v group by 1", seen_v=_SEEN))
def label_completeness(spark, sf):
    wanted = spark.createDataFrame([(w,) for w in WORLDS], "world_model string")
    built = materialise(V.learner_outcomes(spark, sf).select("world_model").distinct())
    swapped = built.select(F.when(F.col("world_model") == "N", "X").otherwise(F.col("world_model")).alias("world_model"))
    out = None
    for name, seen in (("as built", built), ("broken", swapped)):
        missing = wanted.exceptAll(seen).agg(F.count(F.lit(1)).alias("missing_labels"))
        unknown = seen.exceptAll(wanted).agg(F.count(F.lit(1)).alias("unknown_labels"))
        row = missing.crossJoin(unknown).select(F.lit(name).alias("input"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# The profile of the shared REML views, over draws in place of skills.
_DRAWS = {re.sub(r"^(br|gr|ev)", r"jd_\1", k): re.sub(r"\b(br|gr|ev)(\d+)\b", r"jd_\1\2", v).replace("used_v", "drawn_v") for k, v in BAYES_VIEWS.items() if re.match(r"(br|gr|ev)\d+$", k)}
_DRAWS["drawn_v"] = "select world_model || '/' || policy as parameter, draw_mean as y, within_draw_se as se from draw_v where policy <> 'p1'"


@register("j13_draw_reliability", xquery("select split_part(parameter, '/', 1) as world_model, split_part(parameter, '/', 2) as policy, round(mu, 6) as mu, round(sqrt(tau2), 5) as between_draw_tau, round(mu - 1.959963984540054 * sqrt(tau2), 5) as model_implied_latent_q025 from jd_br10", **_DRAWS))
def draw_reliability(spark, sf):
    cells = X.stress_cells(_with_draw(spark, sf).where(F.col("policy") != BASE), "draw", "benefit", ["world_model", "policy"])
    draws = materialise(cells.select("world_model", "policy", F.col("draw_mean").alias("y"), F.col("within_draw_se").alias("se")))
    return rounded(rounded(bayes.random_effects_summary(draws, ["world_model", "policy"]), ["mu"]), ["between_draw_tau", "model_implied_latent_q025"], 5)
