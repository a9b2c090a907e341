"""Empirical-Bayes and item-bank queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import bayes
from tracewell.operators.skew import materialise
from tracewell.plans import views as V
from tracewell.plans.model_queries import rounded
from tracewell.plans.prepare_queries import R
from tracewell.plans.registry import register
from tracewell.plans.sql import query

PARAMS = bayes.PARAMETERS
SQL_VIEWS = {
    "fits_v": """
select skill_id, 0.15 + skill_id * 0.02 + q / 500 as p_init, 0.02 + skill_id * 0.004 + d / 5 as p_learn, 0.10 + skill_id * 0.006 + t / 4 as slip,
  0.25 + skill_id * 0.01 + q / 1000 as guess, 0.0005 + skill_id * 0.00004 + d / 200 as lambda_per_day, e
from (select split_part(p_brand, '#', 2)::integer as skill_id, avg(l_quantity) as q, avg(l_discount) as d, avg(l_tax) as t, stddev_samp(l_quantity / 50) / sqrt(count(*)) as e
  from lineitem join part on p_partkey = l_partkey group by 1)""",
    "long_v": " union all ".join(
        f"select skill_id, '{p}' as parameter, {p} as raw_value, {div} as raw_se from fits_v"
        for p, div in (("p_init", "e"), ("p_learn", "e / 5"), ("slip", "e / 2"), ("guess", "e / 2"), ("lambda_per_day", "e / 500"))
    ),
    "trans_v": """
select skill_id, parameter, raw_value, case when parameter = 'lambda_per_day' then ln(raw_value) else ln(raw_value / (1 - raw_value)) end as y,
  raw_se / case when parameter = 'lambda_per_day' then raw_value else raw_value * (1 - raw_value) end as se, parameter = 'guess' and raw_value >= 0.48 as boundary from long_v""",
    "used_v": "select parameter, y, se from trans_v where not boundary",
    "br0": "select parameter, ln(1e-12::double) as low, ln(greatest(20 * var_samp(y), 1.0)) as high, 0.0::double as tau2, 0.0::double as mu from used_v group by 1",
}
for _k in range(1, 11):
    SQL_VIEWS[f"gr{_k}"] = f"select parameter, low, high, exp(low + (high - low) * i / 100.0) as tau2 from br{_k - 1}, range(101) r(i)"
    SQL_VIEWS[f"ev{_k}"] = (
        f"select parameter, any_value(low) as low, any_value(high) as high, tau2, sum(y / (se * se + tau2)) / sum(1 / (se * se + tau2)) as mu,"
        f" 0.5 * (sum(ln(se * se + tau2)) + ln(sum(1 / (se * se + tau2))) + sum(y * y / (se * se + tau2)) - pow(sum(y / (se * se + tau2)), 2) / sum(1 / (se * se + tau2))) as obj"
        f" from gr{_k} join used_v using (parameter) group by parameter, tau2"
    )
    SQL_VIEWS[f"br{_k}"] = (
        f"select parameter, greatest(any_value(low), ln(arg_min(tau2, obj)) - (any_value(high) - any_value(low)) / 100) as low,"
        f" least(any_value(high), ln(arg_min(tau2, obj)) + (any_value(high) - any_value(low)) / 100) as high, arg_min(tau2, obj) as tau2, arg_min(mu, obj) as mu from ev{_k} group by parameter"
    )
SQL_VIEWS["hyper_v"] = "select parameter, mu as global_transformed_mean, tau2 as between_skill_variance from br10"
SQL_VIEWS["shrunk_v"] = """
select *, case when parameter = 'lambda_per_day' then exp(v) else 1 / (1 + exp(-v)) end as shrunk_value from (
 select skill_id, parameter, raw_value, global_transformed_mean, between_skill_variance, s as transformed_se,
  between_skill_variance / (between_skill_variance + s * s) * y + (1 - between_skill_variance / (between_skill_variance + s * s)) * global_transformed_mean as v
 from (select *, case when boundary then greatest(se, 0.55) else se end as s from trans_v) join hyper_v using (parameter))"""
SQL_VIEWS["bank_v"] = """
select 'q'||l_partkey as question_id, split_part(p_brand, '#', 2)::integer as skill_id, (p_size % 7)::integer as part, n as interaction_rows, c as correct_rows, c / n as accuracy
from (select l_partkey, count(*) as n, count(*) filter (where l_quantity > 25) as c from lineitem group by 1) join part on p_partkey = l_partkey"""
SQL_VIEWS["prev_v"] = """
select skill_id, sum(correct_rows) / sum(interaction_rows) as empirical_accuracy, 0.2::double as p0, 0.7::double as p1,
  greatest(0, least(1, (sum(correct_rows) / sum(interaction_rows) - 0.2) / 0.5)) as implied_mastery_prevalence from bank_v group by 1"""
SQL_VIEWS["root_v"] = """
select *, ln((-b + sqrt(b * b + 4 * a * t)) / (2 * a)) as raw_item_shift from (
 select *, 0.25 * 7.0 / 3 * (1 - t) as a, (1 - q) * 0.25 + q * 7.0 / 3 - t * (0.25 + 7.0 / 3) as b from (
  select k.*, p.implied_mastery_prevalence, p.implied_mastery_prevalence as q, (correct_rows + 0.5::double) / (interaction_rows + 1) as t from bank_v k join prev_v p using (skill_id)))"""
SQL_VIEWS["shift_v"] = """
select *, t as smoothed_accuracy, sqrt(t * (1 - t) / (interaction_rows + 1)) / ((1 - q) * e0 * (1 - e0) + q * e1 * (1 - e1)) as item_shift_se
from (select *, 1 / (1 + exp(-(ln(0.25::double) + raw_item_shift))) as e0, 1 / (1 + exp(-(ln(7.0::double / 3) + raw_item_shift))) as e1 from root_v)"""
SQL_VIEWS["wmean_v"] = "select skill_id, sum(raw_item_shift * interaction_rows) / sum(interaction_rows) as m, sum(item_shift_se * item_shift_se * interaction_rows) / sum(interaction_rows) as s2 from shift_v group by 1"
SQL_VIEWS["prior_v"] = "select skill_id, greatest(sum(pow(raw_item_shift - m, 2) * interaction_rows) / sum(interaction_rows) - any_value(s2), 1e-8) as item_prior_variance from shift_v join wmean_v using (skill_id) group by 1"
SQL_VIEWS["pull_v"] = "select *, item_prior_variance / (item_prior_variance + item_shift_se * item_shift_se) as item_shift_shrinkage from shift_v join prior_v using (skill_id)"
SQL_VIEWS["effect_v"] = """
select *, round(item_shift_shrinkage * (raw_item_shift - c), 12) as shrunk_item_shift from pull_v join (
 select skill_id, sum(raw_item_shift * interaction_rows * item_shift_shrinkage) / sum(interaction_rows * item_shift_shrinkage) as c from pull_v group by 1) using (skill_id)"""
SQL_VIEWS["held_v"] = """
select *, case when rk % 5 = ('0x' || substr(sha256('skill:' || skill_id), 1, 8))::bigint % 5 then 'test' else 'practice' end as set from (
 select *, row_number() over (partition by skill_id order by shrunk_item_shift, question_id) - 1 as rk from effect_v)"""
SQL_VIEWS["binned_v"] = """
select *, least(8, (row_number() over (partition by skill_id, set order by shrunk_item_shift, interaction_rows desc, question_id) - 1) * 9 // count(*) over (partition by skill_id, set))::integer as item_bin from held_v"""
_W = "sqrt(greatest(interaction_rows, 1))"
SQL_VIEWS["binsum_v"] = f"""
select skill_id, set, item_bin, sum(shrunk_item_shift * {_W}) / sum({_W}) as representative_shift, count(*) as n_items, sum(interaction_rows)::bigint as bin_interactions,
  sqrt(sum(pow(greatest(item_shift_se, 1e-6), 2) * {_W}) / sum({_W})) as rms_item_se from binned_v group by 1, 2, 3"""
SQL_VIEWS["unc_v"] = f"""
select *, weighted_rms_se / weighted_mean_se as rms_to_mean_se_ratio, weighted_rms_se / weighted_mean_posterior_sd as rms_to_posterior_sd_ratio from (
 select skill_id, set, item_bin, count(*) as n_items, sqrt(sum(s * s * w) / sum(w)) as weighted_rms_se, sqrt(sum(w * w * s * s)) / sum(w) as weighted_mean_se,
  sqrt(sum(w * w * s * s * pv / (pv + s * s))) / sum(w) as weighted_mean_posterior_sd
 from (select *, {_W} as w, greatest(item_shift_se, 1e-12) as s, greatest(item_prior_variance, 1e-12) as pv from binned_v) group by 1, 2, 3)"""


def bquery(body: str) -> str:
    return query(body, **SQL_VIEWS)


def transformed(spark, sf):
    return materialise(bayes.transformed_parameters(V.fits(spark, sf)))


def rounded_effects(spark, sf):
    """Shifts rounded before ranking so that both engines order equal shifts by id."""
    return V.effects(spark, sf).withColumn("shrunk_item_shift", R("shrunk_item_shift", 12))


def binned(spark, sf):
    return bayes.difficulty_bins(bayes.item_holdout(rounded_effects(spark, sf)))


@register("b12_model_and_boundary_filter", bquery("select skill_id, parameter, round(raw_value, 9) as raw_value from trans_v where not boundary"))
def model_and_boundary_filter(spark, sf):
    t = bayes.transformed_parameters(V.fits(spark, sf)).where(~F.col("boundary"))
    return t.select("skill_id", "parameter", R("raw_value").alias("raw_value"))


@register("j1_transformed_parameters", bquery("select skill_id, parameter, round(raw_value, 9) as raw_value, round(y, 9) as y, round(se, 9) as se, boundary from trans_v"))
def transformed_parameters(spark, sf):
    return rounded(bayes.transformed_parameters(V.fits(spark, sf)), digits=9)


@register("j2_hyperparameters", bquery("""select parameter, count(*) as n_skills, count(*) filter (where not boundary) as n_used_for_hyperparameter_fit, count(*) filter (where boundary) as n_boundary_excluded,
 round(any_value(global_transformed_mean), 6) as global_transformed_mean, round(any_value(between_skill_variance), 6) as between_skill_variance from trans_v join hyper_v using (parameter) group by 1"""))
def hyperparameters(spark, sf):
    return rounded(bayes.hyperparameters(transformed(spark, sf)))


@register("j3_shrunk_parameters", bquery("select skill_id, parameter, round(raw_value, 6) as raw_value, round(shrunk_value, 6) as shrunk_value, round(transformed_se, 6) as transformed_se, round(global_transformed_mean, 6) as global_transformed_mean, round(between_skill_variance, 6) as between_skill_variance from shrunk_v"))
def shrunk_parameters(spark, sf):
    t = transformed(spark, sf)
    return rounded(bayes.shrink(t, bayes.hyperparameters(t)))


@register("j4_mastery_prevalence", bquery("select skill_id, round(empirical_accuracy, 9) as empirical_accuracy, p0, p1, round(implied_mastery_prevalence, 9) as implied_mastery_prevalence from prev_v"))
def mastery_prevalence(spark, sf):
    return rounded(bayes.mastery_prevalence(V.bank(spark, sf), V.bank_skills(spark, sf)), digits=9)


@register("j5_smoothed_accuracy", bquery("select question_id, round((correct_rows + 0.5::double) / (interaction_rows + 1), 9) as smoothed_accuracy from bank_v"))
def smoothed_accuracy(spark, sf):
    return V.bank(spark, sf).select("question_id", R(bayes.smoothed_accuracy()).alias("smoothed_accuracy"))


@register("j6_item_shift_root", bquery("select question_id, skill_id, round(raw_item_shift, 8) as raw_item_shift from shift_v"))
def item_shift_root(spark, sf):
    bank = materialise(V.bank(spark, sf))
    shifts = bayes.item_shifts(bank, materialise(bayes.mastery_prevalence(bank, V.bank_skills(spark, sf))))
    return shifts.select("question_id", "skill_id", R("raw_item_shift", 8).alias("raw_item_shift"))


@register("j7_item_shift_error", bquery("select question_id, skill_id, round(item_shift_se, 8) as item_shift_se from shift_v"))
def item_shift_error(spark, sf):
    bank = materialise(V.bank(spark, sf))
    shifts = bayes.item_shifts(bank, materialise(bayes.mastery_prevalence(bank, V.bank_skills(spark, sf))))
    return shifts.select("question_id", "skill_id", R("item_shift_se", 8).alias("item_shift_se"))


_EFFECT = ["smoothed_accuracy", "raw_item_shift", "item_shift_se", "item_shift_shrinkage", "shrunk_item_shift", "implied_mastery_prevalence", "item_prior_variance"]


@register("j8_item_effects", bquery("select question_id, skill_id, interaction_rows, correct_rows, " + ", ".join(f"round({c}, 7) as {c}" for c in _EFFECT) + " from effect_v"))
def item_effects(spark, sf):
    return rounded(V.effects(spark, sf).select("question_id", "skill_id", "interaction_rows", "correct_rows", *_EFFECT), digits=7)


@register("e10_item_holdout", bquery("select question_id, skill_id, set from held_v"))
def item_holdout(spark, sf):
    return bayes.item_holdout(rounded_effects(spark, sf)).select("question_id", "skill_id", "set")


@register("e11_difficulty_bins", bquery("select question_id, skill_id, set, item_bin from binned_v"))
def difficulty_bins(spark, sf):
    return binned(spark, sf).select("question_id", "skill_id", "set", "item_bin")


@register("j9_bin_summary", bquery("select * replace (round(representative_shift, 7) as representative_shift, round(rms_item_se, 7) as rms_item_se) from binsum_v"))
def bin_summary(spark, sf):
    return rounded(bayes.bin_summary(binned(spark, sf)), digits=7)


@register("j9_structural_bins", bquery("""select skill_id, item_bin, round(max(representative_shift) filter (where set = 'practice'), 7) as practice_representative_shift, max(n_items) filter (where set = 'practice') as practice_n_items,
 round(max(representative_shift) filter (where set = 'test'), 7) as test_representative_shift, max(n_items) filter (where set = 'test') as test_n_items from binsum_v group by 1, 2"""))
def structural_bins(spark, sf):
    return rounded(bayes.structural_bins(bayes.bin_summary(binned(spark, sf))), digits=7)


_UNC = ["weighted_rms_se", "weighted_mean_se", "weighted_mean_posterior_sd", "rms_to_mean_se_ratio", "rms_to_posterior_sd_ratio"]


@register("j10_bin_uncertainty", bquery("select skill_id, set, item_bin, n_items, " + ", ".join(f"round({c}, 6) as {c}" for c in _UNC) + " from unc_v"))
def bin_uncertainty(spark, sf):
    return rounded(bayes.bin_uncertainty(binned(spark, sf)))


@register("j10_bin_uncertainty_summary", bquery("""select comparison, count(*) as n_cells, round(avg(r), 6) as mean_ratio, round(quantile_cont(r, 0.5), 6) as median_ratio, round(quantile_cont(r, 0.95), 6) as q95_ratio, round(max(r), 6) as max_ratio
 from (select 'rms / weighted-mean SE' as comparison, rms_to_mean_se_ratio as r from unc_v union all select 'rms / posterior SD', rms_to_posterior_sd_ratio from unc_v) group by 1"""))
def bin_uncertainty_summary(spark, sf):
    return rounded(bayes.bin_uncertainty_summary(bayes.bin_uncertainty(binned(spark, sf))))


@register("j11_boundary_floor_sweep", bquery("""select f::double as guess_boundary_se_floor, round(avg(g), 6) as mean_shrunk_guess, round(min(g), 6) as min_shrunk_guess, round(max(g), 6) as max_shrunk_guess, round(stddev_samp(g), 6) as sd_shrunk_guess
 from (select f, 1 / (1 + exp(-(w * y + (1 - w) * global_transformed_mean))) as g from (select *, between_skill_variance / (between_skill_variance + pow(case when boundary then greatest(se, f) else se end, 2)) as w
  from trans_v join hyper_v using (parameter), (select unnest([0.35, 0.55, 0.75]) as f) where parameter = 'guess')) group by 1"""))
def boundary_floor_sweep(spark, sf):
    t = transformed(spark, sf)
    return rounded(bayes.boundary_floor_sweep(t, bayes.hyperparameters(t)))


@register("j12_wide_parameters", bquery("select skill_id, " + ", ".join(f"round(max(shrunk_value) filter (where parameter = '{p}'), 6) as {p}, round(max(transformed_se) filter (where parameter = '{p}'), 6) as se_{p}" for p in PARAMS) + " from shrunk_v group by 1"))
def wide_parameters(spark, sf):
    t = transformed(spark, sf)
    return rounded(bayes.require_valid_parameters(materialise(bayes.wide_parameters(bayes.shrink(t, bayes.hyperparameters(t))))))


@register("c10_skill_bin_grid", bquery("select s.skill_id, b.i::integer as item_bin, coalesce(n_items, 0) as n_items from (select distinct skill_id from bank_v) s cross join range(9) b(i) left join binsum_v v on v.skill_id = s.skill_id and v.item_bin = b.i and v.set = 'practice'"))
def skill_bin_grid(spark, sf):
    bins = materialise(bayes.bin_summary(binned(spark, sf))).where(F.col("set") == "practice")
    grid = bins.select("skill_id").distinct().withColumn("item_bin", F.explode(F.sequence(F.lit(0), F.lit(8))))
    joined = grid.join(bins, ["skill_id", "item_bin"], "left")
    return joined.select("skill_id", "item_bin", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))


@register("b11_eligible_items", bquery("select question_id, skill_id from bank_v where interaction_rows >= 20"))
def eligible_items(spark, sf):
    marked = V.bank(spark, sf).withColumn("eligible_item", F.col("interaction_rows") >= 20)
    return marked.where("eligible_item").select("question_id", "skill_id")


_BOTH_SETS = "case when f = 1 and interaction_rows % 3 = 0 then ['practice', 'test'] else [set] end"


@register("g2_disjoint_holdout", bquery(f"select case f when 0 then 'as built' else 'broken' end as input, count(*) filter (where k > 1) as shared_items from (select f, question_id, count(distinct s) as k from (select f, question_id, unnest({_BOTH_SETS}) as s from held_v, (select unnest([0, 1]) as f)) group by 1, 2) group by 1"))
def disjoint_holdout(spark, sf):
    held = materialise(bayes.item_holdout(rounded_effects(spark, sf)).select("question_id", "set", "interaction_rows"))
    sets = F.when(F.col("interaction_rows") % 3 == 0, F.array(F.lit("practice"), F.lit("test"))).otherwise(F.array("set"))
    reports = []
    for name, rows in (("as built", held), ("broken", held.withColumn("set", F.explode(sets)))):
        ids = [rows.where(F.col("set") == s).select("question_id") for s in ("practice", "test")]
        reports.append(ids[0].intersect(ids[1]).agg(F.count(F.lit(1)).alias("shared_items")).select(F.lit(name).alias("input"), "*"))
    return reports[0].unionByName(reports[1])
