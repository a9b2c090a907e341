"""Empirical-Bayes hyperparameters, shrinkage and item difficulty shifts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.numeric import clip, expit, logit, weighted_mean
from tracewell.operators.skew import lookup_join, materialise, prefix

# Parameter order and calibration constants.
PARAMETERS = ["p_init", "p_learn", "slip", "guess", "lambda_per_day"]
GUESS_BOUNDARY = 0.48
BOUNDARY_SE_FLOOR = 0.55
GUESS_ENDPOINT_CAP = 0.47


def transformed_parameters(fits: DataFrame) -> DataFrame:
    """Long table (skill_id, parameter, raw_value, y, se, boundary) of the BKT-F fits:
    logit scale for probabilities, log scale for the forgetting rate, delta-method errors."""
    chosen = fits.where(F.col("model") == "BKT-F")
    long = chosen.select(
        "skill_id",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).alias("parameter"), F.col(p).alias("raw_value"), F.col(f"se_{p}_approx").alias("raw_se"))
                    for p in PARAMETERS
                ]
            )
        ).alias("e"),
    ).select("skill_id", "e.*")
    raw, is_rate = F.col("raw_value"), F.col("parameter") == "lambda_per_day"
    floor = F.lit(1e-12)
    return long.select(
        "skill_id",
        "parameter",
        "raw_value",
        F.when(is_rate, F.ln(F.greatest(raw, floor))).otherwise(logit(raw)).alias("y"),
        (F.col("raw_se") / F.when(is_rate, F.greatest(raw, floor)).otherwise(F.greatest(raw * (1 - raw), floor))).alias("se"),
        ((F.col("parameter") == "guess") & (raw >= GUESS_BOUNDARY)).alias("boundary"),
    )


_GRID = 1000
_GRID_ROWS = 1000
_PROFILE = ["log_v", "w", "wy", "wyy", "w2", "w2y", "w2yy"]


def _profile(values: DataFrame, group: str) -> DataFrame:
    """(group, i, log_tau2, sums of _PROFILE) at ``_GRID`` points from low to high of every group.

    ``values`` has group, y, se, low and high. A task keeps the whole grid of sums of a group as
    one array and adds its rows to it, so the rows are read once and none is repeated by points."""
    at = values.select(group, "y", "se", "low", "high")
    share = np.arange(_GRID) / (_GRID - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def rows() -> pa.RecordBatch:
            keys = pa.array(np.repeat(np.arange(len(held)), _GRID))
            logs, sums = (np.concatenate(x, axis=-1) for x in zip(*held.values()))
            names = pa.array(list(held), at_type).take(keys)
            held.clear()
            columns = [names, pa.array(np.tile(np.arange(_GRID, dtype=np.int32), len(keys) // _GRID)), pa.array(logs), *map(pa.array, sums)]
            return pa.RecordBatch.from_arrays(columns, [group, "i", "log_tau2", *_PROFILE])

        at_type = None
        for batch in batches:
            at_type = batch.schema.types[0]
            coded = batch.column(0).dictionary_encode()
            y, se, low, high = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for code, key in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                logs = low[own[0]] + (high[own[0]] - low[own[0]]) * share
                total = held.setdefault(key, (logs, np.zeros((len(_PROFILE), _GRID))))[1]
                for a in range(0, len(own), _GRID_ROWS):
                    part = own[a : a + _GRID_ROWS]
                    v, d = np.exp(logs)[:, None] + se[part] ** 2, y[part]
                    w = 1.0 / v
                    total += np.stack([np.log(v).sum(1), w.sum(1), w @ d, w @ (d * d), (w * w).sum(1), (w * w) @ d, (w * w) @ (d * d)])
            if len(held) > 200:
                yield rows()
        if held:
            yield rows()

    kind = at.schema[group].dataType.simpleString()
    parts = at.mapInArrow(work, f"{group} {kind}, i int, log_tau2 double, " + ", ".join(f"{n} double" for n in _PROFILE))
    return parts.groupBy(group, "i", "log_tau2").agg(*[F.sum(n).alias(n) for n in _PROFILE])


def reml(values: DataFrame, group: str = "parameter") -> DataFrame:
    """Restricted maximum likelihood of y ~ N(mu, se^2 + tau^2) for every group at once.

    The profile over a log-spaced grid of tau^2 is one aggregate; a second one covers the two
    steps around its least point, where the root of the slope is interpolated. Needs three rows
    per group."""
    sums = materialise(values.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.var_samp("y").alias("v"), F.avg("y").alias("centre")))
    if not sums.where(F.col("n") < 3).isEmpty():
        raise ValueError("at least three non-boundary rows per group are required")
    upper = F.greatest(F.lit(20.0) * F.col("v"), F.lit(1.0))
    bracket = sums.select(group, "centre", F.lit(math.log(1e-12)).alias("low"), F.ln(upper).alias("high"))
    # y is centred on the group mean, which keeps the sums well scaled.
    stored = materialise(lookup_join(values.select(group, "y", "se"), sums.select(group, "centre"), [group], "inner").withColumn("y", F.col("y") - F.col("centre")).drop("centre"))
    mu = F.col("wy") / F.col("w")
    objective = F.lit(0.5) * (F.col("log_v") + F.ln("w") + F.col("wyy") - F.col("wy") * mu)
    # Its slope over log tau^2, up to the positive factor tau^2 / 2.
    slope = F.col("w") - F.col("w2") / F.col("w") - (F.col("w2yy") - 2 * mu * F.col("w2y") + mu * mu * F.col("w2"))
    neighbours = Window.partitionBy(group).orderBy("i")  # the grid of one group
    for _ in range(2):
        profile = _profile(lookup_join(stored, bracket, [group], "inner"), group).select(group, "i", "log_tau2", mu.alias("mu"), objective.alias("objective"), slope.alias("slope"))
        beside = {f"{side}_{c}": f(c).over(neighbours) for side, f in (("a", F.lag), ("b", F.lead)) for c in ("log_tau2", "mu", "slope")}
        best = profile.withColumns(beside).groupBy(group).agg(F.min_by(F.struct("log_tau2", "mu", "slope", *beside), F.struct("objective", "i")).alias("p"))
        bracket = materialise(best.select(group, "p.*", F.coalesce("p.a_log_tau2", "p.log_tau2").alias("low"), F.coalesce("p.b_log_tau2", "p.log_tau2").alias("high")))
    before = F.col("slope") > 0
    other = {c: F.when(before, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")) for c in ("log_tau2", "mu", "slope")}
    way = F.when(other["slope"] * F.col("slope") < 0, F.col("slope") / (F.col("slope") - other["slope"])).otherwise(F.lit(0.0))
    between = lambda c: F.col(c) + way * (F.coalesce(other[c], F.col(c)) - F.col(c))
    found = bracket.select(group, between("mu").alias("mu"), F.exp(between("log_tau2")).alias("between_skill_variance"))
    joined = found.join(sums, group)
    return joined.select(group, (F.col("mu") + F.col("centre")).alias("global_transformed_mean"), "between_skill_variance")


def hyperparameters(transformed: DataFrame) -> DataFrame:
    """REML mean and variance per parameter, boundary guesses left out, with row counts."""
    counts = transformed.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n_skills"),
        F.count_if(~F.col("boundary")).alias("n_used_for_hyperparameter_fit"),
        F.count_if("boundary").alias("n_boundary_excluded"),
    )
    return counts.join(reml(transformed.where(~F.col("boundary"))), "parameter")


def shrink(transformed: DataFrame, hyper: DataFrame, se_floor: Column | float = BOUNDARY_SE_FLOOR) -> DataFrame:
    """Shrink every estimate towards its parameter mean on the transformed scale."""
    floor = se_floor if isinstance(se_floor, Column) else F.lit(float(se_floor))
    # One row per parameter: five rows by construction.
    joined = transformed.join(
        F.broadcast(hyper.select("parameter", "global_transformed_mean", "between_skill_variance")), "parameter"
    )
    se = F.when(F.col("boundary"), F.greatest(F.col("se"), floor)).otherwise(F.col("se"))
    tau2, mu = F.col("between_skill_variance"), F.col("global_transformed_mean")
    weight = tau2 / (tau2 + F.col("transformed_se") * F.col("transformed_se"))
    value = weight * F.col("y") + (F.lit(1.0) - weight) * mu
    shrunk = F.when(F.col("parameter") == "lambda_per_day", F.exp(value)).otherwise(expit(value))
    return joined.withColumn("transformed_se", se).withColumn("shrunk_value", shrunk).drop("y", "se", "boundary")


def boundary_floor_sweep(transformed: DataFrame, hyper: DataFrame, floors=(0.35, 0.55, 0.75)) -> DataFrame:
    """Spread of the shrunk guess parameter for several boundary error floors."""
    swept = transformed.where(F.col("parameter") == "guess").withColumn(
        "guess_boundary_se_floor", F.explode(F.array(*[F.lit(float(f)) for f in floors]))
    )
    shrunk = shrink(swept, hyper, F.col("guess_boundary_se_floor"))
    v = F.col("shrunk_value")
    return shrunk.groupBy("guess_boundary_se_floor").agg(
        F.avg(v).alias("mean_shrunk_guess"), F.min(v).alias("min_shrunk_guess"),
        F.max(v).alias("max_shrunk_guess"), F.stddev_samp(v).alias("sd_shrunk_guess"),
    )


def wide_parameters(shrunk: DataFrame) -> DataFrame:
    """One row per skill with the five parameters and their errors."""
    at = lambda p, c: F.max(F.when(F.col("parameter") == p, F.col(c)))
    return shrunk.groupBy("skill_id").agg(
        *[at(p, "shrunk_value").alias(p) for p in PARAMETERS], *[at(p, "transformed_se").alias(f"se_{p}") for p in PARAMETERS]
    )


def require_valid_parameters(wide: DataFrame) -> DataFrame:
    inside = lambda c: (F.col(c) > 0) & (F.col(c) < 1)
    good = inside("p_init") & inside("p_learn") & (F.col("slip") + F.col("guess") < 0.98) & F.col("lambda_per_day").isNotNull()
    bad = wide.where(~F.coalesce(good, F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("skill parameters missing or out of range")
    return wide


def mastery_prevalence(items: DataFrame, skills: DataFrame) -> DataFrame:
    """Share of masters that reproduces each skill's overall accuracy (skills: skill_id, guess, slip)."""
    totals = items.groupBy("skill_id").agg((F.sum("correct_rows") / F.sum("interaction_rows")).alias("empirical_accuracy"))
    p0 = F.least(F.col("guess"), F.lit(GUESS_ENDPOINT_CAP))
    joined = totals.join(skills.select("skill_id", p0.alias("p0"), (F.lit(1.0) - F.col("slip")).alias("p1")), "skill_id")
    share = clip((F.col("empirical_accuracy") - F.col("p0")) / (F.col("p1") - F.col("p0")), 0.0, 1.0)
    return joined.withColumn("implied_mastery_prevalence", share)


def smoothed_accuracy() -> Column:
    return (F.col("correct_rows") + 0.5) / (F.col("interaction_rows") + 1.0)


def shift_root(target: Column, q: Column, p0: Column, p1: Column) -> Column:
    """d with (1-q) expit(logit p0 + d) + q expit(logit p1 + d) = target.

    With a, b the odds of p0, p1 and z = e^d this is a quadratic whose roots have opposite
    signs; the positive one is written without cancellation for either sign of the middle
    coefficient."""
    one = F.lit(1.0)
    a, b = p0 / (one - p0), p1 / (one - p1)
    square = a * b * (one - target)
    middle = (one - q) * a + q * b - target * (a + b)
    disc = F.sqrt(middle * middle + F.lit(4.0) * square * target)
    z = F.when(middle >= 0, F.lit(2.0) * target / (middle + disc)).otherwise((disc - middle) / (F.lit(2.0) * square))
    return F.ln(z)


def item_shifts(items: DataFrame, prevalence: DataFrame) -> DataFrame:
    """Raw difficulty shift and its delta-method error per item."""
    q, n, t = F.col("implied_mastery_prevalence"), F.col("interaction_rows"), F.col("smoothed_accuracy")
    joined = lookup_join(items, prevalence.select("skill_id", "p0", "p1", "implied_mastery_prevalence"), ["skill_id"], "inner")
    solved = joined.withColumn("smoothed_accuracy", smoothed_accuracy()).withColumn(
        "raw_item_shift", shift_root(t, q, F.col("p0"), F.col("p1"))
    )
    at = lambda p: expit(logit(F.col(p), 1e-15) + F.col("raw_item_shift"))
    ends = solved.withColumns({"__e0": at("p0"), "__e1": at("p1")})
    slope = (F.lit(1.0) - q) * F.col("__e0") * (1 - F.col("__e0")) + q * F.col("__e1") * (1 - F.col("__e1"))
    return ends.withColumn("item_shift_se", F.sqrt(t * (1 - t) / (n + 1.0)) / slope).drop("__e0", "__e1", "p0", "p1")


def item_effects(items: DataFrame, skills: DataFrame) -> DataFrame:
    """Shrunk, centred item shifts. Per-skill moments are small tables joined back by skill."""
    raw = item_shifts(items, materialise(mastery_prevalence(items, skills)))
    n, d, se = F.col("interaction_rows"), F.col("raw_item_shift"), F.col("item_shift_se")
    means = raw.groupBy("skill_id").agg(weighted_mean(d, n).alias("__m"), weighted_mean(se * se, n).alias("__s2"))
    centred = lookup_join(raw, materialise(means), ["skill_id"], "inner")
    spread = centred.groupBy("skill_id").agg(
        weighted_mean((d - F.col("__m")) * (d - F.col("__m")), n).alias("__v"), F.max("__s2").alias("__s2")
    )
    prior = spread.select("skill_id", F.greatest(F.col("__v") - F.col("__s2"), F.lit(1e-8)).alias("item_prior_variance"))
    pulled = lookup_join(raw, materialise(prior), ["skill_id"], "inner").withColumn(
        "item_shift_shrinkage", F.col("item_prior_variance") / (F.col("item_prior_variance") + se * se)
    )
    centre = pulled.groupBy("skill_id").agg(weighted_mean(d, n * F.col("item_shift_shrinkage")).alias("__centre"))
    out = lookup_join(pulled, materialise(centre), ["skill_id"], "inner")
    return out.withColumn("shrunk_item_shift", F.col("item_shift_shrinkage") * (d - F.col("__centre"))).drop("__centre")


def holdout_offset(skill: Column) -> Column:
    digest = F.substring(F.sha2(F.concat(F.lit("skill:"), skill.cast("string")), 256), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(5))


def item_holdout(effects: DataFrame) -> DataFrame:
    """Difficulty-stratified 20 % item holdout: every fifth item by (shift, id) within its skill."""
    ranked = prefix(effects, ["skill_id"], ["shrunk_item_shift", "question_id"], count="__rank")
    is_test = F.col("__rank") % 5 == holdout_offset(F.col("skill_id"))
    return ranked.withColumn("set", F.when(is_test, "test").otherwise("practice")).drop("__rank")


def difficulty_bins(held: DataFrame, n_bins: int = 9) -> DataFrame:
    """Bin number per (skill, set): floor(position * n_bins / size), easiest ranking first."""
    keyed = held.withColumn("__rows", -F.col("interaction_rows"))
    placed = prefix(
        keyed, ["skill_id", "set"], ["shrunk_item_shift", "__rows", "question_id"], count="__i", totals={"__n": F.lit(1)}
    )
    number = F.least(F.floor(F.col("__i") * n_bins / F.col("__n")), F.lit(n_bins - 1)).cast("int")
    return placed.withColumn("item_bin", number).drop("__i", "__n", "__rows")


def bin_summary(binned: DataFrame) -> DataFrame:
    """Weighted centre, item and interaction counts, and RMS error per bin."""
    w = F.sqrt(F.greatest(F.col("interaction_rows").cast("double"), F.lit(1.0)))
    se = F.greatest(F.col("item_shift_se"), F.lit(1e-6))
    return binned.groupBy("skill_id", "set", "item_bin").agg(
        weighted_mean(F.col("shrunk_item_shift"), w).alias("representative_shift"),
        F.count(F.lit(1)).alias("n_items"),
        F.sum("interaction_rows").cast("long").alias("bin_interactions"),
        F.sqrt(weighted_mean(se * se, w)).alias("rms_item_se"),
    )


def structural_bins(summary: DataFrame) -> DataFrame:
    """One row per (skill, bin) with practice and test centres and counts."""
    at = lambda s, c: F.max(F.when(F.col("set") == s, F.col(c)))
    return summary.groupBy("skill_id", "item_bin").agg(
        at("practice", "representative_shift").alias("practice_representative_shift"),
        at("practice", "n_items").alias("practice_n_items"),
        at("test", "representative_shift").alias("test_representative_shift"),
        at("test", "n_items").alias("test_n_items"),
    )


def bin_uncertainty(binned: DataFrame) -> DataFrame:
    """RMS error, error of the weighted mean and posterior deviation per bin, and ratios."""
    w = F.sqrt(F.greatest(F.col("interaction_rows").cast("double"), F.lit(1.0)))
    se = F.greatest(F.col("item_shift_se"), F.lit(1e-12))
    prior = F.greatest(F.col("item_prior_variance"), F.lit(1e-12))
    posterior = se * se * prior / (prior + se * se)
    rms = F.sqrt(weighted_mean(se * se, w))
    out = binned.groupBy("skill_id", "set", "item_bin").agg(
        F.count(F.lit(1)).alias("n_items"),
        rms.alias("weighted_rms_se"),
        (F.sqrt(F.sum(w * w * se * se)) / F.sum(w)).alias("weighted_mean_se"),
        (F.sqrt(F.sum(w * w * posterior)) / F.sum(w)).alias("weighted_mean_posterior_sd"),
    )
    return out.withColumns(
        {
            "rms_to_mean_se_ratio": F.col("weighted_rms_se") / F.col("weighted_mean_se"),
            "rms_to_posterior_sd_ratio": F.col("weighted_rms_se") / F.col("weighted_mean_posterior_sd"),
        }
    )


def bin_uncertainty_summary(cells: DataFrame) -> DataFrame:
    """Mean, median, 95 % point and maximum of both ratios over all cells."""
    pairs = [("rms / weighted-mean SE", "rms_to_mean_se_ratio"), ("rms / posterior SD", "rms_to_posterior_sd_ratio")]
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("comparison"), F.col(c).alias("ratio")) for n, c in pairs]))
    return cells.select(entries.alias("e")).select("e.*").groupBy("comparison").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("ratio").alias("mean_ratio"), F.percentile("ratio", 0.5).alias("median_ratio"),
        F.percentile("ratio", 0.95).alias("q95_ratio"), F.max("ratio").alias("max_ratio"),
    )


def random_effects_summary(draws: DataFrame, by: list[str]) -> DataFrame:
    """REML mean and deviation over draws with known errors (columns y, se), and the implied 2.5 % point."""
    keyed = draws.withColumn("__g", F.to_json(F.struct(*by)))
    names = keyed.select("__g", *by).distinct()
    fit = reml(keyed, "__g")
    tau = F.sqrt("between_skill_variance")
    return names.join(fit, "__g").select(
        *by, F.col("global_transformed_mean").alias("mu"), tau.alias("between_draw_tau"),
        (F.col("global_transformed_mean") - F.lit(1.959963984540054) * tau).alias("model_implied_latent_q025"),
    )
