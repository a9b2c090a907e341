"""Analytics over replicated policy experiments: pairing, intervals, ranks, sensitivity.

Input rows carry ``world_model``, ``policy``, ``replicate``, ``order_id`` and metrics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.hashing import keyed_uniform
from tracewell.functions.intervals import inversions, kendall_p_value, order_statistic_ranks, t_critical
from tracewell.operators.skew import exact_quantiles, lookup_join, materialise, prefix

CELL = ["world_model", "policy", "replicate", "order_id"]
PAIRING = ["world_model", "replicate", "order_id"]
# Initial mastery groups, upper bounds inside.
LOW_GROUP, MIDDLE_GROUP = 0.45, 0.60
GROUPS = ["low", "middle", "high"]


@F.arrow_udf(T.DoubleType())
def t_column(n: pa.Array) -> pa.Array:
    """95 % two-sided t critical value for n observations (null below two)."""
    distinct = n.dictionary_encode()
    values = [t_critical(k - 1) if k > 1 else None for k in distinct.dictionary.to_pylist()]
    return pa.array(values, pa.float64()).take(distinct.indices)


def finite(c: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    return F.when(F.abs(c) < float("inf"), c)


def interval_summary(df: DataFrame, by: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """Per group and metric: mean with a 95 % t interval and the share of positive values.

    ``metrics`` maps a column to the prefix of its outputs. Missing and non-finite values are
    left out; one value gives a zero-width interval and none gives nulls."""
    columns = []
    for column, name in metrics.items():
        v = finite(F.col(column))
        columns += [
            F.count(v).alias(f"__n_{name}"), F.avg(v).alias(f"{name}_mean"), F.stddev_samp(v).alias(f"__sd_{name}"),
            F.avg(F.when(v.isNotNull(), (v > 0).cast("double"))).alias(f"{name}_positive_fraction"),
        ]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_replicates"), *columns)
    ends = {}
    for name in metrics.values():
        n, mean = F.col(f"__n_{name}"), F.col(f"{name}_mean")
        half = F.when(n == 1, 0.0).otherwise(t_column(n) * F.col(f"__sd_{name}") / F.sqrt(n))
        ends[f"{name}_low"], ends[f"{name}_high"] = mean - half, mean + half
    helpers = [f"__{kind}_{name}" for name in metrics.values() for kind in ("n", "sd")]
    return out.withColumns(ends).drop(*helpers)


def aggregate_learners(outcomes: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Learner outcomes -> one row per cell, with counts and means by initial mastery group."""
    start = F.col("initial_latent")
    group = F.when(start <= LOW_GROUP, "low").when(start <= MIDDLE_GROUP, "middle").otherwise("high")
    grouped = outcomes.withColumn("__group", group)
    columns = [F.count(F.lit(1)).alias("n_learners")] + [F.avg(m).alias(m) for m in metrics]
    for g in GROUPS:
        member = F.col("__group") == g
        columns.append(F.count_if(member).alias(f"n_{g}"))
        columns.append(F.avg(F.when(member, F.col("delayed_latent"))).alias(f"delayed_latent_{g}"))
    return grouped.groupBy(*CELL).agg(*columns)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    if not repeated.isEmpty():
        raise ValueError(f"rows are not unique on {list(keys)}")
    return df


def paired_benefit(
    rows: DataFrame, baseline: str, metrics: Mapping[str, str], keys: Sequence[str] = PAIRING, checked: bool = True
) -> DataFrame:
    """Add metric minus the baseline policy's metric at the same keys, named by ``metrics``."""
    reference = rows.where(F.col("policy") == baseline).select(*keys, *[F.col(m).alias(f"__ref_{m}") for m in metrics])
    if checked:
        require_unique(reference, keys)
    joined = lookup_join(rows, reference, keys, "left")
    benefits = {name: F.col(m) - F.col(f"__ref_{m}") for m, name in metrics.items()}
    return joined.withColumns(benefits).drop(*[f"__ref_{m}" for m in metrics])


def order_average(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean over orders within each replicate."""
    return rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def contrast(rows: DataFrame, first: str, second: str, metric: str, keys: Sequence[str]) -> DataFrame:
    """Difference of two policies on their common keys; incomplete pairs are left out."""
    at = lambda p: F.max(F.when(F.col("policy") == p, F.col(metric)))
    wide = rows.where(F.col("policy").isin(first, second)).groupBy(*keys).agg(at(first).alias("__a"), at(second).alias("__b"))
    return wide.select(*keys, (F.col("__a") - F.col("__b")).alias("difference")).where(F.col("difference").isNotNull())


def contrast_summary(differences: DataFrame, by: Sequence[str]) -> DataFrame:
    """Interval of a contrast, in percentage points as well, and two indifference bands."""
    out = interval_summary(differences, by, {"difference": "difference"})
    mean = F.col("difference_mean")
    return out.withColumns(
        {
            "percentage_point_difference": mean * 100,
            "within_0_001_band": F.abs(mean) <= 0.001,
            "within_0_002_band": F.abs(mean) <= 0.002,
        }
    )


def policy_ranks(summary: DataFrame, value: str, by: Sequence[str] = ("world_model",)) -> DataFrame:
    """Rank of each policy by descending value; exact ties by policy name. ``tied_rank``
    gives equal values the same (smallest) rank."""
    window = Window.partitionBy(*by)
    return summary.select(
        *by, "policy", F.col(value),
        F.row_number().over(window.orderBy(F.desc(value), "policy")).alias("rank"),
        F.rank().over(window.orderBy(F.desc(value))).alias("tied_rank"),
    )


def rank_frequencies(rows: DataFrame, value: str, by: Sequence[str] = ("world_model",)) -> DataFrame:
    """How often each policy is first or in the first three of a replicate, and its mean rank.
    Every policy appears in every group; a policy absent from a replicate counts as unranked."""
    ranked = policy_ranks(rows, value, [*by, "replicate"])
    counts = ranked.groupBy(*by, "policy").agg(
        F.count_if(F.col("rank") == 1).alias("__first"), F.count_if(F.col("rank") <= 3).alias("__top"), F.sum("rank").alias("__sum")
    )
    replicates = rows.groupBy(*by).agg(F.count_distinct("replicate").alias("n_replications"))
    grid = replicates.crossJoin(rows.select("policy").distinct())
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("n_replications")
    return grid.join(counts, [*by, "policy"], "left").select(
        *by, "policy", "n_replications", share("__first").alias("rank1_frequency"),
        share("__top").alias("top3_frequency"), share("__sum").alias("mean_replication_rank"),
    )


def rank_pairs(ranks: DataFrame) -> DataFrame:
    """Ranks of the same policy in two worlds, each unordered world pair once."""
    a = ranks.select(F.col("world_model").alias("world_1"), "policy", F.col("rank").alias("rank_1"))
    b = ranks.select(F.col("world_model").alias("world_2"), "policy", F.col("rank").alias("rank_2"))
    return a.join(b, "policy").where(F.col("world_1") < F.col("world_2"))


@F.arrow_udf(T.StructType([T.StructField("discordant", T.LongType()), T.StructField("p_value", T.DoubleType())]))
def _discordance(ranks: pa.Array) -> pa.Array:
    """Inversions of each list of ranks, and the exact p-value of as many."""
    rows = []
    for r in ranks.to_pylist():
        d = inversions(r)
        rows.append({"discordant": d, "p_value": kendall_p_value(len(r), d)})
    return pa.array(rows, pa.struct([("discordant", pa.int64()), ("p_value", pa.float64())]))


def rank_concordance(ranks: DataFrame) -> DataFrame:
    """Kendall's tau between the policy ranks of every two worlds (no ties), with its exact p-value."""
    # A list of the policies per world pair: the ranks in the second world, ordered by the first.
    entries = F.array_sort(F.collect_list(F.struct("rank_1", "rank_2")))
    lists = rank_pairs(ranks).groupBy("world_1", "world_2").agg(F.transform(entries, lambda e: e["rank_2"]).alias("r"))
    n, d = F.col("n_policies"), F.col("found.discordant")
    found = lists.select("world_1", "world_2", F.size("r").cast("long").alias("n_policies"), _discordance("r").alias("found"))
    tau = F.lit(1.0) - F.lit(4.0) * d / (n * (n - 1))
    return found.select("world_1", "world_2", "n_policies", tau.alias("kendall_tau"), F.col("found.p_value").alias("kendall_p_value"))


def robustness(summary: DataFrame, value: str, baseline: str) -> DataFrame:
    """Spread of a policy's mean across worlds; the positive share is null for the baseline."""
    v = F.col(value)
    return summary.groupBy("policy").agg(
        F.avg(v).alias("mean_across_worlds"), F.min(v).alias("minimum_across_worlds"), F.max(v).alias("maximum_across_worlds"),
        F.stddev_samp(v).alias("world_disagreement_sd"),
        F.avg(F.when(F.col("policy") != baseline, (v > 0).cast("double"))).alias("positive_world_fraction"),
    )


def subgroup_benefit(cells: DataFrame, baseline: str) -> DataFrame:
    """Benefit by initial mastery group: paired per order, averaged per replicate, with interval."""
    names = {f"delayed_latent_{g}": f"__b_{g}" for g in GROUPS}
    paired = paired_benefit(cells, baseline, names)
    entries = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"__b_{g}").alias("v")) for g in GROUPS]))
    long = paired.select("world_model", "policy", "replicate", entries.alias("e"))
    per_replicate = long.groupBy("world_model", "policy", F.col("e.g").alias("initial_group"), "replicate").agg(F.avg("e.v").alias("benefit"))
    kept = per_replicate.where(finite(F.col("benefit")).isNotNull())
    return interval_summary(kept, ["world_model", "policy", "initial_group"], {"benefit": "benefit"})


def order_sensitivity(paired: DataFrame, value: str) -> DataFrame:
    """Mean and deviation over replicates for each order."""
    return paired.groupBy("world_model", "policy", "order_id").agg(
        F.avg(value).alias("benefit_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("benefit_sd_across_replicates")
    )


def order_range(sensitivity: DataFrame) -> DataFrame:
    m = F.col("benefit_mean")
    return sensitivity.groupBy("world_model", "policy").agg(
        F.avg(m).alias("order_mean"), F.min(m).alias("order_min"), F.max(m).alias("order_max"), F.stddev_samp(m).alias("order_sd")
    )


def factorial_summary(differences: DataFrame) -> DataFrame:
    """Order x replicate design: interval over replicates (averaged over orders) next to the
    spread of order means. Input: world_model, replicate, order_id, difference."""
    per_replicate = differences.groupBy("world_model", "replicate").agg(F.avg("difference").alias("difference"))
    per_order = differences.groupBy("world_model", "order_id").agg(F.avg("difference").alias("m"))
    orders = per_order.groupBy("world_model").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg((F.col("m") > 0).cast("double")).alias("positive_order_fraction"),
        F.min("m").alias("minimum_order_mean"), F.max("m").alias("maximum_order_mean"),
    )
    return interval_summary(per_replicate, ["world_model"], {"difference": "contrast"}).join(orders, "world_model")


def sensitivity_summary(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Average orders within replicates, then intervals over replicates per ``keys`` and policy."""
    averaged = order_average(rows, [*keys, "policy", "replicate"], metrics)
    return interval_summary(averaged, [*keys, "policy"], {m: m for m in metrics})


def rank_order(summary: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Policies of each cell from best to worst as ``a > b > c``, the best and the runner-up."""
    entry = F.struct((-F.col(value)).alias("v"), F.col("policy").alias("policy"))
    ordered = summary.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("o"))
    return ordered.select(
        *keys, F.array_join(F.transform("o", lambda e: e.policy), " > ").alias("rank_order"),
        F.get("o", F.lit(0)).policy.alias("best_policy"), F.get("o", F.lit(1)).policy.alias("runner_up"),
    )


def resolved_best(rows: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Is the best policy of a cell better than the runner-up beyond replication noise?"""
    averaged = order_average(rows, [*keys, "policy", "replicate"], [metric])
    means = averaged.groupBy(*keys, "policy").agg(F.avg(metric).alias(metric))
    order = rank_order(means, keys, metric)
    placed = averaged.join(order, list(keys))
    at = lambda c: F.max(F.when(F.col("policy") == F.col(c), F.col(metric)))
    pairs = placed.groupBy(*keys, "replicate").agg((at("best_policy") - at("runner_up")).alias("d")).where(F.col("d").isNotNull())
    lead = interval_summary(pairs, keys, {"d": "best_minus_runner_up"})
    return order.join(lead, list(keys)).withColumn("resolved_best", F.col("best_minus_runner_up_low") > 0)


def stress_cells(rows: DataFrame, draw: str, value: str, by: Sequence[str]) -> DataFrame:
    """Orders -> cohorts -> draws: draw means with the deviation and error between cohorts."""
    cohorts = rows.groupBy(*by, draw, "replicate").agg(F.avg(value).alias("__v"), F.count_distinct("order_id").alias("__orders"))
    draws = cohorts.groupBy(*by, draw).agg(
        F.avg("__v").alias("draw_mean"), F.coalesce(F.stddev_samp("__v"), F.lit(0.0)).alias("within_draw_sd"),
        F.count_distinct("replicate").alias("n_cohorts"), F.min("__orders").alias("n_orders"),
    )
    return draws.withColumn("within_draw_se", F.col("within_draw_sd") / F.sqrt(F.greatest(F.col("n_cohorts"), F.lit(1))))


def stress_summary(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spread over draws: mean, 2.5/97.5 % points, positive share, and Monte Carlo error beside it."""
    by, v = list(by), F.col("draw_mean")
    base = draws.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_draws"), F.min("n_cohorts").alias("cohorts_per_draw"), F.min("n_orders").alias("orders_per_cohort"),
        F.avg(v).alias("mean_over_draws"), F.avg((v > 0).cast("double")).alias("positive_draw_fraction"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("between_draw_sd"),
    )
    at = lambda i: F.get("quantiles", F.lit(i))
    tails = exact_quantiles(draws, by, "draw_mean", (0.025, 0.975)).select(*by, at(0).alias("q025"), at(1).alias("q975"))
    sd = exact_quantiles(draws, by, "within_draw_sd", (0.5,)).select(*by, at(0).alias("median_within_draw_sd"))
    se = exact_quantiles(draws, by, "within_draw_se", (0.5,)).select(*by, at(0).alias("median_within_draw_se"))
    out = base.join(tails, by).join(sd, by).join(se, by)
    ratio = F.when(F.col("between_draw_sd") > 0, F.col("median_within_draw_se") / F.col("between_draw_sd")).otherwise(0.0)
    return out.withColumn("median_se_to_between_draw_sd", ratio)


def variant_summary(rows: DataFrame, keys: Sequence[str], value: str, rank_by: Sequence[str]) -> DataFrame:
    """Mean, deviation and range of a value over replicates, with its tied rank inside ``rank_by``."""
    out = rows.groupBy(*keys).agg(
        F.avg(value).alias("mean_benefit"), F.stddev_samp(value).alias("sd_across_replicates"),
        F.min(value).alias("min_benefit"), F.max(value).alias("max_benefit"),
    )
    rank = F.rank().over(Window.partitionBy(*rank_by).orderBy(F.desc("mean_benefit")))
    return out.withColumn("rank_within_variant", rank)


def scale_summary(draws: DataFrame, by: Sequence[str], scale: str) -> DataFrame:
    """Draw means per stress scale without the unit scale: mean, range and positive share."""
    v = F.col("draw_mean")
    return draws.where(F.col(scale) != 1.0).groupBy(*by, scale).agg(
        F.count(F.lit(1)).alias("n_draws"), F.avg(v).alias("mean_over_draws"), F.min(v).alias("minimum_draw_mean"),
        F.max(v).alias("maximum_draw_mean"), F.avg((v > 0).cast("double")).alias("positive_draw_fraction"),
    )


def keep_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[c for c in wanted if c in df.columns])


def schedule_summary(cells: DataFrame, by: Sequence[str], mean: str, low: str, high: str) -> DataFrame:
    """Number and range of schedule cells, and how many lie above or below zero."""
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_schedule_cells"), F.min(mean).alias("min_benefit"), F.max(mean).alias("max_benefit"),
        F.count_if(F.col(mean) > 0).alias("positive_cell_means"), F.count_if(F.col(low) > 0).alias("cells_interval_strictly_positive"),
        F.count_if(F.col(high) < 0).alias("cells_interval_strictly_negative"),
    )


def error_summary(rows: DataFrame, by: Sequence[str], error: str) -> DataFrame:
    e = F.abs(F.col(error))
    return rows.groupBy(*by).agg(F.avg(e).alias("mean_abs_error"), F.max(e).alias("max_abs_error"))


def tertile_thresholds(outcomes: DataFrame, value: str) -> DataFrame:
    """Tertile bounds per world and the share of learners in each group."""
    at = lambda i: F.get("quantiles", F.lit(i))
    bounds = materialise(exact_quantiles(outcomes, ["world_model"], value, (1 / 3, 2 / 3)).select("world_model", at(0).alias("lower_threshold"), at(1).alias("upper_threshold")))
    placed = lookup_join(outcomes.select("world_model", value), bounds, ["world_model"], "inner")
    v = F.col(value)
    group = F.when(v <= F.col("lower_threshold"), "low").when(v <= F.col("upper_threshold"), "middle").otherwise("high")
    counts = placed.groupBy("world_model", "lower_threshold", "upper_threshold", group.alias("quantile")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("world_model"))
    return counts.withColumn("prevalence", F.col("n") / total)


def bootstrap_quantile(values: DataFrame, by: Sequence[str], value: str, q: float, seed: int, resamples: int = 1000) -> DataFrame:
    """2.5 and 97.5 % points of a quantile over resamples drawn with a keyed hash.

    A resample's quantile needs two of its order statistics only. Those of n uniform numbers
    follow each other by exponential spacings (1 - U_k is the product of the first k keyed
    uniforms V_j to the power 1 / (n - j)), so they are drawn directly: no row meets a resample
    but the two whose places come out. Groups of fewer than two values give nulls."""
    by = list(by)
    keyed = values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    tagged = keyed.withColumn("__t", F.monotonically_increasing_id())
    numbered = materialise(prefix(materialise(tagged), by, ["__v", "__t"], count="__i"))
    at = F.lit(float(q)) * (F.col("__n") - 1)
    sizes = materialise(numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")))
    key = F.conv(F.substring(F.sha2(F.concat_ws("|", *by), 256), 1, 8), 16, 10).cast("long")
    planned = sizes.where(F.col("__n") >= 2).select(*by, "__n", F.floor(at).alias("__lo"), (at - F.floor(at)).alias("__part"), key.alias("__key"))
    drawn = planned.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__lo") + 1)))
    term = F.ln(F.greatest(keyed_uniform(seed, 0, "__j", 0, "__b", "__key"), F.lit(2.0**-54))) / (F.col("__n") - F.col("__j"))
    ends = drawn.where("__j < __n").groupBy(*by, "__n", "__part", "__b").agg(F.sum(F.when(F.col("__j") <= F.col("__lo"), term)).alias("__s0"), F.sum(term).alias("__s1"))
    place = lambda s: F.least(F.floor((1 - F.exp(s)) * F.col("__n")), F.col("__n") - 1)
    wanted = ends.select(*by, "__b", "__part", F.posexplode(F.array(place(F.col("__s0")), place(F.col("__s1")))).alias("__end", "__i"))
    found = wanted.join(numbered.select(*by, "__i", "__v"), [*by, "__i"])
    side = lambda e: F.max(F.when(F.col("__end") == e, F.col("__v")))
    each = found.groupBy(*by, "__b", "__part").agg(side(0).alias("__v0"), side(1).alias("__v1"))
    quantile = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.col("__part")
    # ``resamples`` rows a group.
    points = each.groupBy(*by).agg(F.percentile(quantile, F.array(F.lit(0.025), F.lit(0.975))).alias("__q"))
    spread = points.select(*by, F.get("__q", F.lit(0)).alias("stability_low"), F.get("__q", F.lit(1)).alias("stability_high"))
    return sizes.select(*by).join(spread, by, "left")


def order_statistic_interval(values: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """Distribution-free interval of a quantile from two order statistics, with its coverage."""
    by = list(by)
    present = materialise(values.where(F.col(value).isNotNull()).withColumn("__t", F.monotonically_increasing_id()))
    ranked = prefix(present, by, [value, "__t"], count="__i", totals={"n_draws": F.lit(1)})
    sizes = [r.n for r in present.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select("n").distinct().toLocalIterator()]
    bounds = values.sparkSession.createDataFrame(
        [(n, *order_statistic_ranks(n, q)) for n in sizes], "n_draws long, rank_low long, rank_high long, nominal_coverage double"
    )
    placed = lookup_join(ranked, bounds, ["n_draws"], "inner")
    at = lambda c: F.max(F.when(F.col("__i") + 1 == F.col(c), F.col(value)))
    return placed.groupBy(*by, "n_draws", "rank_low", "rank_high", "nominal_coverage").agg(
        at("rank_low").alias("value_low"), at("rank_high").alias("value_high")
    )


def benefit_matrix(summary: DataFrame, value: str, worlds: Sequence[str]) -> DataFrame:
    """Policies by rows, worlds by columns."""
    return summary.groupBy("policy").pivot("world_model", list(worlds)).agg(F.max(value))


def design_table(first: DataFrame, second: DataFrame) -> DataFrame:
    """Stack the summaries of the two order designs under a ``design`` label."""
    return first.withColumn("design", F.lit("order_average")).unionByName(second.withColumn("design", F.lit("factorial")))


def target_ranges(grid: DataFrame, by: Sequence[str], settings: Sequence[str], value: str) -> DataFrame:
    """Mean, least and greatest of the settings' means of ``value``, per ``by``."""
    cells = grid.groupBy(*by, *settings).agg(F.avg(value).alias("__m"))
    return cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_settings"), F.avg("__m").alias(f"mean_{value}"), F.min("__m").alias(f"min_{value}"), F.max("__m").alias(f"max_{value}"))
