"""Cleaned interactions -> item, skill and learner-skill statistics, samples, sequences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import bins as B
from tracewell.functions import hashing as H
from tracewell.functions.cleaning import EXCLUDED_BITS
from tracewell.operators.skew import bottom_k, exact_quantiles, lookup_join, prefix

GAP_PROBABILITIES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
PAIR = ["learner_id", "skill_id"]


@dataclass(frozen=True)
class BuildConfig:
    # Default thresholds and quotas of the published build.
    reference_skill_count: int = 20
    min_item_interactions: int = 200
    min_items_per_skill: int = 50
    min_unique_learners: int = 10_000
    min_repeat_learners: int = 2_000
    min_positive_gaps: int = 10_000
    min_item_accuracy_spread: float = 0.20
    min_skill_accuracy: float = 0.20
    max_skill_accuracy: float = 0.95
    relaxed_min_unique_learners: int = 5_000
    relaxed_min_repeat_learners: int = 1_000
    relaxed_min_positive_gaps: int = 5_000
    relaxed_min_item_accuracy_spread: float = 0.15
    repeat_train_quota: int = 5_000
    repeat_calibration_quota: int = 2_000
    repeat_test_quota: int = 2_000
    cold_quota_per_split: int = 500
    gap_sample_per_shard_skill: int | None = 200
    gap_sample_final_per_skill: int = 100_000


# Thresholds for small logs; the quotas and sample sizes stay those of the published build.
SMALL_CONFIG = BuildConfig(
    reference_skill_count=3,
    min_items_per_skill=5,
    min_unique_learners=10,
    min_repeat_learners=5,
    min_positive_gaps=10,
    min_item_accuracy_spread=0.0,
    min_skill_accuracy=0.05,
    relaxed_min_unique_learners=5,
    relaxed_min_repeat_learners=3,
    relaxed_min_positive_gaps=5,
    relaxed_min_item_accuracy_spread=0.0,
)
# Of the mean rows of an item, what one needs at least under the small thresholds.
SMALL_ITEM_SHARE = 0.9


def small_config(counts: DataFrame) -> BuildConfig:
    """The small thresholds, with an item threshold that follows the log's size."""
    mean = counts.agg(F.avg("interaction_rows")).first()[0]
    return replace(SMALL_CONFIG, min_item_interactions=int(SMALL_ITEM_SHARE * mean) if mean else 1)


def usable(cleaned: DataFrame) -> DataFrame:
    """Scorable, timestamped, single-skill rows without an excluding quality bit."""
    return cleaned.where(
        (F.col("skill_count") == 1)
        & (F.col("primary_skill_id") >= 0)
        & F.col("is_correct").isNotNull()
        & F.col("timestamp_ms").isNotNull()
        & (F.col("quality_flags").bitwiseAND(F.lit(EXCLUDED_BITS)) == 0)
    )


def item_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("interaction_rows"), F.count_if("is_correct").alias("correct_rows")
    )


def eligible_items(counts: DataFrame, questions: DataFrame, config: BuildConfig) -> DataFrame:
    """Single-skill questions with enough rows, with accuracy."""
    single = questions.where((F.col("skill_count") == 1) & (F.col("primary_skill_id") >= 0))
    busy = counts.where(F.col("interaction_rows") >= config.min_item_interactions)
    columns = single.select("question_id", F.col("primary_skill_id").alias("skill_id"), "part")
    return busy.join(columns, "question_id").withColumn("accuracy", F.col("correct_rows") / F.col("interaction_rows"))


def candidate_skills(items: DataFrame, config: BuildConfig) -> DataFrame:
    per_skill = items.groupBy("skill_id").agg(F.count(F.lit(1)).alias("eligible_items"))
    return per_skill.where(F.col("eligible_items") >= config.min_items_per_skill)


def require_enough_skills(skills: DataFrame, config: BuildConfig) -> DataFrame:
    found = skills.limit(config.reference_skill_count).count()
    if found < config.reference_skill_count:
        raise ValueError(f"only {found} skills qualify; {config.reference_skill_count} are required")
    return skills


def candidate_items(items: DataFrame, config: BuildConfig) -> DataFrame:
    """Eligible items of skills that have enough of them."""
    return items.join(candidate_skills(items, config).select("skill_id"), "skill_id", "left_semi")


def candidate_events(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose question is a candidate item."""
    kept = lookup_join(rows, items.select("question_id"), ["question_id"], "left_semi")
    return kept.withColumnRenamed("primary_skill_id", "skill_id")


def event_sequences(events: DataFrame, hot: tuple[list, int] | None = None) -> DataFrame:
    """Position and gap of every event inside its (learner, skill) sequence."""
    keyed = prefix(
        events,
        PAIR,
        ["timestamp_ms", "sequence_index"],
        count="within_skill_index",
        lasts={"__previous": F.col("timestamp_ms")},
        hot=hot,
    )
    gap = F.coalesce(F.col("timestamp_ms") - F.col("__previous"), F.lit(0).cast("long"))
    return keyed.withColumn("gap_ms", gap).drop("__previous")


def pair_groups(sequences: DataFrame) -> DataFrame:
    """Learner-skill totals with the learner's split."""
    gap = F.when(F.col("gap_ms") > 0, F.col("gap_ms"))
    groups = sequences.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if("is_correct").alias("correct_count"),
        F.min("timestamp_ms").alias("first_timestamp_ms"),
        F.max("timestamp_ms").alias("last_timestamp_ms"),
        F.count(gap).alias("positive_gap_count"),
        F.coalesce(F.max(gap), F.lit(0).cast("long")).alias("max_positive_gap_ms"),
    )
    return groups.withColumn("split_code", H.learner_split("learner_id"))


def skill_statistics(groups: DataFrame) -> DataFrame:
    n = F.col("event_count")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    in_split = lambda i: F.col("split_code") == i
    columns = [
        F.count(F.lit(1)).alias("unique_learners"),
        total("event_count").alias("interaction_rows"),
        total("correct_count").alias("correct_rows"),
        (F.sum("correct_count") / F.sum("event_count")).alias("accuracy"),
        F.count_if(n >= 2).alias("learners_2_plus"),
        F.count_if(n >= 3).alias("learners_3_plus"),
        F.count_if(n >= 5).alias("learners_5_plus"),
        total("positive_gap_count").alias("positive_gap_count"),
    ]
    columns += [F.count_if(in_split(i)).alias(f"{s}_learners") for i, s in enumerate(B.SPLITS)]
    columns += [total(F.when(in_split(i), n)).alias(f"{s}_interactions") for i, s in enumerate(B.SPLITS)]
    columns += [
        F.count_if(B.in_event_bin(n, low, high)).alias(f"learners_events_{name}")
        for name, low, high in B.EVENT_COUNT_BINS
    ]
    return groups.groupBy("skill_id").agg(*columns)


def positive_gaps(sequences: DataFrame) -> DataFrame:
    return sequences.where(F.col("gap_ms") > 0)


def gap_histogram(sequences: DataFrame, skills: DataFrame) -> DataFrame:
    """Counts per skill and bin, with zero rows for empty bins."""
    counts = (
        positive_gaps(sequences)
        .groupBy("skill_id", B.gap_bin_left_closed(F.col("gap_ms")).alias("gap_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    labels = F.explode(F.array(*[F.lit(name) for name, _ in B.GAP_BINS])).alias("gap_bin")
    grid = skills.select("skill_id", labels)
    filled = grid.join(counts, ["skill_id", "gap_bin"], "left")
    return filled.select("skill_id", "gap_bin", F.coalesce("n", F.lit(0).cast("long")).alias("gap_count"))


def item_distribution(items: DataFrame) -> DataFrame:
    """Spread of item accuracy and the parts covered, per skill."""
    quantiles = exact_quantiles(items, ["skill_id"], "accuracy", (0.10, 0.50, 0.90))
    parts = F.array_sort(F.collect_set(F.when(F.col("part") >= 0, F.col("part"))))
    counts = items.groupBy("skill_id").agg(F.count(F.lit(1)).alias("eligible_items"), parts.alias("__parts"))
    at = lambda i: F.get("quantiles", F.lit(i))
    return counts.join(quantiles, "skill_id").select(
        "skill_id",
        "eligible_items",
        at(0).alias("item_accuracy_p10"),
        at(1).alias("item_accuracy_p50"),
        at(2).alias("item_accuracy_p90"),
        (at(2) - at(0)).alias("item_accuracy_p90_p10_spread"),
        F.array_join(F.col("__parts").cast("array<string>"), ";").alias("parts"),
        F.size("__parts").alias("part_count"),
    )


def skill_tiers(statistics: DataFrame, config: BuildConfig) -> DataFrame:
    c, col = config, F.col
    common = (col("eligible_items") >= c.min_items_per_skill) & col("accuracy").between(
        c.min_skill_accuracy, c.max_skill_accuracy
    )

    def passes(learners, repeat, gaps, spread) -> Column:
        return F.coalesce(
            common
            & (col("unique_learners") >= learners)
            & (col("learners_3_plus") >= repeat)
            & (col("positive_gap_count") >= gaps)
            & (col("item_accuracy_p90_p10_spread") >= spread),
            F.lit(False),
        )

    strict = passes(c.min_unique_learners, c.min_repeat_learners, c.min_positive_gaps, c.min_item_accuracy_spread)
    relaxed = passes(
        c.relaxed_min_unique_learners,
        c.relaxed_min_repeat_learners,
        c.relaxed_min_positive_gaps,
        c.relaxed_min_item_accuracy_spread,
    )
    flagged = statistics.withColumns({"strict_eligible": strict, "relaxed_eligible": relaxed})
    tier = F.when(col("strict_eligible"), "strict").when(col("relaxed_eligible"), "relaxed_only").otherwise("ineligible")
    return flagged.withColumn("selection_tier", tier)


# Selection weights; log-scaled columns are marked True.
SCORE_WEIGHTS = [
    ("unique_learners", 0.25, True),
    ("learners_3_plus", 0.25, True),
    ("positive_gap_count", 0.20, True),
    ("eligible_items", 0.15, True),
    ("item_accuracy_p90_p10_spread", 0.10, False),
    ("interaction_rows", 0.05, True),
]


def score_skills(tiers: DataFrame, config: BuildConfig) -> DataFrame:
    """Selection score of the skills in the pool; null outside it. The pool is the strict
    tier when large enough, else the relaxed one. Ranges come from one global aggregate row."""
    need = config.reference_skill_count
    scaled = {
        f"__x{i}": (F.log1p(F.col(name)) if logged else F.col(name).cast("double"))
        for i, (name, _, logged) in enumerate(SCORE_WEIGHTS)
    }
    pool_size = tiers.agg(F.count_if("strict_eligible").alias("__strict"), F.count_if("relaxed_eligible").alias("__relaxed"))
    use_strict = F.col("__strict") >= need
    in_pool = F.when(use_strict, F.col("strict_eligible")).when(F.col("__relaxed") >= need, F.col("relaxed_eligible")).otherwise(False)
    pooled = tiers.crossJoin(F.broadcast(pool_size)).withColumn("__in", in_pool).withColumns(scaled)
    ends = pooled.where("__in").agg(
        *[f(x).alias(f"{x}_{f.__name__}") for x in scaled for f in (F.min, F.max)]
    )
    scored = pooled.crossJoin(F.broadcast(ends))
    score = F.lit(0.0)
    for i, (_, weight, _) in enumerate(SCORE_WEIGHTS):
        x, low, high = F.col(f"__x{i}"), F.col(f"__x{i}_min"), F.col(f"__x{i}_max")
        unit = F.when(x.isNull() | F.isnan(x), 0.0).when(high <= low, 1.0).otherwise((x - low) / (high - low))
        score = score + F.lit(weight) * unit
    return scored.withColumn("selection_score", F.when(F.col("__in"), score)).select(*tiers.columns, "selection_score")


def top_skills(scored: DataFrame, config: BuildConfig) -> DataFrame:
    """The best skills by score, ties to the lower id, with their rank."""
    best = (
        scored.where(F.col("selection_score").isNotNull())
        .orderBy(F.desc("selection_score"), "skill_id")
        .limit(config.reference_skill_count)
    )
    # The window runs over at most ``reference_skill_count`` rows.
    rank = F.row_number().over(Window.orderBy(F.desc("selection_score"), "skill_id"))
    return best.select("skill_id", "selection_score", rank.cast("long").alias("selection_rank"))


def skill_diagnostics(scored: DataFrame, selected: DataFrame) -> DataFrame:
    """Every candidate skill, selected or not, with its rank when selected."""
    ranks = selected.select("skill_id", "selection_rank")
    joined = scored.join(F.broadcast(ranks), "skill_id", "left")
    return joined.withColumn("selected", F.col("selection_rank").isNotNull())


def class_code(event_count: Column) -> Column:
    return F.when(event_count >= 3, 1).otherwise(0)


def quota(split_code: Column, sample_class: Column, config: BuildConfig) -> Column:
    return (
        F.when(sample_class == 0, config.cold_quota_per_split)
        .when(split_code == 0, config.repeat_train_quota)
        .when(split_code == 1, config.repeat_calibration_quota)
        .otherwise(config.repeat_test_quota)
    )


def select_pairs(groups: DataFrame, skills: DataFrame, config: BuildConfig) -> DataFrame:
    """Per (skill, split, class) the quota of pairs with the lowest hash priority."""
    chosen = groups.join(F.broadcast(skills.select("skill_id")), "skill_id", "left_semi")
    coded = chosen.withColumn("class_code", class_code(F.col("event_count")))
    priority = H.sample_priority("learner_id", "skill_id", "class_code")
    hashed = coded.withColumn("__order", H.unsigned_order(priority))
    order = [F.col("__order"), F.col("learner_id")]
    limit = quota(F.col("split_code"), F.col("class_code"), config)
    picked = bottom_k(hashed, ["skill_id", "split_code", "class_code"], order, limit, ["learner_id"])
    return picked.select(
        "learner_id",
        "skill_id",
        B.label(F.col("split_code"), B.SPLITS).alias("split"),
        B.label(F.col("class_code"), B.CLASSES).alias("sample_class"),
        "event_count",
        H.unsigned_decimal(H.unsigned_order(F.col("__order"))).alias("selection_priority_u64"),
    )


def gap_sample(sequences: DataFrame, shard: Column | None, config: BuildConfig) -> DataFrame:
    """Hash sample of positive gaps per skill. With ``shard`` the sample is first capped per
    (shard, skill), as the published sample was; without it the sample ignores file layout."""
    priority = H.gap_priority("learner_id", "skill_id", "timestamp_ms")
    gaps = positive_gaps(sequences).withColumn("__order", H.unsigned_order(priority))
    order = [F.col(c) for c in ("__order", "learner_id", "timestamp_ms", "gap_ms")]
    if shard is not None and config.gap_sample_per_shard_skill is not None:
        capped = gaps.withColumn("shard_id", shard)
        gaps = bottom_k(capped, ["shard_id", "skill_id"], order, config.gap_sample_per_shard_skill, ["learner_id", "timestamp_ms"], salts=8)
    return bottom_k(gaps, ["skill_id"], order, config.gap_sample_final_per_skill, ["learner_id", "timestamp_ms"])


def gap_quantiles(sample: DataFrame, probabilities: Sequence[float] = GAP_PROBABILITIES) -> DataFrame:
    quantiles = exact_quantiles(sample, ["skill_id"], "gap_ms", probabilities)
    sizes = sample.groupBy("skill_id").agg(F.count(F.lit(1)).alias("sample_size"))
    rows = quantiles.join(sizes, "skill_id").select("skill_id", "sample_size", F.posexplode("quantiles").alias("__i", "gap_ms"))
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    return rows.select("skill_id", F.get(wanted, F.col("__i")).alias("probability"), "gap_ms", "sample_size")


def retention_support(quantiles: DataFrame, days: float = 30.0) -> DataFrame:
    """Per skill: 90/95/99 % gaps in days and whether each lies below ``days``."""
    in_days = F.col("gap_ms") / F.lit(86_400_000.0)
    at = {q: F.max(F.when(F.col("probability") == q / 100, in_days)) for q in (90, 95, 99)}
    wide = quantiles.groupBy("skill_id").agg(*[c.alias(f"q{q}_gap_days") for q, c in at.items()])
    below = {f"q{q}_below_30d": F.coalesce(F.col(f"q{q}_gap_days") < days, F.lit(False)) for q in at}
    return wide.withColumns(below)


def retention_support_summary(support: DataFrame) -> DataFrame:
    return support.agg(
        F.count(F.lit(1)).alias("n_skills"),
        *[F.count_if(f"q{q}_below_30d").alias(f"skills_q{q}_below_30d") for q in (90, 95, 99)],
    )


def pair_summary(pairs: DataFrame, skills: DataFrame, config: BuildConfig) -> DataFrame:
    """Selected pairs per skill, split and class next to the quota, empty cells included."""
    counts = pairs.groupBy("skill_id", "split", "sample_class").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("event_count").alias("events")
    )
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")) for s in range(3) for c in range(2)]))
    grid = skills.select("skill_id", cells.alias("cell")).select(
        "skill_id",
        B.label(F.col("cell.s"), B.SPLITS).alias("split"),
        B.label(F.col("cell.c"), B.CLASSES).alias("sample_class"),
        quota(F.col("cell.s"), F.col("cell.c"), config).alias("quota"),
    )
    zero = F.lit(0).cast("long")
    return grid.join(counts, ["skill_id", "split", "sample_class"], "left").select(
        "skill_id", "split", "sample_class", "quota",
        F.coalesce("pairs", zero).alias("pairs"), F.coalesce("events", zero).cast("long").alias("events"),
    )


def reference_interactions(sequences: DataFrame, pairs: DataFrame) -> DataFrame:
    """Event sequences of the selected pairs with split and class."""
    labels = pairs.select("learner_id", "skill_id", "split", "sample_class")
    return lookup_join(sequences, labels, PAIR, "inner").select(
        "learner_id", "skill_id", "split", "sample_class", "within_skill_index", "timestamp_ms", "gap_ms",
        "sequence_index", "question_id", "is_correct", "elapsed_time_ms", "part", "quality_flags",
    )


def selected_items(items: DataFrame, skills: DataFrame) -> DataFrame:
    """Candidate items of the selected skills."""
    return items.join(F.broadcast(skills.select("skill_id")), "skill_id", "left_semi")


def selected_questions(questions: DataFrame, items: DataFrame) -> DataFrame:
    """Question metadata of the selected items, for the bundle."""
    return lookup_join(questions, items.select("question_id"), ["question_id"], "left_semi")


def split_counts(learners: DataFrame) -> DataFrame:
    """Learners per split and overall (split ``all``)."""
    code = H.learner_split("learner_id")
    named = learners.select("learner_id").distinct().withColumn("split", B.label(code, B.SPLITS))
    totals = named.rollup("split").agg(
        F.count(F.lit(1)).alias("learners"),
        F.min("learner_id").alias("min_learner_id"),
        F.max("learner_id").alias("max_learner_id"),
    )
    return totals.withColumn("split", F.coalesce("split", F.lit("all")))


def sequence_summary(groups: DataFrame) -> DataFrame:
    """Sequences, events and longest sequence by split and class, and for all classes."""
    coded = groups.select(
        B.label(F.col("split_code"), B.SPLITS).alias("split"),
        B.label(class_code(F.col("event_count")), B.CLASSES).alias("sample_class"),
        "event_count",
    )
    totals = coded.groupingSets([["split", "sample_class"], ["split"]], "split", "sample_class").agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum("event_count").cast("long").alias("n_events"),
        F.max("event_count").alias("max_length"),
    )
    return totals.withColumn("sample_class", F.coalesce("sample_class", F.lit("all")))


def evenly_spaced(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``size`` rows at evenly spaced positions of the order (both ends included)."""
    n = df.count()
    if n <= size:
        return df
    if size == 1:
        spots = [0]
    else:
        spots = sorted({round(i * (n - 1) / (size - 1)) for i in range(size)})
    placed = prefix(df, [], order, count="__position")
    wanted = df.sparkSession.createDataFrame([(s,) for s in spots], "__position long")
    return placed.join(F.broadcast(wanted), "__position", "left_semi").drop("__position")
