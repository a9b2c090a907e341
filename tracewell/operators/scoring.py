"""Next-item scoring from a table of learner beliefs.

Beliefs: learner_id, skill_id, belief, last_practised_ms, practice_count, lambda_per_day.
Item bins: skill_id, item_bin, p0, p1 (chance of success without and with mastery).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.cleaning import DAY_MS
from tracewell.functions.hashing import keyed_uniform
from tracewell.functions.numeric import clip, entropy, expit, logit, retention
from tracewell.operators.skew import lookup_join

EPS = 1e-10
# Target success and the weights of the composite score.
TARGET_SUCCESS = 0.70
LACK, UNCERTAINTY, OVERDUE, UNSEEN, COUNT_PENALTY, BELOW, THRESHOLD = 1.00, 0.25, 0.18, 0.12, 0.015, 0.20, 0.90


def item_endpoints(bins: DataFrame, shift: str = "shift", strength: float = 1.0) -> DataFrame:
    """Add p0 and p1 from guess, slip and the bin's shift (on the logit scale, times strength)."""
    d = F.col(shift) * F.lit(float(strength))
    return bins.withColumns(
        {"p0": expit(logit(F.col("guess"), EPS) + d), "p1": expit(logit(F.lit(1.0) - F.col("slip"), EPS) + d)}
    )


def decay_beliefs(beliefs: DataFrame, now_ms: Column) -> DataFrame:
    """Beliefs as of ``now_ms``, with the days since the last practice."""
    days = F.greatest((now_ms - F.col("last_practised_ms")) / DAY_MS, F.lit(0.0))
    aged = beliefs.withColumn("idle_days", days)
    return aged.withColumn("belief", F.col("belief") * retention(F.col("lambda_per_day"), F.col("idle_days")))


def predicted_success(belief: Column, p0: Column, p1: Column) -> Column:
    return p0 + belief * (p1 - p0)


def posterior(belief: Column, p0: Column, p1: Column, correct: bool) -> Column:
    p = clip(predicted_success(belief, p0, p1), EPS, 1.0 - EPS)
    return belief * p1 / p if correct else belief * (F.lit(1.0) - p1) / (F.lit(1.0) - p)


def updated_belief(belief: Column, p0: Column, p1: Column, correct: Column, p_learn: Column) -> Column:
    """Belief after a response and the learning step that follows it."""
    post = F.when(correct, posterior(belief, p0, p1, True)).otherwise(posterior(belief, p0, p1, False))
    return p_learn + (F.lit(1.0) - p_learn) * post


def entropy_reduction(before: Column, after: Column) -> Column:
    return entropy(before, EPS) - entropy(after, EPS)


def response_information(belief: Column, p0: Column, p1: Column, grid: int | None = None) -> Column:
    """Mutual information of mastery and the next response. ``grid`` rounds the belief to
    that many equally spaced points, as tabulated scores do."""
    if grid:
        belief = F.rint(clip(belief, 0.0, 1.0) * (grid - 1)) / float(grid - 1)
    p = clip(predicted_success(belief, p0, p1), EPS, 1.0 - EPS)
    hit, miss = posterior(belief, p0, p1, True), posterior(belief, p0, p1, False)
    value = entropy(belief, EPS) - (p * entropy(hit, EPS) + (F.lit(1.0) - p) * entropy(miss, EPS))
    return F.greatest(value, F.lit(0.0))


def robust_information(belief: Column, low: tuple[Column, Column], high: tuple[Column, Column], grid: int | None = None) -> Column:
    """The smaller information at two item strengths."""
    return F.least(response_information(belief, *low, grid=grid), response_information(belief, *high, grid=grid))


def robust_bins(bins: DataFrame, corners: tuple[float, float] = (0.75, 1.25)) -> DataFrame:
    """Item bins with endpoints at strength 1 and at both corners, which must bracket 1."""
    low, high = corners
    if not 0.0 < low <= 1.0 <= high:
        raise ValueError("corners must be positive and bracket 1")
    out = item_endpoints(bins)
    for name, strength in (("lo", low), ("hi", high)):
        ends = item_endpoints(bins.select(*bins.columns), strength=strength)
        out = out.join(ends.select("skill_id", "item_bin", F.col("p0").alias(f"p0_{name}"), F.col("p1").alias(f"p1_{name}")), ["skill_id", "item_bin"])
    return out


def bin_arrays(bins: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per skill: its bins as an array ordered by bin number."""
    return bins.groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct("item_bin", *columns))).alias("bins"))


def with_bins(beliefs: DataFrame, bins: DataFrame, columns: Sequence[str] = ("p0", "p1")) -> DataFrame:
    """Attach each skill's bin array to its belief rows, so scoring needs no row explosion."""
    return lookup_join(beliefs, bin_arrays(bins, columns), ["skill_id"], "inner")


def _best(candidates: Column) -> Column:
    """The smallest struct of an array."""
    return F.array_min(candidates)


def composite_score(belief: Column, idle_days: Column, count: Column) -> Column:
    overdue = idle_days / (F.lit(1.0) + idle_days)
    return (
        F.lit(LACK) * (F.lit(1.0) - belief)
        + F.lit(UNCERTAINTY) * belief * (F.lit(1.0) - belief)
        + F.lit(OVERDUE) * overdue
        + F.lit(UNSEEN) * (count == 0).cast("double")
        - F.lit(COUNT_PENALTY) * count
        + F.lit(BELOW) * (belief < THRESHOLD).cast("double")
    )


def recommend(scored: DataFrame, cost: Column, item: Column, curriculum: DataFrame | None = None) -> DataFrame:
    """One (skill, item bin) per learner: the lowest ``cost``, ties to the earlier skill of the
    curriculum (skill_id, position) or, without one, to the lower skill id.

    A ``min_by`` aggregate: partial per task, so a learner of any size is one small state."""
    if curriculum is not None:
        scored = lookup_join(scored, curriculum, ["skill_id"], "inner")
        position = F.col("position")
    else:
        position = F.col("skill_id")
    rows = scored.select("learner_id", "skill_id", cost.alias("cost"), item.cast("int").alias("item_bin"), position.cast("long").alias("position"))
    best = F.min_by(F.struct("skill_id", "item_bin", "cost"), F.struct("cost", "position")).alias("b")
    return rows.groupBy("learner_id").agg(best).select("learner_id", "b.skill_id", "b.item_bin", F.col("b.cost").alias("cost"))


def target_item() -> Column:
    """Bin (struct of distance, item_bin) whose predicted success is nearest the target."""
    b = F.col("belief")
    distance = lambda e: F.abs(predicted_success(b, e.p0, e.p1) - TARGET_SUCCESS)
    return _best(F.transform("bins", lambda e: F.struct(distance(e).alias("distance"), e.item_bin.alias("item_bin"))))


def median_item() -> Column:
    return F.floor(F.size("bins") / 2)


def least_mastery(scored: DataFrame, curriculum: DataFrame | None = None) -> DataFrame:
    return recommend(scored, F.col("belief"), target_item().item_bin, curriculum)


def maximum_uncertainty(scored: DataFrame, curriculum: DataFrame | None = None) -> DataFrame:
    return recommend(scored, -(F.col("belief") * (F.lit(1.0) - F.col("belief"))), median_item(), curriculum)


def nearest_target(scored: DataFrame, curriculum: DataFrame | None = None) -> DataFrame:
    placed = scored.withColumn("__t", target_item())
    return recommend(placed, F.col("__t.distance"), F.col("__t.item_bin"), curriculum)


def balanced_mastery(scored: DataFrame, curriculum: DataFrame | None = None) -> DataFrame:
    score = composite_score(F.col("belief"), F.col("idle_days"), F.col("practice_count"))
    return recommend(scored, -score, target_item().item_bin, curriculum)


def maximum_information(scored: DataFrame, curriculum: DataFrame | None = None, robust: bool = False, grid: int | None = None) -> DataFrame:
    """Most informative (skill, bin); with ``robust`` the two-corner information is used."""
    b = F.col("belief")

    def value(e: Column) -> Column:
        if robust:
            return robust_information(b, (e.p0_lo, e.p1_lo), (e.p0_hi, e.p1_hi), grid)
        return response_information(b, e.p0, e.p1, grid)

    best = _best(F.transform("bins", lambda e: F.struct((-value(e)).alias("cost"), e.item_bin.alias("item_bin"))))
    placed = scored.withColumn("__t", best)
    return recommend(placed, F.col("__t.cost"), F.col("__t.item_bin"), curriculum)


def representative_bins(n_bins: int, count: int = 5) -> list[int]:
    if count == 1:
        return [0]
    return [round(i * (n_bins - 1) / (count - 1)) for i in range(count)]


def expected_scores(scored: DataFrame, n_bins: int, count: int = 5) -> DataFrame:
    """Mean predicted success per learner over skills and representative test bins."""
    picks = F.array(*[F.lit(i) for i in representative_bins(n_bins, count)])
    b = F.col("belief")

    def chance(i: Column) -> Column:
        e = F.get("bins", i)
        return clip(predicted_success(b, e.p0, e.p1), EPS, 1.0 - EPS)

    total = F.aggregate(F.transform(picks, chance), F.lit(0.0), lambda a, x: a + x)
    return scored.groupBy("learner_id").agg((F.sum(total) / (F.count(F.lit(1)) * count)).alias("expected_score"))


def sampled_scores(scored: DataFrame, n_bins: int, seed: int, stream: int, count: int = 5) -> DataFrame:
    """Like :func:`expected_scores` with a reproducible Bernoulli draw per item."""
    picks = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(i).alias("bin")) for p, i in enumerate(representative_bins(n_bins, count))])
    items = scored.withColumn("__k", F.explode(picks)).withColumn("__e", F.get("bins", F.col("__k.bin")))
    p = clip(predicted_success(F.col("belief"), F.col("__e.p0"), F.col("__e.p1")), EPS, 1.0 - EPS)
    u = F.lit(None).cast("double")
    for pos, b in enumerate(representative_bins(n_bins, count)):
        drawn = keyed_uniform(seed, stream + pos, "learner_id", 20000, "skill_id", str(b))
        u = F.when(F.col("__k.pos") == pos, drawn).otherwise(u)
    return items.groupBy("learner_id").agg(F.avg((u < p).cast("double")).alias("observed_score"))
