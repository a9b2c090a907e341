"""Prediction metrics over scored events (``y`` 0/1, ``prediction`` in (0, 1))."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.bins import all_gap_bins, equal_width_bin, gap_bin_right_closed
from tracewell.functions.numeric import clip, weighted_mean
from tracewell.operators.skew import lookup_join, materialise, prefix

TINY = 1e-12
METRICS = [
    "log_loss", "brier", "accuracy_0_5", "auc", "ece_equal_width", "calibration_intercept", "calibration_slope",
]


def _p() -> Column:
    return clip(F.col("prediction"), TINY, 1.0 - TINY)


def basic_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    p, y = _p(), F.col("y")
    loss = -F.avg(F.when(y == 1, F.ln(p)).otherwise(F.log1p(-p)))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg(y).alias("event_rate"),
        F.avg(p).alias("mean_prediction"),
        loss.alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy_0_5"),
    )


def _bin_table(scored: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    cell = scored.groupBy(*by, equal_width_bin(_p(), bins).alias("bin_index"))
    return cell.agg(F.count(F.lit(1)).alias("n_events"), F.avg(_p()).alias("mean_prediction"), F.avg("y").alias("observed_rate"))


def calibration_error(scored: DataFrame, by: Sequence[str], bins: int = 15) -> DataFrame:
    n = F.col("n_events")
    gap = F.abs(F.col("mean_prediction") - F.col("observed_rate"))
    cells = _bin_table(scored, by, bins)
    return cells.groupBy(*by).agg((F.sum(n * gap) / F.sum(n)).alias("ece_equal_width"))


def calibration_bins(scored: DataFrame, by: Sequence[str], bins: int = 15) -> DataFrame:
    """All equal-width bins per group; empty bins keep null means."""
    grid = scored.select(*by).distinct().withColumn("bin_index", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edges = {
        "bin_lower": F.col("bin_index") * F.lit(1.0 / bins),
        "bin_upper": F.when(F.col("bin_index") == bins - 1, 1.0).otherwise((F.col("bin_index") + 1) * F.lit(1.0 / bins)),
    }
    joined = grid.join(_bin_table(scored, by, bins), [*by, "bin_index"], "left").withColumns(edges)
    return joined.withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long")))


def area_under_curve(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank-sum AUC with average ranks for ties; null when a group has one outcome only.

    Ties are first added up per (group, prediction); the running count of negatives below a
    prediction is then a prefix sum, which stays balanced for groups of any size."""
    one, zero = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    return _area(scored.groupBy(*by, "prediction").agg(one.alias("n1"), zero.alias("n0")), by)


def _area(ties: DataFrame, by: Sequence[str]) -> DataFrame:
    ranked = prefix(ties, by, ["prediction"], sums={"below": F.col("n0")})
    wins = F.sum(F.col("n1") * (F.col("below") + F.col("n0") / 2.0))
    totals = ranked.groupBy(*by).agg(wins.alias("wins"), F.sum("n1").alias("s1"), F.sum("n0").alias("s0"))
    both = (F.col("s1") > 0) & (F.col("s0") > 0)
    return totals.select(*by, F.when(both, F.col("wins") / (F.col("s1") * F.col("s0"))).alias("auc"))


def average_ranks(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """1-based rank of each distinct prediction in its group, ties sharing the mean rank."""
    ties = scored.groupBy(*by, "prediction").agg(F.count(F.lit(1)).alias("ties"))
    ranked = prefix(ties, by, ["prediction"], sums={"below": F.col("ties")})
    return ranked.select(*by, "prediction", "ties", (F.col("below") + (F.col("ties") + 1) / 2.0).alias("average_rank"))


def prediction_table(scored: DataFrame, by: Sequence[str], counts: Mapping[str, Column] | None = None) -> DataFrame:
    """The sufficient statistics of all metrics: events ``n`` and successes ``n1`` per group and
    prediction. Tables of parts of the events add up; ``counts`` are further numbers to add up."""
    more = [F.sum(c.cast("long")).alias(name) for name, c in (counts or {}).items()]
    return scored.groupBy(*by, _p().alias("prediction")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n1"), *more)


def _merged(table: DataFrame, by: Sequence[str]) -> DataFrame:
    added = [c for c in table.columns if c not in (*by, "prediction")]
    return table.groupBy(*by, "prediction").agg(*[F.sum(c).alias(c) for c in added])


# The logit is cut at 20 on both sides; a bin of it is about 0.01 wide.
LOGIT_LIMIT, LOGIT_BINS = 20.0, 4096
_WIDTH = 2 * LOGIT_LIMIT / LOGIT_BINS
_MOMENTS = ["z1", "z2", "z3"]
_HISTOGRAM = ["origin", "n0", *[f"{m}_0" for m in _MOMENTS], "n1", *[f"{m}_1" for m in _MOMENTS]]


def _logit_columns(p: Column) -> tuple[Column, Column, Column]:
    """(logit, origin of its cell, its distance from there).

    In groups with at most ``LOGIT_BINS`` distinct predictions (``__few``) each logit is a cell of
    its own; in others the cell is a bin, with its lower edge as origin."""
    x = clip(F.ln(p / (F.lit(1.0) - p)), -LOGIT_LIMIT, LOGIT_LIMIT)
    edge = F.least(F.floor((x + LOGIT_LIMIT) / _WIDTH), F.lit(LOGIT_BINS - 1)) * _WIDTH - LOGIT_LIMIT
    origin = F.when(F.col("__few"), x).otherwise(edge)
    return x, origin, x - origin


def _with_few(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """A stored prediction table with ``__few``: whether its group has at most ``LOGIT_BINS`` predictions."""
    few = table.groupBy(*by).agg((F.count(F.lit(1)) <= LOGIT_BINS).alias("__few"))
    return lookup_join(table, materialise(few), by, "left")


def _histogram_sums(x: Column, z: Column) -> list[Column]:
    """Per outcome the count and the first three moments, and the least logit."""
    sums = [F.min(x).alias("least_logit")]
    for outcome, n in (("0", F.col("n") - F.col("n1")), ("1", F.col("n1"))):
        sums.append(F.sum(n).alias(f"h{outcome}"))
        sums += [F.sum(n * F.pow(z, F.lit(float(k)))).alias(f"{m}_{outcome}") for k, m in enumerate(_MOMENTS, 1)]
    return sums


def _newton(cells: np.ndarray, least: float, max_steps: int, tolerance: float) -> tuple[float | None, float | None, str]:
    """Intercept and slope from the histogram rows (origin, then count and moments per outcome).

    A cell's events are taken at their mean logit, with the next terms of the series from their
    moments. Sums are about the least logit, which keeps the solution of the 2 x 2 system
    exact where the logits of a group are nearly equal.
    """
    n0, n1 = cells[:, 1], cells[:, 5]
    if n0.sum() == 0 or n1.sum() == 0:
        return None, None, "single_outcome"
    n = n0 + n1
    mean = (cells[:, 2] + cells[:, 6]) / n
    x = cells[:, 0] + mean
    first, second, third = [], [], []
    for i in (1, 5):
        count, z1, z2, z3 = cells[:, i : i + 4].T
        first.append(z1 - count * mean)
        second.append(z2 - 2 * mean * z1 + count * mean**2)
        third.append(z3 - 3 * mean * z2 + 3 * mean**2 * z1 - count * mean**3)
    d1, d2, d3 = (sum(m) for m in (first, second, third))
    z = x - least
    b0, b1, ridge = 0.0, 1.0, 1e-8
    for _ in range(max_steps):
        eta = b0 + b1 * x
        with np.errstate(over="ignore"):
            up, down = 1.0 / (1.0 + np.exp(-eta)), 1.0 / (1.0 + np.exp(eta))
        w = up * down
        v1, v2 = w * (down - up), w * (1.0 - 6.0 * w)
        error = n0 * up - n1 * down + b1 * w * d1 + b1**2 / 2 * v1 * d2 + b1**3 / 6 * v2 * d3
        tilt = up * first[0] - down * first[1] + b1 * w * d2 + b1**2 / 2 * v1 * d3
        low = w < 1e-8
        w, v1, v2 = np.where(low, 1e-8, w), np.where(low, 0.0, v1), np.where(low, 0.0, v2)
        w0 = n * w + b1 * v1 * d1 + b1**2 / 2 * v2 * d2
        w1 = w * d1 + b1 * v1 * d2
        w2 = w * d2
        g0, gz = error.sum(), (z * error + tilt).sum()
        s0, s1, s2 = w0.sum(), (z * w0 + w1).sum(), (z * z * w0 + 2 * z * w1 + w2).sum()
        det = s0 * s2 - s1 * s1 + ridge * (s0 + s2 + 2 * least * s1 + least * least * s0) + ridge * ridge
        if det == 0.0:
            return None, None, "singular"
        step0 = ((s2 + least * s1 + ridge) * g0 - (s1 + least * s0) * gz) / det
        step1 = ((s0 + ridge) * gz + ridge * least * g0 - s1 * g0) / det
        if not (np.isfinite(step0) and np.isfinite(step1)):
            return None, None, "non_finite"
        b0, b1 = b0 - step0, b1 - step1
        if max(abs(step0), abs(step1)) < tolerance:
            return b0, b1, "converged"
    return b0, b1, "maxiter"


_LINE = ["calibration_intercept", "calibration_slope", "calibration_fit_status"]


def _fitted(grouped: DataFrame, max_steps: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """``grouped`` with the line in place of ``histogram`` (one array of at most ``LOGIT_BINS``
    entries a group, whatever its events) and ``least_logit``."""

    @F.arrow_udf(T.StructType([T.StructField(n, T.StringType() if n.endswith("status") else T.DoubleType()) for n in _LINE]))
    def line(histogram: pa.Array, least: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(histogram).to_numpy()
        values = histogram.flatten()
        cells = np.stack([values.field(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(len(_HISTOGRAM))], axis=1)
        ends = np.cumsum(sizes)
        rows = [_newton(cells[e - k : e], x, max_steps, tolerance) for k, e, x in zip(sizes, ends, least.to_pylist())]
        return pa.array([dict(zip(_LINE, r)) for r in rows], pa.struct([(n, pa.string() if n.endswith("status") else pa.float64()) for n in _LINE]))

    kept = [c for c in grouped.columns if c not in ("histogram", "least_logit")]
    return grouped.withColumn("line", line("histogram", "least_logit")).select(*kept, *[f"line.{n}" for n in _LINE])


def _histogram_entry() -> Column:
    return F.struct("origin", F.col("h0").alias("n0"), *[f"{m}_0" for m in _MOMENTS], F.col("h1").alias("n1"), *[f"{m}_1" for m in _MOMENTS])


def calibration_line(scored: DataFrame, by: Sequence[str], max_steps: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """Intercept and slope of a logistic regression of y on logit(prediction), by Newton steps.

    Every group gets a status; without two outcomes it is ``single_outcome`` and there is no
    line. A group of at most ``LOGIT_BINS`` distinct predictions is fitted on these, which is exact
    at any slope. A larger one is its histogram over as many bins of the logit, with moments, so
    the size of a group in the task that fits it is bounded; its error is of the fourth order in
    slope times bin width (1e-9 at slopes about one).
    """
    x, origin, z = _logit_columns(F.col("prediction"))
    table = _with_few(materialise(prediction_table(scored, by)), by)
    cells = table.groupBy(*by, origin.alias("origin")).agg(*_histogram_sums(x, z))
    grouped = cells.groupBy(*by).agg(F.min("least_logit").alias("least_logit"), F.sort_array(F.collect_list(_histogram_entry())).alias("histogram"))
    return _fitted(grouped, max_steps, tolerance)


def table_metrics(table: DataFrame, by: Sequence[str], bins: int = 15) -> DataFrame:
    """Every metric per group from a stored :func:`prediction_table`; its further counts are added up."""
    by = list(by)
    more = [c for c in table.columns if c not in (*by, "prediction", "n", "n1")]
    p, n, n1 = F.col("prediction"), F.col("n"), F.col("n1")
    x, origin, z = _logit_columns(p)
    sums = {
        "n": n,
        "successes": n1,
        "predicted": n * p,
        "loss": -(n1 * F.ln(p) + (n - n1) * F.log1p(-p)),
        "squares": n1 * (1 - p) * (1 - p) + (n - n1) * p * p,
        "right": F.when(p >= 0.5, n1).otherwise(n - n1),
        **{c: F.col(c) for c in more},
    }
    cells = _with_few(table, by).groupBy(*by, equal_width_bin(p, bins).alias("bin_index"), origin.alias("origin")).agg(*[F.sum(c).alias(k) for k, c in sums.items()], *_histogram_sums(x, z))
    by_bin = cells.groupBy(*by, "bin_index").agg(*[F.sum(k).alias(k) for k in sums], F.min("least_logit").alias("least_logit"), F.collect_list(_histogram_entry()).alias("cells"))
    total = F.sum("n")
    grouped = by_bin.groupBy(*by).agg(
        total.alias("n_events"),
        (F.sum("successes") / total).alias("event_rate"),
        (F.sum("predicted") / total).alias("mean_prediction"),
        (F.sum("loss") / total).alias("log_loss"),
        (F.sum("squares") / total).alias("brier"),
        (F.sum("right") / total).alias("accuracy_0_5"),
        (F.sum(F.abs(F.col("predicted") - F.col("successes"))) / total).alias("ece_equal_width"),
        *[F.sum(c).alias(c) for c in more],
        F.min("least_logit").alias("least_logit"),
        F.sort_array(F.flatten(F.collect_list("cells"))).alias("histogram"),
    )
    ties = table.select(*by, "prediction", "n1", (n - n1).alias("n0"))
    return _fitted(grouped).join(_area(ties, by), by)


def prediction_metrics(scored: DataFrame, by: Sequence[str], bins: int = 15) -> DataFrame:
    """Every metric per group; ``scored`` is read once."""
    return table_metrics(materialise(prediction_table(scored, by)), by, bins)


def with_all_classes(scored: DataFrame) -> DataFrame:
    """Each row once under its own class and once under ``all``."""
    return scored.withColumn("sample_class", F.explode(F.array(F.col("sample_class"), F.lit("all"))))


def evaluate_models(scored: DataFrame, bins: int = 15) -> DataFrame:
    """Metrics by skill, model, split and class, with the number of sequences."""
    by = ["skill_id", "model", "split", "sample_class"]
    table = prediction_table(scored, by, {"n_sequences": (F.col("within_skill_index") == 0).cast("int")})
    return table_metrics(materialise(_merged(with_all_classes(table), by)), by, bins)


def gap_bin_metrics(scored: DataFrame, by: Sequence[str], bins: int = 15) -> DataFrame:
    """Metrics per gap bin; all eleven bins are kept, empty ones with status ``empty``."""
    by = list(by)
    binned = scored.withColumn("gap_bin", gap_bin_right_closed(F.col("gap_ms")))
    labels = F.explode(F.array(*[F.lit(b) for b in all_gap_bins()])).alias("gap_bin")
    grid = scored.select(*by).distinct().select(*by, labels)
    joined = grid.join(prediction_metrics(binned, [*by, "gap_bin"], bins), [*by, "gap_bin"], "left")
    return joined.withColumns(
        {
            "n_events": F.coalesce("n_events", F.lit(0).cast("long")),
            "calibration_fit_status": F.coalesce("calibration_fit_status", F.lit("empty")),
        }
    )


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    """Plain and event-weighted means over skills, skipping missing values."""
    columns = [F.count(F.lit(1)).alias("n_skills"), F.sum("n_events").cast("long").alias("n_events_total")]
    for name in METRICS:
        value = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        columns.append(F.avg(value).alias(f"macro_{name}"))
        columns.append(weighted_mean(value, F.col("n_events")).alias(f"micro_weighted_{name}"))
    out = metrics.groupBy("model", "split", "sample_class").agg(*columns)
    return out.withColumnRenamed("n_events_total", "n_events")


def gap_bin_summary(gap_metrics: DataFrame) -> DataFrame:
    """Event-weighted metrics per model and gap bin; a missing AUC counts as one half."""
    filled = gap_metrics.where(F.col("n_events") > 0).withColumn("auc", F.coalesce("auc", F.lit(0.5)))
    names = ["event_rate", "mean_prediction", "log_loss", "brier", "auc"]
    weighted = [weighted_mean(F.col(n), F.col("n_events")).alias(f"{n}_weighted") for n in names]
    return filled.groupBy("model", "gap_bin").agg(F.sum("n_events").cast("long").alias("n_events_total"), *weighted).withColumnRenamed(
        "n_events_total", "n_events"
    )


def model_selection(metrics: DataFrame, fits: DataFrame, min_gain: float = 1e-4, min_rate: float = 1e-7) -> DataFrame:
    """Preferred model by calibration log loss (ties to BKT) and conservative support."""
    held = metrics.where((F.col("split") == "calibration") & (F.col("sample_class") == "all"))
    loss = lambda m: F.max(F.when(F.col("model") == m, F.col("log_loss")))
    wide = held.groupBy("skill_id").agg(loss("BKT").alias("plain"), loss("BKT-F").alias("decay"))
    forgetting = fits.where(F.col("model") == "BKT-F").select("skill_id", "lambda_per_day", "optimizer_success")
    gain = F.col("plain") - F.col("decay")
    return wide.join(forgetting, "skill_id").select(
        "skill_id",
        F.when(F.col("decay") < F.col("plain"), "BKT-F").otherwise("BKT").alias("preferred_by_calibration_log_loss"),
        gain.alias("calibration_log_loss_gain_bktf_over_bkt"),
        F.lit(min_gain).alias("minimum_gain_for_conservative_support"),
        ((gain >= min_gain) & (F.col("lambda_per_day") > min_rate) & F.col("optimizer_success")).alias(
            "forgetting_supported_conservative"
        ),
    )


def preferred_parameters(fits: DataFrame, selection: DataFrame) -> DataFrame:
    chosen = selection.select(
        "skill_id", F.col("preferred_by_calibration_log_loss").alias("model"), "forgetting_supported_conservative"
    )
    columns = ["p_init", "p_learn", "slip", "guess", "lambda_per_day", "retention_half_life_days"]
    return fits.join(chosen, ["skill_id", "model"]).select(
        "skill_id", F.col("model").alias("selected_model"), *columns, "forgetting_supported_conservative"
    )


def model_difference(aggregate: DataFrame) -> DataFrame:
    """Long table of BKT, BKT-F and their difference for three held-out metrics."""
    test = aggregate.where((F.col("split") == "test") & (F.col("sample_class") == "all"))
    names = ["micro_weighted_log_loss", "micro_weighted_auc", "micro_weighted_brier"]
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
    long = test.select("model", entries.alias("e")).select("model", "e.*")
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("value")))
    wide = long.groupBy("metric").agg(at("BKT").alias("BKT"), at("BKT-F").alias("BKT_F"))
    return wide.withColumn("BKT_F_minus_BKT", F.col("BKT_F") - F.col("BKT"))
