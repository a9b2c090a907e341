"""Numeric column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_EMISSION_ERROR = 0.49


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, _c(low)), _c(high))


def logit(p: Column, eps: float = 1e-10) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bounded_sigmoid(z: Column, upper: float = MAX_EMISSION_ERROR) -> Column:
    return F.lit(upper) * expit(z)


def half_life(rate: Column) -> Column:
    """Days until retention is one half; infinite without forgetting."""
    return F.when(rate > 0, F.lit(math.log(2.0)) / rate).otherwise(F.lit(float("inf")))


def entropy(p: Column, eps: float = 1e-10) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return -(q * F.ln(q) + (F.lit(1.0) - q) * F.ln(F.lit(1.0) - q))


def retention(rate: Column, gap_days: Column) -> Column:
    return F.exp(-rate * F.greatest(gap_days, F.lit(0.0)))


def challenge_weight(p: Column, target, width, floor) -> Column:
    z = (p - _c(target)) / _c(width)
    return _c(floor) + (F.lit(1.0) - _c(floor)) * F.exp(F.lit(-0.5) * z * z)


def effective_learning(rate: Column, power: Column, raw: Column, eps: float = 1e-10) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1.0) - clip(rate, 0.0, 1.0 - eps), power * raw)


def practice_day(step: Column, items_per_day: int, minutes: float) -> Column:
    """Day of practice step ``step`` when ``items_per_day`` items are done at one sitting."""
    day = F.floor(step / F.lit(items_per_day))
    within = F.pmod(step, F.lit(items_per_day))
    return day + within * F.lit(minutes) / F.lit(1440.0)


def round_half(x: Column, digits: int) -> Column:
    """``x`` (double) to ``digits`` places as SQL engines do it in binary: scaled, rounded half away from zero, scaled back.

    Spark's own ``round`` works on the shortest decimal text of ``x``, which differs where the scaled value is a half."""
    scale = F.lit(10.0**digits)
    scaled = x * scale
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / scale).otherwise(x)


def human_bytes(size: Column) -> Column:
    """A whole number of bytes with two places, halves to even (as printf rounds exact binary values)."""
    size = size.cast("long")
    step = sum(((size >= 1 << k).cast("int") for k in (20, 30, 40)), (size >= 1 << 10).cast("int"))
    unit = F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in (0, 10, 20, 30, 40)]), step + 1)
    name = F.element_at(F.array(*[F.lit(u) for u in ("B", "KiB", "MiB", "GiB", "TiB")]), step + 1)
    # The part below one unit is less than 2^40, so no product passes 64 bits.
    part = (size % unit) * 100
    rest = part % unit
    cents = (part - rest) / unit
    cents = (cents + ((2 * rest > unit) | ((2 * rest == unit) & (cents % 2 == 1))).cast("int")).cast("long")
    whole = (size - size % unit) / unit + F.floor(cents / 100)
    return F.concat(whole.cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" "), name)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(value * weight) / sum(weight) over the rows where value is present."""
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))
