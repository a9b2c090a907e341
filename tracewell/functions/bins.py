"""Fixed bin tables. The two gap conventions differ at the boundaries on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label and lower bound in ms.
GAP_BINS = [
    ("gt0_lt1min", 0),
    ("1min_lt5min", 60_000),
    ("5min_lt30min", 300_000),
    ("30min_lt2h", 1_800_000),
    ("2h_lt12h", 7_200_000),
    ("12h_lt1d", 43_200_000),
    ("1d_lt3d", 86_400_000),
    ("3d_lt7d", 259_200_000),
    ("7d_lt30d", 604_800_000),
    ("30d_plus", 2_592_000_000),
]
FIRST_OR_ZERO = "first_or_zero"
# Label, smallest and largest event count.
EVENT_COUNT_BINS = [("1", 1, 1), ("2", 2, 2), ("3_4", 3, 4), ("5_9", 5, 9), ("10_19", 10, 19), ("20_plus", 20, None)]

SPLITS = ["train", "calibration", "test"]
CLASSES = ["cold_1_2", "repeat_3_plus"]


def gap_bin_left_closed(gap_ms: Column) -> Column:
    """Bin of a positive gap: lower bound inside."""
    label = F.when(gap_ms > 0, F.lit(GAP_BINS[0][0]))
    out = None
    for name, low in reversed(GAP_BINS[1:]):
        out = F.when(gap_ms >= low, name) if out is None else out.when(gap_ms >= low, name)
    return out.otherwise(label)


def gap_bin_right_closed(gap_ms: Column) -> Column:
    """Bin of any gap: zero and first events apart, upper bound inside."""
    out = F.when(gap_ms <= 0, FIRST_OR_ZERO)
    for (name, _), (_, upper) in zip(GAP_BINS, GAP_BINS[1:]):
        out = out.when(gap_ms <= upper, name)
    return out.otherwise(GAP_BINS[-1][0])


def all_gap_bins() -> list[str]:
    return [FIRST_OR_ZERO] + [name for name, _ in GAP_BINS]


def in_event_bin(count: Column, low: int, high: int | None) -> Column:
    return (count >= low) if high is None else count.between(low, high)


def label(code: Column, labels: list[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), code)


def equal_width_bin(p: Column, bins: int) -> Column:
    """Index of the equal-width bin of p in [0, 1] whose edges are i*(1/bins); 1.0 joins the last.

    The first guess by multiplication is corrected against the edges themselves, so values
    that fall on an edge land in the bin the edge opens."""
    guess = F.least(F.floor(p * bins), F.lit(bins - 1))
    edge = lambda i: i.cast("double") * F.lit(1.0 / bins)
    up = F.when((p >= edge(guess + 1)) & (guess < bins - 1), 1).otherwise(0)
    down = F.when(p < edge(guess), 1).otherwise(0)
    return (guess + up - down).cast("int")
