"""Data-contract checks. Each returns one row per check with its number of violations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.bins import CLASSES, SPLITS
from tracewell.functions.cleaning import EXCLUDED_BITS
from tracewell.operators.skew import lookup_join

PAIR = ["learner_id", "skill_id"]


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Count the rows that break each condition (null counts as broken), in one pass."""
    counted = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks]))
    return counted.select(entries.alias("e")).select("e.*")


def combined(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def require_clean(report: DataFrame) -> None:
    bad = report.where(F.col("violations") > 0).collect()  # one row per check
    if bad:
        raise ValueError("contract violated: " + ", ".join(f"{r['check']}={r['violations']}" for r in bad))


def row_count(df: DataFrame, expected: Column, source: DataFrame, name: str = "row_count") -> DataFrame:
    """Rows of ``df`` against an aggregate of another table, such as a sum of event counts."""
    left, right = df.agg(F.count(F.lit(1)).alias("a")), source.agg(expected.alias("b"))
    return left.crossJoin(right).select(F.lit(name).alias("check"), F.abs(F.col("a") - F.col("b")).cast("long").alias("violations"))


def unique_key(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return violations(counts, {name: F.col("n") == 1})


def equal_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str = "equal_keys") -> DataFrame:
    """Distinct keys present on one side only."""
    marked = a.select(*keys, F.lit(1).alias("s")).unionByName(b.select(*keys, F.lit(2).alias("s")))
    sides = marked.groupBy(*keys).agg(F.bit_or("s").alias("s"))
    return violations(sides, {name: F.col("s") == 3})


def known_values(df: DataFrame, column: str, allowed: DataFrame, name: str) -> DataFrame:
    """Rows whose value is missing from a look-up table."""
    absent = lookup_join(df.select(column), allowed.select(column).distinct(), [column], "left_anti")
    return absent.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def reference_row_checks(reference: DataFrame) -> DataFrame:
    flags = F.col("quality_flags").bitwiseAND(F.lit(EXCLUDED_BITS))
    return violations(
        reference,
        {
            "no_excluded_flag": flags == 0,
            "no_negative_gap": F.col("gap_ms") >= 0,
            "first_gap_zero": (F.col("within_skill_index") > 0) | (F.col("gap_ms") == 0),
            "split_known": F.col("split").isin(*SPLITS),
            "class_known": F.col("sample_class").isin(*CLASSES),
            "outcome_present": F.col("is_correct").isNotNull(),
        },
    )


def sequence_checks(reference: DataFrame) -> DataFrame:
    """Index contiguous from 0, split and class constant, class matching the length."""
    groups = reference.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.min("within_skill_index").alias("low"), F.max("within_skill_index").alias("high"),
        F.sum("within_skill_index").alias("total"), F.sum(F.col("within_skill_index") * F.col("within_skill_index")).alias("squares"),
        F.min("split").alias("s0"), F.max("split").alias("s1"), F.min("sample_class").alias("c0"), F.max("sample_class").alias("c1"),
    )
    n = F.col("n")
    wanted = F.when(n <= 2, CLASSES[0]).otherwise(CLASSES[1])
    return violations(
        groups,
        {
            "index_from_zero": (F.col("low") == 0) & (F.col("high") == n - 1),
            # Sum and sum of squares of n integers in 0..n-1 fix the set 0..n-1 for practical purposes
            # and need no distinct aggregation; uniqueness itself is checked by unique_key.
            "index_sums": (F.col("total") * 2 == n * (n - 1)) & (F.col("squares") * 6 == n * (n - 1) * (2 * n - 1)),
            "split_constant": F.col("s0") == F.col("s1"),
            "class_constant": F.col("c0") == F.col("c1"),
            "class_matches_length": F.col("c0") == wanted,
        },
    )


def split_agreement(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """Pairs whose split differs from the learner's split."""
    lookup = splits.select("learner_id", F.col("split").alias("learner_split"))
    joined = lookup_join(pairs, lookup, ["learner_id"], "left")
    return violations(joined, {"split_agrees": F.col("split") == F.col("learner_split")})


def cell_checks(cells: DataFrame, keys: Sequence[str], metrics: Sequence[str], bounded: Sequence[str], expected: int) -> DataFrame:
    """One row per cell, the expected number of cells, finite metrics, and metrics in [0, 1]."""
    finite = {f"finite_{m}": F.abs(F.col(m)) < float("inf") for m in metrics}
    ranges = {f"range_{m}": F.col(m).between(-1e-12, 1 + 1e-12) for m in bounded}
    total = cells.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("cell_count").alias("check"), F.abs(F.col("n") - expected).cast("long").alias("violations")
    )
    return combined([unique_key(cells, keys, "one_row_per_cell"), total, violations(cells, {**finite, **ranges})])


def piece_checks(pieces: DataFrame) -> DataFrame:
    """Sequence pieces: not empty, ordered, finite gaps."""
    events = F.col("events")
    return violations(
        pieces,
        {
            "piece_not_empty": F.size(events) > 0,
            "piece_ordered": F.element_at(events, -1).i - F.get(events, F.lit(0)).i == F.size(events) - 1,
            "gaps_present": F.forall(events, lambda e: e.gap_ms.isNotNull() & (e.gap_ms >= 0)),
            "outcomes_binary": F.forall(events, lambda e: e.y.isin(0, 1)),
        },
    )
