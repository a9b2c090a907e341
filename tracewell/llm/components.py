"""Connected components of a graph given as edges, with one row per vertex as the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, one


def _toward_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step: every vertex ``a`` links its neighbours ``b`` to the least vertex it knows.

    The minimum is a partially aggregated group, and the join back to the edges is a sort
    merge join, which adaptive execution splits when one vertex has very many neighbours.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    if larger_only:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b): for every vertex that has an edge and isn't the least of its component, the least.

    ``edges`` has long columns ``a`` and ``b`` in any direction. Large-star and small-star
    steps alternate until the edges stop changing; each round is written to the shared
    folder. Vertices without an edge, and the least ones themselves, have no row.
    """
    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        row = one(now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")))
        if row["n"] == 0 or (row["n"], row["h"]) == mark:
            return now
        mark = (row["n"], row["h"])
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = scratch.save(_toward_minimum(both, larger_only=True))
        after = scratch.save(_toward_minimum(large, larger_only=False))
        scratch.forget(large)
        scratch.forget(now)
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
