"""op4: near-duplicate groups of all documents by SimHash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import simhash
from tracewell.llm.common import Scratch
from tracewell.llm.registry import register, table


@register("op4_simhash_groups")
def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    with Scratch(spark) as scratch:
        groups = simhash.near_groups(scratch, table(spark, sf_dir, "documents"))
        return scratch.save(groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), keep=True)
