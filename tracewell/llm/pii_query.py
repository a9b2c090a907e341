"""op7: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import pii
from tracewell.llm.registry import register, table


@register("op7_pii_spans")
def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.model(docs))
    text = {c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))) for c in ("pii_base", "pii_spans")}
    counts = [F.expr(f"size(filter(pii_base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(text["pii_base"], 256).alias("base_sha256"), text["pii_spans"].alias("spans"))
