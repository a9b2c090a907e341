"""op3: near-duplicate vectors of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import neardup
from tracewell.llm.common import Scratch
from tracewell.llm.registry import register, table

NEARDUP_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id a, b.vec_id b from v a join v b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93
), r as (
  select vec_id a, vec_id b from embeddings
  union
  select r.a, l.b from r join l on r.b = l.a
), c as (
  select a vec_id, min(b) component_id from r group by a
)
select vec_id, (select count(*) from l where a = vec_id)::bigint n_links, component_id, vec_id = component_id kept from c
"""


@register("op3_embedding_neardup", NEARDUP_SQL)
def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    with Scratch(spark) as scratch:
        found, _ = neardup.near_duplicates(scratch, table(spark, sf_dir, "embeddings"))
        return scratch.save(found, keep=True)
