"""op1: the 20 best rows of every query vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import topk
from tracewell.llm.common import Scratch
from tracewell.llm.registry import register, table

TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
)
select query_id, rank::integer "rank", vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 20
"""


@register("op1_topk_search", TOPK_SQL)
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    with Scratch(spark) as scratch:
        return scratch.save(topk.search(scratch, rows.filter("vec_id % 20 = 0"), rows), keep=True)
