"""op6: all documents without the passages that an earlier document has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import substring
from tracewell.llm.registry import register, table

SUBSTRING_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), s as (
  select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13
), g as (
  select doc_id, i, min(doc_id) over (partition by array_to_string(w[i:i + 12], ' ')) least from s
), covered as (
  select distinct doc_id, i + j i from g, range(13) r(j) where least < doc_id
), words as (
  select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i from d
), kept as (
  select doc_id, count(*) n, string_agg(word, ' ' order by i) t from words anti join covered using (doc_id, i) group by doc_id
)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (doc_id)
"""


@register("op6_substring_dedup", SUBSTRING_SQL)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substring.without_repeats(table(spark, sf_dir, "documents"), digest=True)
