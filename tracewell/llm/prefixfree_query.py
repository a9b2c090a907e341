"""op13: all documents without the bytes of strings that start earlier, too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import prefixfree
from tracewell.llm.common import Scratch
from tracewell.llm.registry import register, table

# Bytes are pairs of hexadecimal digits, so a string of 100 bytes is 200 of them.
PREFIX_FREE_SQL = r"""
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) h from documents
), s as (
  select doc_id, unnest(range(0, len(h) // 2 - 99)) i, h from d where len(h) >= 200
), k as (
  select doc_id, i, md5(substr(h, 2 * i + 1, 200)) w from s
), g as (
  select doc_id, i, row_number() over (partition by w order by doc_id, i) again from k
), r as (
  select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end fresh from g where again > 1
), t as (
  select doc_id, i, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) run from r
), runs as (
  select doc_id, run, min(i) a, max(i) + 100 b from t group by doc_id, run
), gaps as (
  select doc_id, a, coalesce(lag(b) over w, 0) before, b, lead(a) over w following from runs window w as (partition by doc_id order by a)
), kept as (
  select g.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || case when following is null then substr(h, 2 * b + 1) else '' end, '' order by a) t,
    sum(b - a)::bigint n_removed, count(*) n_spans
  from gaps g join d using (doc_id) group by g.doc_id
)
select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(coalesce(t, h))) kept_sha256
from d left join kept using (doc_id)
"""


@register("op13_prefix_free_dedup", PREFIX_FREE_SQL)
def op13_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    with Scratch(spark) as scratch:
        return scratch.save(prefixfree.without_repeats(scratch, table(spark, sf_dir, "documents"), digest=True), keep=True)
