"""op2: all documents mixed to the weights 1, 2, 3 in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import mixing
from tracewell.llm.common import Scratch
from tracewell.llm.registry import register, table

MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5('0:' || doc_id) h
  from documents
), s as (
  select *, ((place - 1) % 3 + 1)::double w, (3 * s)::double cap
  from (select source, sum(size)::bigint s, row_number() over (order by source nulls last) place from d group by source)
), ordered as (
  select *, coalesce(sum(cap) over before, 0) held, (sum(w) over ()) - coalesce(sum(w) over before, 0) rest
  from s window before as (order by cap / w, place rows between unbounded preceding and 1 preceding)
), level as (
  select coalesce((
    select x from (select *, ((select sum(s) from s) - held) / rest x from ordered)
    where cap / w >= x order by cap / w, place limit 1), 0) x
), goal as (
  select source, place, s, least(cap, w * x) target from s, level
), q as (
  select d.*, place, s, target, sum(size) over (partition by place order by h, doc_id rows unbounded preceding) through
  from d join goal on d.source is not distinct from goal.source
), c as (
  select q.*, turn, (turn * s + through) / target finish
  from q, (values (0), (1), (2)) t(turn)
  where size > 0 and target > 0
), r as (
  select doc_id, size, sum(size) over (order by finish, h, place, doc_id, turn rows unbounded preceding) total from c
), taken as (
  select doc_id, sum(size)::bigint taken from r where total <= (select sum(size) from d) group by doc_id
)
select q.doc_id, q.size, q.s source_size, q.target, coalesce(taken, 0)::bigint taken
from q left join taken using (doc_id)
"""


@register("op2_source_mixing", MIX_SQL)
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    with Scratch(spark) as scratch:
        mixed = mixing.mix(scratch, table(spark, sf_dir, "documents"))
        return scratch.save(mixed.select("doc_id", "size", "source_size", "target", "taken"), keep=True)
