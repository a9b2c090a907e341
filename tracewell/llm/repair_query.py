"""op12: damaged conversations repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import repair
from tracewell.llm.common import Scratch
from tracewell.llm.registry import register, table

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

# A checksum as bytes folded in, each followed by eight polynomial steps. The states of the dynamic
# programme are (cost, audit) per last role: none, system, user, assistant; least() compares them so.
REPAIR_SQL = r"""
with recursive k as (
  select conv_id, turn, coalesce("role", ' ') "role", coalesce("text", ' ') "text",
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') name from conversations
), f as (
  select k.* exclude (name), xor(list_reduce(
    flatten(list_transform(range(1, length(name) + 1), lambda i: [ord(substr(name, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, v: case when v >= 0 then xor(c, v) else xor(c >> 1, (c & 1) * 3988292384) end, 4294967295::bigint), 4294967295) % 20 fault from k
), damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else "role" end "role",
    case fault when 1 then '' when 2 then translate("text", '.!?', '') else "text" end "text",
    unnest(case when fault = 3 then [1, 2] else [1] end) copy
  from f where fault <> 0
), numbered as (
  select *, row_number() over c i, row_number() over (partition by conv_id, "role", "text" order by turn nulls first, copy) again,
    lag("role"[1]) over c || "role"[1] pair, rtrim("text", ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) said
  from damaged window c as (partition by conv_id order by turn nulls first, "role", sha256("text"), copy)
), coded as (
  select *, said = '' blank, said <> '' and again > 1 dup, said <> '' and again = 1 and said[-1] not in ('.', '!', '?') cut from numbered
), counts as (
  select conv_id, count(*) rows_left, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, sum(blank::int) blank, sum(dup::int) duplicate,
    sum(cut::int) truncated, sum((pair not in ('su', 'ua', 'au'))::int) illegal from coded group by conv_id
), edits as (
  select conv_id, i, not (blank or dup) free, (case when cut then 3 else 0 end) more, "role"[1] letter from coded
), ways as (
  select conv_id, 0::bigint i, {'c': 0::bigint, 'a': ''} n, null::struct(c bigint, a varchar) s, null::struct(c bigint, a varchar) u, null::struct(c bigint, a varchar) a from counts
  union all
  select conv_id, i, n, s, u, a from (
    select w.conv_id, e.i,
      {'c': n.c + 4, 'a': n.a || 'D'} n,
      least(case when s.c is not null then {'c': s.c + 4, 'a': s.a || 'D'} end, case when free and letter = 's' then {'c': n.c + more, 'a': n.a || 'K'} end) s,
      least({'c': u1.c + 4, 'a': u1.a || 'D'}, case when free and letter = 'u' then {'c': x.c + more, 'a': x.a || 'K'} end, case when free then {'c': x.c + 3 + more, 'a': x.a || 'R'} end) u,
      least({'c': a1.c + 4, 'a': a1.a || 'D'}, case when free and letter = 'a' then {'c': u1.c + more, 'a': u1.a || 'K'} end, case when free then {'c': u1.c + 3 + more, 'a': u1.a || 'R'} end) a
    from (
      select *, least(n, s, a1) x from (
        select *, least(a, {'c': u1.c + 3, 'a': u1.a || 'I'}) a1 from (
          select *, least(u, {'c': y.c + 3, 'a': y.a || 'I'}) u1 from (select *, least(n, s, a) y from ways))))
      w join edits e on e.conv_id is not distinct from w.conv_id and e.i = w.i + 1)
), final as (
  select w.conv_id, least(n, a, {'c': u1.c + 3, 'a': u1.a || 'I'}) best from (
    select *, case when s.c is null then u else least(u, {'c': s.c + 3, 'a': s.a || 'I'}) end u1 from ways) w
  join counts c on c.conv_id is not distinct from w.conv_id and c.rows_left = w.i
), letters as (
  select conv_id, unnest(range(1, len(best.a) + 1)) p, best.a[p] e from final
), placed as (
  select conv_id, p, e, sum((e <> 'I')::int) over (partition by conv_id order by p) i, sum((e <> 'D')::int) over (partition by conv_id order by p) o from letters
), lines as (
  select p.*, c."role" r, c."text" t, bool_or(p.o = 1 and p.e = 'K' and c."role"[1] = 's') over (partition by p.conv_id) sys
  from placed p left join coded c on c.conv_id is not distinct from p.conv_id and c.i = p.i where p.e <> 'D'
), said as (
  select conv_id, string_agg(case e when 'K' then r else case when (o - sys::int) % 2 = 1 then 'user' else 'assistant' end end
    || ':' || case e when 'I' then '' else t end, chr(10) order by p) t from lines group by conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, coalesce(best.c, 0)::bigint cost, coalesce(best.a, '') audit, sha256(coalesce(t, '')) repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id
left join final f on f.conv_id is not distinct from o.conv_id left join said s on s.conv_id is not distinct from o.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with a fault by the checksum of ``conv_id:turn``: gone, emptied, without ends of
    sentences, repeated, or said by the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))),
    ).drop("col")


@register("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    with Scratch(spark) as scratch:
        found = repair.repaired(scratch, damaged(rows), digest=True).withColumnRenamed("conv_id", "__id")
        ids = rows.select("conv_id").distinct()
        joined = ids.join(found.hint("merge"), ids["conv_id"].eqNullSafe(F.col("__id")), "left")
        zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        rest = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired", F.lit(EMPTY)).alias("repaired_sha256")]
        return scratch.save(joined.select("conv_id", *zeros, *rest), keep=True)
