"""op11: the best collocations of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import collocation
from tracewell.llm.common import Scratch
from tracewell.llm.registry import register, table

COLLOCATION_SQL = r"""
with t as (
  select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents
), p as (
  select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') w from t
), s as (
  select lang, w, unnest(range(1, len(w) + 1)) i from p
), g as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') g, count(*) f from s, range(1, 5) r(m) where i + m - 1 <= len(w) group by all
), n as (
  select lang, sum(f)::bigint n from g where m = 1 group by lang
), c as (
  select lang, g, m, f a, string_split(g, ' ') w from g where f >= 30
), longer as (
  select lang, array_to_string(w[:m - 1], ' ') g, a from c where m > 1 union all select lang, array_to_string(w[2:], ' '), a from c where m > 1
), most as (
  select lang, g, max(a) e from longer group by all
), cuts as (
  select c.lang, c.g, c.a, k, x.a l, y.a r, ((2000000::hugeint * c.a) // (x.a + y.a))::bigint score
  from c, range(1, 4) q(k), c x, c y
  where c.m > k and x.lang = c.lang and x.g = array_to_string(c.w[:k], ' ') and y.lang = c.lang and y.g = array_to_string(c.w[k + 1:], ' ')
), least as (
  select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1
), ranked as (
  select l.*, row_number() over (partition by lang order by score desc, a desc, encode(g)) as "rank"
  from least l left join most using (lang, g) where not coalesce(100 * e >= 80 * a, false)
)
select lang, "rank", g phrase, a, l, r, n, score from ranked join n using (lang) where "rank" <= 2000
"""


@register("op11_phrase_collocations", COLLOCATION_SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first 2000 phrases."""
    with Scratch(spark) as scratch:
        return scratch.save(collocation.collocations(scratch, table(spark, sf_dir, "documents")), keep=True)
