"""SQL text of the shared views, used to check the registered queries with another engine."""

from __future__ import annotations

import re

M64 = "18446744073709551616::UHUGEINT"


def _mul(x: str, k: int) -> str:
    return f"((({x})::UHUGEINT * {k}::UHUGEINT) % {M64})::UBIGINT"


def _add(x: str, k: int) -> str:
    return f"((({x})::UHUGEINT + {k}::UHUGEINT) % {M64})::UBIGINT"


def hash_steps(source: str, key: str, out: str, prefix: str) -> dict[str, str]:
    """CTEs that add splitmix64(key) as ``h`` to the rows of ``source``."""
    return {
        f"{prefix}0": f"select *, {_add(key, 0x9E3779B97F4A7C15)} as z0 from {source}",
        f"{prefix}1": f"select *, {_mul('xor(z0, z0 >> 30)', 0xBF58476D1CE4E5B9)} as z1 from {prefix}0",
        f"{prefix}2": f"select *, {_mul('xor(z1, z1 >> 27)', 0x94D049BB133111EB)} as z2 from {prefix}1",
        out: f"select * exclude (z0, z1, z2), xor(z2, z2 >> 31) as h from {prefix}2",
    }


VIEWS: dict[str, str] = {
    "questions_v": """
select 'q'||k as question_id, 'b'||(k//3) as bundle_id, substr('abcd',1+k%4,1) as correct_answer, cast(1+k%7 as integer) as part,
  case when k%10=0 then '' when k%10=1 then (k%5)||';'||((k+1)%5) else (k%5)||'' end as skill_ids,
  case when k%10=0 then 0 when k%10=1 then 2 else 1 end as skill_count,
  case when k%10>1 then k%5 end as primary_skill_id,
  case when k%7=0 then 1704500000000 end as deployed_at_ms
from (select distinct cast(props->>'k' as int) k from events) where k<99""",
    "raw_v": """
select learner_id, case when event_id%211=0 then null else ts_ms end as timestamp_ms, event_id//3 as solving_id, 'q'||k as question_id,
  case when event_id%97=0 then 'z' when value>35 then substr('abcd',1+k%4,1) else substr('abcd',1+(k+1)%4,1) end as user_answer,
  case when event_id%89=0 then -1 else cast(floor(value*1000) as bigint) end as elapsed_time_ms,
  row_number() over (partition by learner_id order by case when event_id%41=0 then ts_ms+259200000 else ts_ms end, event_id, dup)+1 as source_row
from (with e as (select user_id as learner_id, epoch_us(ts)//1000 as ts_ms, event_id, cast(props->>'k' as int) as k, value from events)
  select *, 0 as dup from e union all select *, 1 from e where event_id%50=0)""",
    "ordered_v": """
select *, coalesce(timestamp_ms < last_value(timestamp_ms ignore nulls) over (partition by learner_id order by source_row rows between unbounded preceding and 1 preceding), false) as out_of_order,
  row_number() over (partition by learner_id order by timestamp_ms is null, timestamp_ms, source_row) - 1 as sequence_index,
  row_number() over (partition by learner_id, timestamp_ms, solving_id, question_id, user_answer, elapsed_time_ms order by source_row) > 1 as is_repeat
from raw_v""",
    "cleaned_v": """
select o.learner_id, o.sequence_index, o.timestamp_ms, o.solving_id, o.question_id, q.bundle_id, o.user_answer, q.correct_answer,
  case when q.question_id is not null and o.user_answer in ('a','b','c','d') then o.user_answer = q.correct_answer end as is_correct,
  o.elapsed_time_ms, q.part, coalesce(q.skill_ids,'') as skill_ids, coalesce(q.skill_count,0) as skill_count, q.primary_skill_id, q.deployed_at_ms,
  'u'||o.learner_id||'.csv' as source_file, o.source_row,
  case when q.question_id is null then 7 else 0 end + case when q.skill_count = 0 then 4 else 0 end
  + case when out_of_order then 8 else 0 end + case when is_repeat then 16 else 0 end
  + case when o.user_answer in ('a','b','c','d') then 0 else 32 end
  + case when o.elapsed_time_ms < 0 then 64 else 0 end + case when o.elapsed_time_ms > 300000 then 128 else 0 end
  + case when o.timestamp_ms < q.deployed_at_ms then 256 else 0 end + case when o.timestamp_ms is null then 512 else 0 end as quality_flags
from ordered_v o left join questions_v q using (question_id)""",
    "usable_v": """
select * from cleaned_v where skill_count = 1 and primary_skill_id >= 0 and is_correct is not null and timestamp_ms is not null and quality_flags & 567 = 0""",
    "item_counts_v": """
select question_id, count(*) as interaction_rows, count(*) filter (where is_correct) as correct_rows from usable_v group by 1""",
    "eligible_v": """
select c.question_id, q.primary_skill_id as skill_id, q.part, c.interaction_rows, c.correct_rows, c.correct_rows / c.interaction_rows as accuracy
from item_counts_v c join questions_v q using (question_id) where c.interaction_rows >= (select floor(0.9::double * avg(interaction_rows)) from item_counts_v) and q.skill_count = 1""",
    "items_v": """
select * from eligible_v where skill_id in (select skill_id from eligible_v group by 1 having count(*) >= 5)""",
    "seq_v": """
select *, primary_skill_id as skill_id, row_number() over w - 1 as within_skill_index, coalesce(timestamp_ms - lag(timestamp_ms) over w, 0) as gap_ms
from usable_v where question_id in (select question_id from items_v) window w as (partition by learner_id, primary_skill_id order by timestamp_ms, sequence_index)""",
    "pair_base_v": """
select learner_id, skill_id, count(*) as event_count, count(*) filter (where is_correct) as correct_count,
  min(timestamp_ms) as first_timestamp_ms, max(timestamp_ms) as last_timestamp_ms,
  count(*) filter (where gap_ms > 0) as positive_gap_count, coalesce(max(gap_ms) filter (where gap_ms > 0), 0) as max_positive_gap_ms
from seq_v group by 1, 2""",
    **hash_steps("pair_base_v", "xor(learner_id::UBIGINT, 11636841376413550081::UBIGINT)", "pair_hash_v", "ph"),
    "groups_v": """
select * exclude (h), case when h % 10000 < 7000 then 0 when h % 10000 < 8500 then 1 else 2 end as split_code from pair_hash_v""",
    "stats_v": """
select skill_id, count(*) as unique_learners, sum(event_count)::bigint as interaction_rows, sum(correct_count)::bigint as correct_rows,
  sum(correct_count) / sum(event_count) as accuracy, count(*) filter (where event_count >= 2) as learners_2_plus,
  count(*) filter (where event_count >= 3) as learners_3_plus, count(*) filter (where event_count >= 5) as learners_5_plus,
  sum(positive_gap_count)::bigint as positive_gap_count,
  count(*) filter (where split_code = 0) as train_learners, count(*) filter (where split_code = 1) as calibration_learners, count(*) filter (where split_code = 2) as test_learners,
  coalesce(sum(event_count) filter (where split_code = 0), 0)::bigint as train_interactions,
  coalesce(sum(event_count) filter (where split_code = 1), 0)::bigint as calibration_interactions,
  coalesce(sum(event_count) filter (where split_code = 2), 0)::bigint as test_interactions,
  count(*) filter (where event_count = 1) as learners_events_1, count(*) filter (where event_count = 2) as learners_events_2,
  count(*) filter (where event_count between 3 and 4) as learners_events_3_4, count(*) filter (where event_count between 5 and 9) as learners_events_5_9,
  count(*) filter (where event_count between 10 and 19) as learners_events_10_19, count(*) filter (where event_count >= 20) as learners_events_20_plus
from groups_v group by 1""",
    "dist_v": """
select skill_id, count(*) as eligible_items, quantile_cont(accuracy, 0.1) as item_accuracy_p10, quantile_cont(accuracy, 0.5) as item_accuracy_p50,
  quantile_cont(accuracy, 0.9) as item_accuracy_p90, quantile_cont(accuracy, 0.9) - quantile_cont(accuracy, 0.1) as item_accuracy_p90_p10_spread,
  string_agg(distinct part::varchar, ';' order by part::varchar) as parts, count(distinct part)::integer as part_count
from items_v group by 1""",
    "tiers_v": """
select *, case when strict_eligible then 'strict' when relaxed_eligible then 'relaxed_only' else 'ineligible' end as selection_tier from (
select *, eligible_items >= 5 and unique_learners >= 10 and learners_3_plus >= 5 and positive_gap_count >= 10 and item_accuracy_p90_p10_spread >= 0 and accuracy between 0.05 and 0.95 as strict_eligible,
  eligible_items >= 5 and unique_learners >= 5 and learners_3_plus >= 3 and positive_gap_count >= 5 and item_accuracy_p90_p10_spread >= 0 and accuracy between 0.05 and 0.95 as relaxed_eligible
from stats_v join dist_v using (skill_id))""",
    "pool_v": """
select * from tiers_v where case when (select count(*) from tiers_v where strict_eligible) >= 3 then strict_eligible
  when (select count(*) from tiers_v where relaxed_eligible) >= 3 then relaxed_eligible else false end""",
    "scores_v": """
select skill_id, 0.25 * u(ln(1 + unique_learners)) + 0.25 * u(ln(1 + learners_3_plus)) + 0.20 * u(ln(1 + positive_gap_count))
  + 0.15 * u(ln(1 + eligible_items)) + 0.10 * u(item_accuracy_p90_p10_spread) + 0.05 * u(ln(1 + interaction_rows)) as selection_score
from pool_v""",
    "selected_v": """
select skill_id, selection_score, row_number() over (order by round(selection_score, 9) desc, skill_id) as selection_rank from scores_v
order by round(selection_score, 9) desc, skill_id limit 3""",
    "pair_class_v": """
select *, case when event_count >= 3 then 1 else 0 end as class_code from groups_v where skill_id in (select skill_id from selected_v)""",
    **hash_steps(
        "pair_class_v",
        "xor(xor(learner_id::UBIGINT, skill_id::UBIGINT << 32), xor(class_code::UBIGINT << 60, 7822362180758744021::UBIGINT))",
        "pair_prio_v",
        "pp",
    ),
    "pairs_v": """
select learner_id, skill_id, case split_code when 0 then 'train' when 1 then 'calibration' else 'test' end as split,
  case class_code when 0 then 'cold_1_2' else 'repeat_3_plus' end as sample_class, event_count, h::decimal(20,0) as selection_priority_u64
from pair_prio_v
qualify row_number() over (partition by skill_id, split_code, class_code order by h, learner_id) <= case when class_code = 0 then 500 when split_code = 0 then 5000 else 2000 end""",
    "refint_v": """
select s.learner_id, s.skill_id, p.split, p.sample_class, s.within_skill_index, s.timestamp_ms, s.gap_ms, s.sequence_index, s.question_id, s.is_correct, s.elapsed_time_ms, s.part, s.quality_flags
from seq_v s join pairs_v p using (learner_id, skill_id)
where s.question_id in (select question_id from selected_items_v)""",
    "selected_items_v": "select * from items_v where skill_id in (select skill_id from selected_v)",
    "learner_keys_v": "select distinct learner_id from raw_v",
    **hash_steps("learner_keys_v", "xor(learner_id::UBIGINT, 11636841376413550081::UBIGINT)", "learner_hash_v", "lh"),
    "all_splits_v": """
select learner_id, case when h % 10000 < 7000 then 'train' when h % 10000 < 8500 then 'calibration' else 'test' end as split from learner_hash_v""",
    # Reference rows with one fault of each kind, to see that the checks find them.
    "broken_v": """
select learner_id, case when learner_id % 17 = 0 then 99 else skill_id end as skill_id,
  case when learner_id % 7 = 0 and within_skill_index = 1 then 'other' else split end as split,
  case when learner_id % 19 = 0 then null else sample_class end as sample_class, within_skill_index, timestamp_ms,
  case when sequence_index % 23 = 0 then -1 when learner_id % 3 = 0 and within_skill_index = 0 then 5 else gap_ms end as gap_ms, sequence_index,
  case when sequence_index % 13 = 0 then 'q99' else question_id end as question_id,
  case when sequence_index % 29 <> 0 then is_correct end as is_correct, elapsed_time_ms, part,
  case when sequence_index % 31 = 0 then quality_flags | 1 else quality_flags end as quality_flags
from refint_v where not (learner_id % 5 = 0 and within_skill_index = 1)""",
    "posgap_v": "select * from seq_v where gap_ms > 0",
    **hash_steps(
        "posgap_v",
        "xor(xor(learner_id::UBIGINT, skill_id::UBIGINT << 32), xor(timestamp_ms::UBIGINT, 15111065706836454659::UBIGINT))",
        "gap_prio_v",
        "gp",
    ),
    "gap_capped_v": """
select * from gap_prio_v qualify row_number() over (partition by learner_id // 10, skill_id order by h, learner_id, timestamp_ms, gap_ms) <= 200""",
    "gap_sample_v": """
select * from gap_capped_v qualify row_number() over (partition by skill_id order by h, learner_id, timestamp_ms, gap_ms) <= 100000""",
    "gap_quantiles_v": """
select skill_id, p::double as probability, q as gap_ms, n as sample_size from (
 select skill_id, count(*) as n, unnest([0.01,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.99]) as p,
  unnest(quantile_cont(gap_ms::double, [0.01,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.99])) as q from gap_sample_v group by 1)""",
}

# The min-max scaling of the score, expanded inline because the text must be one statement.
VIEWS["scores_v"] = re.sub(
    r"u\((.+?)\)(?= (?:\+|as)|\n)",
    lambda m: f"(case when max({m[1]}) over () <= min({m[1]}) over () then 1.0 else (({m[1]}) - min({m[1]}) over ()) / (max({m[1]}) over () - min({m[1]}) over ()) end)",
    VIEWS["scores_v"],
)


def query(body: str, recursive: bool = False, **local: str) -> str:
    """``body`` preceded by exactly the views it needs, in dependency order."""
    available = {**VIEWS, **local}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in available:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(available[name].replace(name, ""))
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} as ({available[n].strip()})" for n in ordered)
    return f"with {'recursive ' if recursive else ''}{ctes}\n{body.strip()}"
