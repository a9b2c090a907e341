"""op8: all conversations formatted, and digests read back from the output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import chat
from tracewell.llm.registry import register, table

PROBE = "</s>[INST] ok [/INST]"

# Every control string gets one more character; a turn adds the template's 23.
CHAT_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') "role", coalesce(text, '') "text" from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, len(regexp_extract_all("role" || chr(10) || "text",
    '<\\*(\|turn\|>|\|body\|>|\|end\|>|s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>|\|startoftext\|>|\|im_start\|>|\|im_end\|>)|\[\\*(INST\]|/INST\])')) controls
  from c
)
select conv_id, count(*) n_turns,
  sha256(string_agg("role" || chr(10) || "text" || chr(10), '' order by turn, "role", "text")) turns_sha256,
  sum(case when "role" = 'assistant' then length("text") else 0 end)::bigint loss_chars,
  sha256(coalesce(string_agg(case when "role" = 'assistant' then "text" end, '' order by turn, "role", "text"), '')) loss_sha256,
  sum(length("role") + length("text") + controls + 23)::bigint formatted_chars
from e group by conv_id
"""


@register("op8_chat_format", CHAT_SQL)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = chat.read_back(chat.format_chats(chat.conversations(rows.union(probe)), *paths), *paths)
    joined = F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
