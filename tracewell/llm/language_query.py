"""op5: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import language
from tracewell.llm.registry import register, table


@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, with its words and switches."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.training_rows(docs))
    found = language.identify(docs.select("doc_id", "text"), model) if model else language.identify(docs)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_words").alias("n_words"), F.col("lang_switches").alias("n_switches"))
