"""A corpus pipeline: language ID, near-dedup, PII masking, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
result to the shared folder and reads it again as the next one's documents. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import language, mixing, nearcopies, packing, pii
from tracewell.llm.common import Scratch

# A text whose best language has a smaller mean probability is rejected, as is one without letters.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; ``lang`` becomes the predicted one."""
    found = language.identify(docs)
    good = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= MIN_SCORE))
    return good.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of texts with a five-word similarity >= 0.8."""
    with Scratch(spark) as scratch:
        return nearcopies.first_of_group(scratch, docs)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    columns = docs.columns
    return pii.find(docs, pii.model(docs), masked=True).select(*columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (not at all, or up to three times)."""
    with Scratch(spark) as scratch:
        return mixing.mixed(scratch, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    with Scratch(spark) as scratch:
        rows = scratch.save(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), crc=True))
        return scratch.save(packing.pack(scratch, rows), keep=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii_masking", pii_masking),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# The language and PII stages are fitted models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for i, (_, stage) in enumerate(STAGES):
            docs = scratch.save(stage(spark, docs, sf_dir), keep=i == len(STAGES) - 1)
    return docs
