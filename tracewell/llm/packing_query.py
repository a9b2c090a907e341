"""op10: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import packing
from tracewell.llm.common import Scratch
from tracewell.llm.registry import register, table


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    with Scratch(spark) as scratch:
        path = public_tokenizers.path("word_bpe_49k.json")
        rows = scratch.save(packing.pieces(table(spark, sf_dir, "documents"), path, crc=True))
        return scratch.save(packing.pack(scratch, rows), keep=True)
