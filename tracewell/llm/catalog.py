"""Imports every query module of this subpackage and exposes the filled tables."""

from tracewell.llm import chat_query, collocation_query, language_query, mixing_query, neardup_query, packing_query, pii_query, prefixfree_query, repair_query, simhash_query, substring_query, topk_query, warc_query  # noqa: F401
from tracewell.llm.registry import QUERIES, SQL

import corpus_pipeline  # isort: skip  # its stages use the operators above

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["QUERIES", "SQL"]
