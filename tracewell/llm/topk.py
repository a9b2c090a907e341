"""Exact top-k search by term-at-a-time accumulation.

A vector is a bag of integer-weighted terms (its dimensions). Candidates are taken in
blocks; a block is turned into postings (per term, the rows that have it and their weights),
and each term of the queries scatters its weighted postings into a dense array of scores,
rows by queries. The best k of every block are selected by partition and merged with those
found before; the tasks' best are merged by a ranking per query.

Queries are sent to the tasks in blocks of at most about ``QUERY_BLOCK``, one pass over the
candidates each, so what is broadcast is bounded whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch

SCALE = 64
QUERY_BLOCK = 4_096
ROW_BLOCK = 1_024
TILE = 128
_NONE = np.iinfo(np.int64).min


def finite(vector: Column) -> Column:
    """True for vectors that aren't null and hold neither nulls nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(sizes.max(initial=0)))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def weights(values: np.ndarray) -> np.ndarray:
    """floor(64 x) as whole numbers; beyond 64 bits they stop at its ends."""
    return np.clip(np.floor(values * SCALE), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores rows x queries: each term adds (weight of the row) x (weight of the query)."""
    width = min(queries.shape[1], rows.shape[1])
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(width, 1)
    kind = np.int32 if bound < 2**31 else np.int64
    terms = [(t, q) for t in range(width) if (q := queries[:, t].astype(kind)).any()]
    out = np.zeros((len(rows), len(queries)), kind)
    for start in range(0, len(rows), TILE):
        tile, scores = rows[start : start + TILE], out[start : start + TILE]
        for t, query in terms:
            column = tile[:, t].astype(kind)
            postings = np.flatnonzero(column)
            if len(postings) == len(column):
                scores += column[:, None] * query
            else:
                scores[postings] += column[postings, None] * query
    return out


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query (column) the k best (score, id), ties to the smaller id, in no order.

    ``ids`` ascend. Score and place make one key, so that partition selection is exact.
    """
    n = len(ids)
    if n > k:
        if np.abs(scores[scores != _NONE]).max(initial=0) < 2**50:
            keys = np.where(scores == _NONE, _NONE, scores * np.int64(2 * n) + (n - 1 - np.arange(n))[:, None])
            chosen = np.argpartition(~keys, k - 1, axis=0)[:k]
        else:
            place = np.broadcast_to(np.arange(n)[:, None], scores.shape)
            chosen = np.lexsort((place, np.where(scores == _NONE, np.inf, -scores.astype(np.float64))), axis=0)[:k]
        return np.take_along_axis(scores, chosen, axis=0), ids[chosen]
    return scores, np.broadcast_to(ids[:, None], scores.shape)


def search(scratch: Scratch, queries: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product of each query.

    Both tables have vec_id and embedding; the weights are floor(64 x). A row with the
    query's own vec_id is no candidate; ties go to the smaller vec_id; all candidates are
    returned if they are fewer than k. Vectors that are null or hold null or non-finite
    components, and rows without a vec_id, take no part; a shorter vector lacks the further
    terms. Repeated rows are candidates of their own, but a vec_id makes one query (that of
    its least vector). An empty table gives no row. Other columns are not read.
    """
    usable = F.col("vec_id").isNotNull() & finite(F.col("embedding"))
    rows = rows.select(F.col("vec_id").cast("long"), "embedding").filter(usable)
    asked = queries.select(F.col("vec_id").cast("long"), "embedding").filter(usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = scratch.save(asked)
    blocks = max(1, round(asked.count() / (0.9 * QUERY_BLOCK)))
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    parts = []
    for b in range(blocks):
        block = asked.filter(block_of == b).toArrow().combine_chunks().sort_by("vec_id")
        if not len(block):
            continue
        query_ids = block.column("vec_id").to_numpy()
        sent = scratch.spark.sparkContext.broadcast((query_ids, weights(matrix(block.column("embedding").combine_chunks()))))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, query_weights = sent.value
            top_score = np.empty((0, len(query_ids)), np.int64)
            top_id = np.empty((0, len(query_ids)), np.int64)
            for batch in batches:
                for start in range(0, len(batch), ROW_BLOCK):
                    part = batch.slice(start, ROW_BLOCK)
                    ids = part.column(0).to_numpy()
                    order = np.argsort(ids, kind="stable")
                    ids = ids[order]
                    scores = accumulate(query_weights, weights(matrix(part.column(1)))[order]).astype(np.int64)
                    at = np.searchsorted(query_ids, ids)
                    own = (at < len(query_ids)) & (query_ids[np.minimum(at, len(query_ids) - 1)] == ids)
                    scores[np.flatnonzero(own), at[own]] = _NONE
                    found, who = best_rows(scores, ids, k)
                    found, who = np.concatenate([top_score, found]), np.concatenate([top_id, who])
                    if len(found) > k:
                        order = np.lexsort((who, np.where(found == _NONE, np.inf, -found.astype(np.float64))), axis=0)[:k]
                        found, who = np.take_along_axis(found, order, axis=0), np.take_along_axis(who, order, axis=0)
                    top_score, top_id = found, who
            held = top_score != _NONE
            asker = np.broadcast_to(query_ids, held.shape)
            yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in (asker, top_id, top_score)], ["query_id", "vec_id", "score"])

        parts.append(scratch.save(rows.mapInArrow(work, "query_id long, vec_id long, score long")))
        sent.unpersist()
    if not parts:
        return scratch.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
