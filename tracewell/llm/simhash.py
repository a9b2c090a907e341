"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Documents become 64-bit fingerprints of their 3-word shingles. Two fingerprints at ``TAU`` or
fewer differing bits agree, in at least one of m bit partitions, to within that partition's
threshold, for any thresholds of -1 or more that sum to TAU - m + 1 (-1: not probed).
Correlated bits are put into one partition, and thresholds are allotted by dynamic
programming over the candidate counts of each (partition, threshold), measured or estimated
from all distinct fingerprints. Fingerprints that share a probe are verified by their
differing bits. Equal fingerprints are one vertex from the start, and a bucket gives a
spanning forest of its links, never its pairs.

A bucket of over ``HOT`` fingerprints isn't compared pair by pair. Its members are
grouped instead by the fingerprints at distance 0 and 1: two fingerprints share one of these
just when they differ in at most 2 bits, so linking each group to its least member keeps the
components exact with 65 rows a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, one, slices
from tracewell.llm.components import components

TAU = 2
SHINGLE = 3
SEED = 42
HOT = 512
PARTITIONS = (2, 3)
TEXT_SLICE = 1_500_000
PAIRS = 2_000_000
# Hashes whose bits are unpacked at once (64 bytes each).
BLOCK = 1 << 20


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all ``size``-word shingles (fewer words: of the whole sequence) as unsigned 64 bit."""
    words = text.lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Per list of hashes the integer whose bits are set in over half of them; none: zero."""
    out = np.zeros(len(hashes), np.uint64)
    held = [i for i, h in enumerate(hashes) if len(h)]
    if held:
        sizes = np.array([len(hashes[i]) for i in held])
        bits = lambda flat: np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if sizes.sum() <= BLOCK:
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            counts = np.add.reduceat(bits(np.concatenate([hashes[i] for i in held])), starts, axis=0, dtype=np.int32)
        else:  # a very long text
            counts = np.array([sum(bits(hashes[i][j : j + BLOCK]).sum(axis=0, dtype=np.int64) for j in range(0, len(hashes[i]), BLOCK)) for i in held])
        out[held] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) per row; ``fp`` holds the 64 bits. A null text is an empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist(), TEXT_SLICE):
                found = majority([shingle_hashes(t or b"") for t in texts.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fp long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set, as a 64 x 64 matrix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["cell", "n"])

    rows = distinct.select("fp").mapInArrow(work, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()
    flat = np.zeros(4097)
    for cell, n in rows:
        flat[cell] = n
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m partitions of nearly equal size, each grown from a seed by adding the
    unused bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = list(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [max(free, key=lambda b: (correlation[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (correlation[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def allot(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per partition, that sum to ``total`` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for held, (paid, chosen) in best.items():
            for threshold, price in cost.items():
                option = (paid + price, [*chosen, threshold])
                if held + threshold not in grown or option < grown[held + threshold]:
                    grown[held + threshold] = option
        best = grown
    return best[total]


def plan(distinct: DataFrame) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, over all distinct fingerprints.

    Pairs that agree in a whole partition are counted exactly; those at distance 1 or 2
    inside it are estimated from the share of agreeing pairs of each bit. A probe counts
    as one candidate too.
    """
    n, both = bit_counts(distinct)
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-9, 1.0)
    layouts = {m: group_bits(n, both, m) for m in PARTITIONS}
    flat = [(m, k, bits) for m, groups in layouts.items() for k, bits in enumerate(groups)]
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("key")) for i, (_, _, bits) in enumerate(flat)])
    per_key = distinct.select(F.explode(keys).alias("k")).groupBy("k.i", "k.key").count()
    pairs = dict(per_key.groupBy("i").agg(F.sum(F.expr("double(count) * (count - 1) / 2"))).collect())
    options = []
    for m, groups in layouts.items():
        costs = []
        for k, bits in enumerate(groups):
            exact = pairs.get(next(i for i, f in enumerate(flat) if f[:2] == (m, k)), 0.0) or 0.0
            ratio = ((1 - agree[bits]) / agree[bits]).sum()
            w = len(bits)
            costs.append({-1: 0.0, 0: n + exact, 1: n * w + exact * (1 + ratio), 2: n * w * (w - 1) / 2 + exact * (1 + ratio + ratio * ratio / 2)})
        paid, thresholds = allot(costs, TAU - m + 1)
        options.append((paid, m, thresholds))
    _, m, thresholds = min(options)
    return [(bits, t) for bits, t in zip(layouts[m], thresholds) if t >= 0]


def probes(partitions: list[tuple[list[int], int]]) -> Column:
    """Array of (probe number, masked bits): within a partition of threshold t, each way of
    leaving out t bits is a probe, shared just by those that differ in these bits at most."""
    parts = []
    for bits, threshold in partitions:
        for out in combinations(bits, threshold):
            mask = F.lit(mask_of([b for b in bits if b not in out]))
            parts.append(F.struct(F.lit(len(parts)).alias("probe"), F.col("fp").bitwiseAND(mask).alias("key")))
    return F.array(*parts)


def bucket_links(fps: np.ndarray, reps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each bucket; buckets lie one after the other."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(fps))
    left, right = [], []
    step = 1
    live = at
    while len(live := live[live + step < ends[live]]):
        near = np.bitwise_count(fps[live] ^ fps[live + step]) <= TAU
        left.append(live[near])
        right.append(live[near] + step)
        step += 1
    if not left:
        return reps[:0], reps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    root = at.copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    moved = root != at
    return reps[at[moved]], reps[root[moved]]


def _verified(buckets: DataFrame) -> DataFrame:
    """Edges (a, b) of buckets with arrays ``fps`` and ``reps``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(0)).to_numpy()
            for x, y in slices((sizes.astype(np.int64) ** 2).tolist(), PAIRS):
                fps, reps = (np.asarray(batch.column(c).slice(x, y - x).flatten()) for c in (0, 1))
                a, b = bucket_links(fps.view(np.uint64), reps, sizes[x:y])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return buckets.select("fps", "reps").mapInArrow(work, "a long, b long")


def links(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between representatives that connect all fingerprints at most TAU bits apart."""
    probed = distinct.select("fp", "rep", F.explode(probes(plan(distinct))).alias("p")).select("fp", "rep", "p.probe", "p.key")
    sizes = scratch.save(probed.groupBy("probe", "key").agg(F.count("*").alias("size")).filter("size > 1"))
    shared = probed.join(sizes, ["probe", "key"])
    ordinary = shared.filter(f"size <= {HOT}").groupBy("probe", "key").agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))
    edges = _verified(ordinary)
    if (one(sizes.agg(F.max("size")))[0] or 0) > HOT:
        hot = scratch.save(shared.filter(f"size > {HOT}").select("fp", "rep").distinct())
        near = F.expr("concat(array(fp), transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j)))")
        stars = hot.select("rep", F.explode(near).alias("near"))
        least = stars.groupBy("near").agg(F.min("rep").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        edges = edges.union(stars.join(least, "near").filter("rep > b").select(F.col("rep").alias("a"), "b").distinct())
    return edges


def near_groups(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links. Texts without words (empty,
    null) have fingerprint zero and link like any other; repeated rows and equal texts are
    linked; rows whose doc_id is null get a fingerprint, and the component of equal
    fingerprints if one of these has a doc_id. An empty table gives no row. Other columns
    are not read.
    """
    marked = scratch.save(fingerprints(docs))
    distinct = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"))
    least = components(scratch, links(scratch, distinct))
    classes = distinct.join(least, distinct.rep == least.a, "left").select("fp", F.coalesce("b", "rep").alias("component_id"))
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def first_of_group(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``docs`` without the near copies: of each group the row with the smallest doc_id stays.

    Of rows that repeat this doc_id the one with the least text hash stays. Rows without a
    doc_id all stay.
    """
    groups = near_groups(scratch, docs)
    kept = groups.filter("doc_id is null or doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"))
    kept = scratch.save(kept, keep=True)
    columns = docs.columns
    if (one(kept.filter("__id is not null").agg(F.max("__n")))[0] or 0) > 1:
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(c) for c in ("text", *columns)]))
        docs = docs.withColumn("__first_of_group", F.row_number().over(order)).filter("doc_id is null or __first_of_group = 1")
    # The kept ids grow with the documents, so the join is a shuffle at every size.
    return docs.join(kept.hint("merge"), docs.doc_id.eqNullSafe(kept["__id"]), "left_semi").select(*columns)
