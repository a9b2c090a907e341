"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors of a label become one node with a multiplicity. A label's nodes are dealt to
overlapping cluster shards (each node to its ``overlap`` nearest centres). Each shard builds
a graph: nearest neighbours and a few random nodes, robustly pruned, so that no kept edge
is made needless by a shorter one. The adjacency lists of all shards are united per node,
and every node is then searched for in its shards' part of the united graph: a greedy search
from the shard's medoids that goes on through every node in range until none is unexpanded.
Only cosines of visited pairs are computed, and only those at or above the threshold link.

A shard counts the links whose first common shard it is and returns one row per node with
the least node it is connected to, so pairs are never emitted. A shard of more than ``LIMIT``
nodes is cut into sub-blocks, and every pair of these is a task of its own. The links of a
bounded sample of nodes are held against brute force over all nodes; below ``TARGET``
recall, everything is repeated with more overlap and a wider search, and it is an error if
the third round is below it too.

The centres are fitted on a bounded sample (``SAMPLE`` vectors a centre, ``CENTRES`` centres
in all, for the labels with the most nodes); all nodes are indexed and searched.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, one
from tracewell.llm.components import components
from tracewell.llm.topk import finite, matrix

THRESHOLD = 0.93
SHARD = 400
LIMIT = 1_500
CENTRES = 4_096
SAMPLE = 16
DEGREE = 24
POOL = 40
RANDOM = 8
ALPHA = 1.2
MEDOIDS = 8
EXPAND = 4
AUDIT = 100
TARGET = 0.95


def unit(vectors: pa.Array) -> np.ndarray:
    rows = matrix(vectors)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _centres(rows: np.ndarray, k: int) -> np.ndarray:
    """k unit centres of unit vectors, by a few rounds of k-means from evenly spaced rows."""
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
    for _ in range(6):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def shard_centres(nodes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Centres by (label, dimensions), for labels that need more than one shard."""
    total = nodes.count()
    least = max(SHARD, total / CENTRES)
    sizes = nodes.groupBy("label", F.size("embedding").alias("width")).count().filter(F.col("count") > least)
    draw = F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1 << 30)) / float(1 << 30)
    drawn = nodes.withColumn("width", F.size("embedding")).join(sizes, ["label", "width"]).filter(draw < SAMPLE / least)
    out: dict[tuple[int, int], np.ndarray] = {}
    wanted = {(r["label"], r["width"]): int(np.ceil(r["count"] / least)) for r in sizes.collect()}
    by_key: dict[tuple[int, int], list] = {}
    for r in drawn.select("label", "width", "rep", "embedding").orderBy("rep").toLocalIterator():
        by_key.setdefault((r["label"], r["width"]), []).append(r["embedding"])
    for key, rows in by_key.items():
        x = np.array(rows, dtype=np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[key] = _centres(x, min(wanted[key], len(x)))
    return out


def assigned(nodes: DataFrame, centres: dict[tuple[int, int], np.ndarray], overlap: int) -> DataFrame:
    """``nodes`` with ``width`` and ``shards``, the ascending numbers of their nearest centres."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy()
            widths = np.array([len(v) for v in batch.column(2)], dtype=np.int32)
            shards: list[list[int]] = [[0]] * len(labels)
            for key in set(zip(labels.tolist(), widths.tolist())) & centres.keys():
                at = np.flatnonzero((labels == key[0]) & (widths == key[1]))
                near = unit(batch.column(2).take(pa.array(at))) @ centres[key].T
                take = min(overlap, near.shape[1])
                best = np.sort(np.argpartition(-near, take - 1, axis=1)[:, :take], axis=1)
                for i, row in zip(at.tolist(), best.tolist()):
                    shards[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(widths), pa.array(shards, pa.list_(pa.int32()))], [*batch.schema.names, "width", "shards"])

    return nodes.select("rep", "label", "embedding", "n").mapInArrow(work, "rep long, label long, embedding array<double>, n long, width int, shards array<int>")


def dealt(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """One row per node and task: its shard and, for shards over ``LIMIT``, the pair of sub-blocks."""
    members = nodes.withColumn("shard", F.explode("shards"))
    task = ["label", "width", "shard"]
    large = scratch.save(members.groupBy(*task).count().filter(F.col("count") > LIMIT).withColumn("cuts", F.ceil(F.col("count") / (LIMIT / 2)).cast("int")).drop("count"))
    members = members.join(large, task, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    members = members.withColumn("sub", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("cuts")).cast("int"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)")))
    return members.withColumn("low", F.least("sub", "other")).withColumn("high", F.greatest("sub", "other")).drop("other", "cuts")


def pruned_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges (from, to) of the robust-pruned neighbour graph of unit rows."""
    n = len(x)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    random = np.random.default_rng(n)
    pool = min(POOL, n - 1)
    sources, targets = [], []
    for start in range(0, n, 256):
        rows = np.arange(start, min(start + 256, n))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -np.inf
        chosen = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        chosen = np.concatenate([chosen, random.integers(n, size=(len(rows), RANDOM))], axis=1)
        cos = np.einsum("rcd,rd->rc", x[chosen], x[rows])
        order = np.argsort(-cos, axis=1, kind="stable")
        chosen, cos = np.take_along_axis(chosen, order, axis=1), np.take_along_axis(cos, order, axis=1)
        to_row = np.maximum(2 - 2 * cos, 0)  # squared distances
        vectors = x[chosen]
        between = np.maximum(2 - 2 * (vectors @ vectors.transpose(0, 2, 1)), 0)
        alive = chosen != rows[:, None]
        degree = np.zeros(len(rows), int)
        for c in range(chosen.shape[1]):
            pick = alive[:, c] & (degree < DEGREE)
            degree += pick
            sources.append(rows[pick])
            targets.append(chosen[pick, c])
            alive[:, c + 1 :] &= ~(pick[:, None] & (ALPHA**2 * between[:, c, c + 1 :] <= to_row[:, c + 1 :]))
    a, b = np.concatenate(sources), np.concatenate(targets)
    return np.concatenate([a, b]), np.concatenate([b, a])


def medoids(x: np.ndarray) -> np.ndarray:
    """The row nearest to the mean, then rows each far from those chosen."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(MEDOIDS, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return np.unique(chosen)


def range_search(x: np.ndarray, lists: list[np.ndarray], rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) pairs at or above the threshold that greedy search from the medoids finds.

    Each round expands, for every row, its best unexpanded nodes if they are among the
    ``beam`` best so far, and all unexpanded nodes in range.
    """
    n, q = len(x), len(rows)
    sizes = np.array([len(a) for a in lists])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(lists) if sizes.sum() else np.empty(0, np.int64)
    cos = np.full((q, n), -np.inf)
    closed = np.zeros((q, n), bool)
    first = medoids(x)
    cos[:, first] = x[rows] @ x[first].T
    live = np.arange(q)
    while len(live):
        seen = cos[live]
        open_cos = np.where(closed[live], -np.inf, seen)
        step = min(EXPAND, n)
        best = np.argpartition(-open_cos, step - 1, axis=1)[:, :step]
        limit = -np.partition(-seen, min(beam, n) - 1, axis=1)[:, min(beam, n) - 1]
        value = np.take_along_axis(open_cos, best, axis=1)
        expand = open_cos >= THRESHOLD
        good = (value > -np.inf) & (value >= limit[:, None])
        expand[np.nonzero(good)[0], best[good]] = True
        r, node = np.nonzero(expand)
        r, live = live[r], live[expand.any(axis=1)]
        closed[r, node] = True
        for at in range(0, len(r), 50_000):
            rs, ns = r[at : at + 50_000], node[at : at + 50_000]
            count = sizes[ns]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[ns], count)
            key = np.repeat(rs, count) * n + flat[place]
            key = np.unique(key[cos.ravel()[key] == -np.inf])
            for k in range(0, len(key), 100_000):
                kr, kn = np.divmod(key[k : k + 100_000], n)
                cos[kr, kn] = np.einsum("ij,ij->i", x[rows[kr]], x[kn])
    return np.nonzero(cos >= THRESHOLD)


_MEMBERS = ["rep", "label", "width", "shard", "low", "high", "sub"]
_TASK = ["label", "width", "shard", "low", "high"]


def _build(members: DataFrame) -> DataFrame:
    """(rep, to): the adjacency lists of every task."""

    def work(table: pa.Table) -> pa.Table:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        table = table.combine_chunks().sort_by("rep")
        rep = table.column("rep").to_numpy()
        a, b = pruned_graph(unit(table.column("embedding").combine_chunks()))
        order = np.argsort(a, kind="stable")
        cuts = np.searchsorted(a[order], np.arange(len(rep) + 1)).astype(np.int32)
        return pa.table({"rep": rep, "to": pa.ListArray.from_arrays(pa.array(cuts), pa.array(rep[b[order]]))})

    return members.groupBy(*_TASK).applyInArrow(work, "rep long, to array<long>")


def _search(members: DataFrame, beam: int) -> DataFrame:
    """(rep, links, root): links counted by this task, and the least node connected in it."""

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("rep")
        rep, n, sub = (table.column(c).to_numpy() for c in ("rep", "n", "sub"))
        x = unit(table.column("embedding").combine_chunks())
        lists = []
        for to in table.column("to").to_pylist():
            near = np.unique(np.array(to or [], dtype=np.int64))
            at = np.minimum(np.searchsorted(rep, near), len(rep) - 1)
            lists.append(at[rep[at] == near])
        found = np.zeros((len(rep), len(rep)), bool)
        for start in range(0, len(rep), 512):
            r, node = range_search(x, lists, np.arange(start, min(start + 512, len(rep))), beam)
            found[r + start, node] = True
        found |= found.T
        np.fill_diagonal(found, False)
        if table.column("low")[0].as_py() != table.column("high")[0].as_py():
            found &= sub[:, None] != sub[None, :]
        a, b = np.nonzero(found)
        root = np.arange(len(rep))
        while True:
            before = root.copy()
            np.minimum.at(root, a, root[b])
            root = root[root]
            if np.array_equal(before, root):
                break
        shard = table.column("shard")[0].as_py()
        earlier = [{s for s in held if s < shard} for held in table.column("shards").to_pylist()]
        mine = np.array([not (earlier[i] & earlier[j]) for i, j in zip(a.tolist(), b.tolist())], dtype=bool)
        links = np.bincount(a[mine], n[b[mine]], len(rep)).astype(np.int64)
        return pa.table({"rep": rep, "links": links, "root": rep[root]})

    return members.groupBy(*_TASK).applyInArrow(work, "rep long, links long, root long")


def _audit(nodes: DataFrame, found: DataFrame) -> float:
    """Share of the true links of a bounded sample of nodes that were found; all nodes are compared."""
    total = nodes.count()
    if not total:
        return 1.0
    draw = F.pmod(F.xxhash64(F.lit(9), "rep"), F.lit(1 << 30)) / float(1 << 30)
    asked = nodes.filter(draw < AUDIT / total).limit(4 * AUDIT).toArrow().combine_chunks()
    if not len(asked):
        return 1.0
    labels, reps = asked.column("label").to_numpy(), asked.column("rep").to_numpy()
    by_width: dict[int, list[int]] = {}
    for i, v in enumerate(asked.column("embedding")):
        by_width.setdefault(len(v), []).append(i)
    units = {w: (np.array(at), unit(asked.column("embedding").combine_chunks().take(pa.array(at)))) for w, at in by_width.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(labels), np.int64)
        for batch in batches:
            widths = np.array([len(v) for v in batch.column(2)])
            for w, (at, x) in units.items():
                rows = np.flatnonzero(widths == w)
                if len(rows):
                    near = x @ unit(batch.column(2).take(pa.array(rows))).T >= THRESHOLD
                    near &= labels[at][:, None] == batch.column(1).to_numpy()[rows][None, :]
                    near &= reps[at][:, None] != batch.column(0).to_numpy()[rows][None, :]
                    count[at] += near @ batch.column(3).to_numpy()[rows]
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(count)], ["rep", "truth"])

    truth = nodes.select("rep", "label", "embedding", "n").mapInArrow(work, "rep long, truth long").groupBy("rep").agg(F.sum("truth").alias("truth"))
    row = one(truth.join(found, "rep", "left").agg(F.sum("truth"), F.sum(F.coalesce("links", F.lit(0)))))
    return 1.0 if not row[0] else (row[1] or 0) / row[0]


def near_duplicates(scratch: Scratch, vectors: DataFrame, overlap: int = 2, beam: int = 16) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id, kept) per row, audited recall).

    Vectors link within one label and dimension. Those that are null, empty or zero, hold
    null or non-finite components or have no label link with nothing. Repeated rows are
    vectors of their own that link with each other; a repeated vec_id is one vertex of the
    components. Rows without a vec_id take no part and have 0 links, no component and are not
    kept. An empty table gives no row. Other columns are not read.
    """
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), doubles.alias("embedding"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(usable, F.lit(False))
    nodes = scratch.save(rows.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "label", "embedding", "n"))
    centres = shard_centres(nodes)
    for _ in range(3):
        members = scratch.save(dealt(scratch, assigned(nodes, centres, overlap)))
        lists = _build(members).groupBy("rep").agg(F.flatten(F.collect_list("to")).alias("to"))
        searched = scratch.save(_search(members.join(lists, "rep", "left"), beam))
        links = scratch.save(searched.groupBy("rep").agg(F.sum("links").alias("links")))
        recall = _audit(nodes, links)
        if recall >= TARGET:
            break
        overlap, beam = overlap + 1, 2 * beam
    else:
        raise RuntimeError(f"audited recall {recall:.4f} is below {TARGET} after the last round: links are missing")
    least = components(scratch, searched.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = nodes.join(links, "rep", "left").join(least, F.col("rep") == F.col("a"), "left")
    classes = classes.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("b", "rep").alias("component_id"))
    keyed = rows.select("vec_id", F.when(usable, F.col("label")).alias("label"), F.when(usable, F.col("embedding")).alias("embedding"))
    out = keyed.join(classes, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    return out, recall
