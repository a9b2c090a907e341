"""Near copies by the Jaccard similarity of five-word shingles, at least ``SIMILAR``.

A text is the set of its five-word shingles (fewer words: the whole sequence); equal sets are
one node. The method is that of ``simhash``: 64-bit fingerprints of the shingles, and the pairs
at most ``simhash.TAU`` bits apart by the generalised pigeonhole principle. A fingerprint can't
tell whether a pair reaches the limit (at 0.8 about 10 bits differ), so each link is verified by
the exact similarity of the two sets, and what fingerprints can't reach is then looked for
between nodes that they left apart:

Candidates share one of ``BANDS`` bands of ``ROWS`` MinHashes: a pair at similarity s is no
candidate with probability (1 - s^4)^32, which is 5e-8 at 0.8 and less above. In a bucket of up
to ``HOT`` nodes all pairs are verified. In a larger one the nodes are compared to a hub, the
node that meets most others in large buckets (of equals the one of the smallest doc_id). The nodes of buckets that are still in several
components then go on by an exact rule, whatever bucket they share. Shingles are ordered, rare
ones last in rank. Of two sets with at least c common shingles, the rarest common one has rank c
or more in both, and sets of sizes n and m at the limit have c = 4/9 (n + m). So only pairs that
meet in such a shingle, with sizes and ranks that allow the limit, are verified. Sets that share
a passage or a template and differ in more than the limit allows meet in no shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import simhash
from tracewell.llm.common import Scratch, slices
from tracewell.llm.components import components
from tracewell.llm.simhash import TEXT_SLICE, majority, shingle_hashes

SHINGLE = 5
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
SEED = 42
HOT = 32
# Hashes of a chunk of a set.
CHUNK = 4096
# Size classes per doubling of a set.
CLASSES = 8

_PICK = np.random.Generator(np.random.PCG64(SEED))
_FLIP = _PICK.integers(0, 2**64, BANDS * ROWS, np.uint64)
_ODD = _PICK.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingle hashes of a text in order, as unsigned 64 bit."""
    return np.unique(shingle_hashes(text or b"", SHINGLE))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys (signed 64 bit) per set that isn't empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    flat = np.concatenate(sets)
    least = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        least[:, k] = np.minimum.reduceat((flat ^ _FLIP[k]) * _ODD[k], starts)
    cells = least.reshape(len(sets), BANDS, ROWS)
    keys = [[xxhash.xxh64_intdigest(cell.tobytes(), band) for band, cell in enumerate(row)] for row in cells]
    return np.array(keys, np.uint64).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__text_hash``, which with doc_id names a row; null where doc_id is."""
    return docs.withColumn("__text_hash", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, content, n, fp, keys) per row that has a doc_id.

    ``content`` is a 128-bit digest of the shingle set, ``n`` its size, ``fp`` its SimHash,
    ``keys`` its band keys (none if the text has no words).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist(), TEXT_SLICE):
                sets = [shingle_set(t) for t in texts.slice(a, b - a).to_pylist()]
                held = [s for s in sets if len(s)]
                found = iter(band_keys(held) if held else [])
                keys = pa.array([next(found) if len(s) else [] for s in sets], pa.list_(pa.int64()))
                content = pa.array([xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets], pa.binary())
                sizes = pa.array([len(s) for s in sets], pa.int64())
                fps = pa.array(majority(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), content, sizes, fps, keys], ["doc_id", "text_hash", "content", "n", "fp", "keys"])

    rows = _keyed(docs).filter("doc_id is not null").select(F.col("doc_id").cast("long"), "__text_hash", F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, text_hash long, content binary, n long, fp long, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, used: DataFrame) -> DataFrame:
    """(node, level, chunk, hashes): the sets of ``used`` (node, level), cut by the top ``level``
    bits of their hashes, from the text of one row each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist(), TEXT_SLICE):
                rows, chunks, hashes, sizes = [], [], [], []
                for i, (text, level) in enumerate(zip(texts.slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()), a):
                    held = shingle_set(text)
                    chunk = (held >> np.uint64(64 - level)).astype(np.int32) if level else np.zeros(len(held), np.int32)
                    cuts = np.flatnonzero(np.diff(chunk, prepend=-1))
                    rows += [i] * len(cuts)
                    chunks.append(chunk[cuts])
                    sizes.append(np.diff(np.append(cuts, len(held))))
                    hashes.append(held)
                if rows:
                    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes).view(np.int64)))
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(chunks)), lists], ["node", "level", "chunk", "hashes"])

    rows = nodes.join(used.hint("merge"), "node").select("node", "level", F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    keyed = _keyed(docs).filter("doc_id is not null").select("doc_id", "text", "__text_hash")
    # The nodes grow with the documents, so the join is a shuffle at every size.
    texts = keyed.join(rows.hint("merge"), (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__text_hash") == F.col("__hash")))
    return texts.select("node", "level", F.col("text").cast("string")).mapInArrow(work, "node long, level int, chunk int, hashes array<long>")


def _level(size: Column) -> Column:
    """Bits that cut a set of this size into chunks of about ``CHUNK``."""
    return F.ceil(F.log2(F.greatest(size / CHUNK, F.lit(1.0)))).cast("int")


def _levels(nodes: DataFrame) -> DataFrame:
    """(node, level): the levels of all pairs in which a set (node, n) can be ``SIMILAR``."""
    low, high = SIMILAR
    return nodes.select("node", F.explode(F.sequence(_level(F.col("n")), _level(F.expr(f"{high} * n div {low}")))).alias("level"))


def _verified(scratch: Scratch, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, na, nb) whose ``sets`` are at least ``SIMILAR``.

    Sets meet chunk by chunk of about ``CHUNK`` hashes at most, so no row holds a whole large set;
    the hashes that two chunks share are counted by Spark and added up."""
    low, high = SIMILAR
    pairs = scratch.save(pairs.select("a", "b", "na", "nb", _level(F.greatest("na", "nb")).alias("level")))
    side = lambda node, name: sets.select(F.col("node").alias(node), "level", "chunk", F.col("hashes").alias(name)).hint("merge")
    # Hubs of large buckets are in many pairs, so their sets come last, where a join can split.
    met = pairs.join(side("b", "hb"), ["b", "level"]).join(side("a", "ha"), ["a", "level", "chunk"])
    common = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("c")).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    return scratch.save(common.filter(f"{high} * c >= {low} * (na + nb - c)").select("a", "b"))


def _pairs(joined: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of rows with x, y and their sizes nx, ny that can be ``SIMILAR``."""
    low, high = SIMILAR
    fit = joined.filter(f"x <> y and {high} * least(nx, ny) >= {low} * greatest(nx, ny)")
    return fit.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb")).distinct()


def _fingerprint_pairs(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """Pairs that connect the nodes of equal fingerprints, and those at most ``simhash.TAU`` bits apart."""
    held = nodes.filter("n > 0").select("node", "n", "fp")
    distinct = scratch.save(held.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("least")).select("fp", F.col("least.node").alias("rep"), F.col("least.n").alias("nrep")))
    equal = held.join(distinct.hint("merge"), "fp").select(F.col("rep").alias("x"), F.col("node").alias("y"), F.col("nrep").alias("nx"), F.col("n").alias("ny"))
    near = simhash.links(scratch, distinct.select("fp", "rep")).distinct()
    size = lambda node, n: distinct.select(F.col("rep").alias(node), F.col("nrep").alias(n)).hint("merge")
    near = near.select(F.col("a").alias("x"), F.col("b").alias("y")).join(size("x", "nx"), "x").join(size("y", "ny"), "y")
    return _pairs(equal.union(near.select("x", "y", "nx", "ny")))


def _rare_pairs(scratch: Scratch, sets: DataFrame, apart: DataFrame) -> DataFrame:
    """All pairs of ``apart`` (node, n, top) of different ``top`` that can be ``SIMILAR``: they meet
    in a shingle whose rank in both sets, counted from the most frequent shingle, allows it.

    A shingle of one ``top`` only makes no pair and counts as rarest. The smaller set of a pair
    stands at its size class, the larger one goes to the classes that its rank allows. As most
    sets of a frequent shingle may be of one ``top``, these meet the others only.
    """
    low, high = SIMILAR
    both = low + high
    held = apart.withColumn("level", _level(F.col("n"))).join(sets.hint("merge"), ["node", "level"])
    held = scratch.save(held.select("node", "n", "top", F.explode("hashes").alias("token")))
    counts = held.groupBy("token").agg(F.count("*").alias("f"), F.min("top").alias("t0"), F.max("top").alias("t1")).filter("t0 <> t1")
    ranks = Window.partitionBy("node").orderBy(F.desc("f"), F.desc("token"))
    ranked = held.join(counts.select("token", "f").hint("merge"), "token").withColumn("r", F.row_number().over(ranks))
    ranked = scratch.save(ranked.filter(f"{high} * r >= {low} * n").select("token", "node", "n", "top", "r"))
    group = lambda size: f"int(floor(log2({size}) * {CLASSES}))"
    small = ranked.filter(f"{both} * r >= {2 * low} * n").withColumn("class", F.expr(group("n")))
    large = ranked.withColumn("least", F.expr(f"({low} * n + {high - 1}) div {high}")).withColumn("most", F.expr(f"least(n, ({both} * r - {low} * n) div {low})"))
    large = large.filter("least <= most").withColumn("class", F.expr(f"explode(sequence({group('least')}, {group('most')}))"))
    main = small.groupBy("token", "class", "top").agg(F.count("*").alias("k")).groupBy("token", "class").agg(F.max(F.struct("k", "top")).alias("main"))
    main = scratch.save(main.select("token", "class", F.col("main.top").alias("main")))
    named = lambda rows, x: rows.join(main.hint("merge"), ["token", "class"]).select("token", "class", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("top").alias(f"t{x}"), F.col("r").alias(f"r{x}"), (F.col("top") != F.col("main")).alias(f"o{x}"))
    small, large = scratch.save(named(small, "y")), scratch.save(named(large, "x"))
    fit = f"tx <> ty and (ny < nx or ny = nx and y < x) and {high} * ny >= {low} * nx and {both} * least(rx, ry) >= {low} * (nx + ny)"
    meet = lambda left, right: left.join(right.hint("merge"), ["token", "class"]).filter(fit).select("x", "y", "nx", "ny")
    return _pairs(meet(large, small.filter("oy")).union(meet(large.filter("ox"), small.filter("not oy"))))


def _topped(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` with the least node of the component of ``node`` as ``top``."""
    found = rows.join(least.select(F.col("a").alias("node"), F.col("b").alias("__top")).hint("merge"), "node", "left")
    return found.withColumn("top", F.coalesce("__top", "node")).drop("__top")


def classes(scratch: Scratch, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): nodes that aren't the least of their component, with the least."""
    banded = nodes.filter("size(keys) > 0").select("node", "n", F.explode("keys").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = scratch.save(banded.join(sizes.hint("merge"), "key"))
    close = scratch.save(_fingerprint_pairs(scratch, nodes))
    used = shared.select("node", "n").union(close.select("a", "na")).union(close.select("b", "nb")).distinct()
    sets = scratch.save(_sets(docs, nodes, _levels(used)))
    edges = _verified(scratch, sets, close)
    shared = scratch.save(_topped(shared, components(scratch, edges)))
    side = lambda rows, name: rows.select("key", F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("top").alias(f"t{name}"))
    small, hot = shared.filter(f"size <= {HOT}"), shared.filter(f"size > {HOT}")
    pairs = _pairs(side(small, "x").join(side(small, "y").hint("merge"), "key").filter("x < y and tx <> ty"))
    meets = hot.groupBy("node").agg(F.sum("size").alias("meets")).join(nodes.select("node", F.bitwise_not("first.doc_id").alias("late")).hint("merge"), "node")
    hubs = hot.join(meets.hint("merge"), "node").groupBy("key").agg(F.max_by(F.struct("node", "n", "top"), F.struct("meets", "late", "node")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.node").alias("x"), F.col("hub.n").alias("nx"), F.col("hub.top").alias("tx"))
    stars = _pairs(hubs.join(side(hot, "y").hint("merge"), "key").filter("tx <> ty"))
    edges = edges.union(_verified(scratch, sets, pairs.union(stars).distinct()))
    least = components(scratch, edges)
    if hot.isEmpty():
        return least
    named = scratch.save(_topped(hot.select("key", "node", "n"), least))
    split = named.groupBy("key").agg(F.min("top").alias("t0"), F.max("top").alias("t1")).filter("t0 <> t1").select("key")
    apart = scratch.save(named.join(split.hint("merge"), "key", "left_semi").select("node", "n", "top").distinct())
    more = _verified(scratch, sets, _rare_pairs(scratch, sets, apart))
    return least if more.isEmpty() else components(scratch, edges.union(more))


def first_of_group(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``docs`` without the near copies: of each group the row with the smallest doc_id stays.

    Of rows that repeat this doc_id with texts of the group, the one with the least text hash
    stays; with a text of another group, the row belongs to that one. Texts without words are
    one group. Rows without a doc_id all stay.
    """
    columns = docs.columns
    marked = scratch.save(signatures(docs))
    nodes = marked.groupBy("content").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"))
    nodes = scratch.save(nodes.select(F.monotonically_increasing_id().alias("node"), "first", "n", "fp", "keys"))
    repeated = not marked.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    texts = docs
    if repeated:
        texts = _keyed(docs.select("doc_id", "text")).dropDuplicates(["doc_id", "__text_hash"]).drop("__text_hash")
    least = classes(scratch, texts, nodes)
    grouped = nodes.join(least.hint("merge"), nodes.node == least.a, "left").groupBy(F.coalesce("b", "node")).agg(F.min("first").alias("first"))
    kept = grouped.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    kept = scratch.save(kept.union(kept.sparkSession.createDataFrame([(None, None)], "__id long, __hash long")), keep=True)
    found = _keyed(docs)
    # The kept ids grow with the documents, so the join is a shuffle at every size.
    found = found.join(kept.hint("merge"), found.doc_id.eqNullSafe(kept["__id"]) & found["__text_hash"].eqNullSafe(kept["__hash"]), "left_semi")
    if repeated:
        order = Window.partitionBy("doc_id", "__text_hash").orderBy(F.xxhash64(*[F.col(c) for c in ("text", *columns)]))
        found = found.withColumn("__first_of_group", F.row_number().over(order)).filter("doc_id is null or __first_of_group = 1")
    return found.select(*columns)
