"""Removal of repeated passages on a compacted De Bruijn graph of words.

Windows of ``K`` words are the edges of the graph. It isn't built whole: consecutive edges
of a document with the same minimizer (the least hash among the window's ``M``-word grams)
form one path piece, so that all occurrences of an edge meet in its minimizer's bucket and
an edge costs a few bytes there. A bucket keeps the edges that occur in several documents,
with the least document as their source, and returns for each piece which of its edges have
an earlier source. Joined with the documents by their coordinates, pieces that follow each
other make up the maximal repeated paths, whose words are removed.

Pieces whose edges all have an earlier source among the documents hashed in the same step are
settled there and bypass the buckets, so a passage in a third of all documents reaches its
bucket once a step. Buckets are read in the order of documents and need no more memory than
their distinct edges. Edges are compared by ``EDGE_BYTES`` of their hash beside the 64 bits
of the minimizer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import one, slices

K = 13
M = 4
PIECE = 16  # edges of a piece at most
EDGE_BYTES = 6
TEXT_SLICE = 600_000

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _STEP = (_RANDOM.integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
_GRAM = _RANDOM.integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64."""
    held = _POWERS.get(int(base))
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        held = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, np.uint64(_inverse(base))))
        _POWERS[int(base)] = held
    return held[0][:n], held[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(values: np.ndarray, base: np.uint64, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[first..last], whatever the place."""
    up, down = _powers(base, len(values))
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * up)])
    return _mixed((total[last + 1] - total[first]) * down[first])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1) - 1
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
    return _sums(_BYTE[data], _BASE, starts, ends), counts


def pieces_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, edges, minimizer) of every piece, and the edges of all pieces in a row."""
    n = len(hashes) - K + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    valid = owner[:n] == owner[K - 1 :] if n > 0 else np.empty(0, bool)
    at = np.flatnonzero(valid)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    grams = _mixed(sum(hashes[j : len(hashes) - M + 1 + j] * _GRAM[j] for j in range(M)))
    span, low = 1, grams
    while 2 * span <= K - M + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = K - M + 1 - span
    low = (np.minimum(low[: len(low) - rest], low[rest:]) if rest else low)[:n]
    edges = _sums(hashes, _STEP, at, at + K - 1)
    low = low[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1])
    run = np.flatnonzero(fresh)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    first = np.flatnonzero(place % PIECE == 0)
    text = owner[at[first]]
    return text, at[first] - begin[text], np.diff(np.append(first, len(at))), low[first], edges


def _settled(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Edges that also occur here in a document with a smaller id."""
    order = np.argsort(edges, kind="stable")
    e = edges[order]
    fresh = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
    least = np.minimum.reduceat(ids[order], fresh)
    out = np.empty(len(e), bool)
    out[order] = ids[order] > np.repeat(least, np.diff(np.append(fresh, len(e))))
    return out


def path_pieces(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, place, known, edges) of all pieces of ``docs`` (doc_id, tag, text).

    ``place`` is the piece's first word, plus the tag in its upper half. ``known`` holds the
    bits of the edges that are settled already; such a piece has no edges left.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist(), TEXT_SLICE):
                hashes, counts = word_hashes([t or b"" for t in texts.slice(a, b - a).to_pylist()])
                text, start, sizes, low, edges = pieces_of(hashes, counts)
                if not len(text):
                    continue
                ids = batch.column(0).slice(a, b - a).to_numpy()[text]
                place = (batch.column(1).slice(a, b - a).to_numpy()[text] << 32) + start
                first = np.cumsum(sizes) - sizes
                done = np.logical_and.reduceat(_settled(np.repeat(ids, sizes), edges), first)
                bucket = np.where(done, _mixed(low + edges[first] + ids.astype(np.uint64)), low).view(np.int64)
                open_edges = edges[np.repeat(~done, sizes)]
                raw = np.ascontiguousarray(open_edges.view(np.uint8).reshape(-1, 8)[:, :EDGE_BYTES])
                ends = np.concatenate([[0], np.cumsum(np.where(done, 0, sizes) * EDGE_BYTES)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                known = np.where(done, (1 << sizes) - 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids), pa.array(place), pa.array(known), packed], ["bucket", "doc_id", "place", "known", "edges"])

    return docs.mapInArrow(work, "bucket long, doc_id long, place long, known int, edges binary")


class _Bucket:
    """The least document of each edge of the bucket that goes on in the next batch."""

    def __init__(self) -> None:
        self.bucket: int | None = None
        self.edges, self.least = np.empty(0, np.uint64), np.empty(0, np.int64)


def _bits(batch: pa.RecordBatch, carried: _Bucket) -> np.ndarray:
    """Per piece the bits of its edges with an earlier source; pieces are sorted by bucket, doc_id."""
    bucket, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    bits = batch.column(3).to_numpy().copy()
    sizes = pc.binary_length(batch.column(4)).to_numpy().astype(np.int64) // EDGE_BYTES
    fresh = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    starts = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    several = np.maximum.reduceat(ids, starts) > np.minimum.reduceat(ids, starts)
    several[-1] = True  # may go on in the next batch
    if carried.bucket == bucket[0]:
        several[0] = True
    rows = np.flatnonzero(several[group] & (sizes > 0))
    piece = np.repeat(rows, sizes[rows])
    if not len(piece):
        if carried.bucket != bucket[-1]:
            carried.__init__()
            carried.bucket = int(bucket[-1])
        return bits
    offsets = np.frombuffer(batch.column(4).buffers()[1], np.int32)[batch.column(4).offset :][: len(batch) + 1].astype(np.int64)
    number = np.arange(len(piece)) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows])
    raw = np.frombuffer(batch.column(4).buffers()[2], np.uint8)
    wide = np.zeros((len(piece), 8), np.uint8)
    wide[:, :EDGE_BYTES] = raw[(offsets[piece] + number * EDGE_BYTES)[:, None] + np.arange(EDGE_BYTES)]
    edges = wide.view(np.uint64)[:, 0]
    order = np.lexsort((edges, group[piece]))  # stable, so documents stay in order
    e, g, d = edges[order], group[piece][order], ids[piece][order]
    first = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (g[1:] != g[:-1])]))
    least = d[first].copy()
    if carried.bucket == bucket[0]:
        head = first[g[first] == 0]
        at = np.searchsorted(carried.edges, e[head])
        hit = at < len(carried.edges)
        hit[hit] = carried.edges[at[hit]] == e[head][hit]
        least[: len(head)][hit] = carried.least[at[hit]]
    covered = d > np.repeat(least, np.diff(np.append(first, len(e))))
    np.bitwise_or.at(bits, piece[order][covered], (1 << number[order][covered]).astype(np.int32))
    tail = g[first] == group[-1]
    kept_edges, kept_least = e[first][tail], least[tail]
    if carried.bucket == bucket[-1]:
        new = ~np.isin(kept_edges, carried.edges)
        kept_edges, kept_least = np.concatenate([carried.edges, kept_edges[new]]), np.concatenate([carried.least, kept_least[new]])
        order = np.argsort(kept_edges, kind="stable")
        kept_edges, kept_least = kept_edges[order], kept_least[order]
    carried.bucket, carried.edges, carried.least = int(bucket[-1]), kept_edges, kept_least
    return bits


def repeated_edges(pieces: DataFrame) -> DataFrame:
    """(doc_id, place, bits) of the pieces with edges that have a smaller document as source."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = _Bucket()
        for batch in batches:
            if len(batch):
                bits = _bits(batch, carried)
                rows = pa.array(np.flatnonzero(bits))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), pa.array(bits).take(rows)], ["doc_id", "place", "bits"])

    dealt = pieces.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    return dealt.mapInArrow(work, "doc_id long, place long, bits int")


def kept_words(text: bytes, places: np.ndarray, bits: np.ndarray) -> tuple[int, int, list[bytes]]:
    """(words, removed words, kept words) for pieces at word ``places`` with edge ``bits``."""
    words = text.split()
    if not len(places):
        return len(words), 0, words
    row, number = np.nonzero((bits[:, None] >> np.arange(PIECE)) & 1)
    at = places[row] + number
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + K, -1)
    keep = np.cumsum(step[:-1]) == 0
    return len(words), len(words) - int(keep.sum()), [words[i] for i in np.flatnonzero(keep).tolist()]


def _compressed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` compressed (null as empty), to halve what the join moves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [pack(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "tag", "text"])

    return docs.mapInArrow(work, "doc_id long, tag long, text binary")


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row: ``kept`` is the words left, joined by one
    space, or with ``digest`` its SHA-256 as ``kept_sha256``.

    A word goes if a window of ``K`` words that covers it also starts in a document with a
    smaller doc_id. A null text has no words. Repeated rows of a doc_id are judged each by
    its own text and are no source to each other; rows without a doc_id lose nothing and are
    no source. An empty table gives no row. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    again = one(ids.agg(F.max(F.when(F.col("doc_id").isNotNull(), F.col("n")))))[0] or 0
    # Where doc_ids repeat, a hash of the text tells their rows apart.
    tag = F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(F.lit(0x7FFFFFFF)) if again > 1 else F.lit(0).cast("long")
    docs = docs.select("doc_id", tag.alias("tag"), "text")
    found = repeated_edges(path_pieces(docs.filter("doc_id is not null")))
    found = found.select("doc_id", F.shiftright("place", 32).alias("tag"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"), "bits")
    found = found.distinct() if again > 1 else found  # rows that repeat as a whole
    by_doc = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "bits")).alias("found"))
    joined = _compressed(docs).join(by_doc, ["doc_id", "tag"], "left").select("doc_id", "text", "found")
    name = "kept_sha256" if digest else "kept"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            unpack = zstandard.ZstdDecompressor().decompress
            sizes = pc.list_value_length(batch.column(2)).fill_null(0).to_numpy()
            values = batch.column(2).flatten()
            at, bits = (values.field(i).to_numpy() for i in (0, 1))
            end = np.cumsum(sizes)
            for i, text in enumerate(batch.column(1)):
                part = slice(end[i] - sizes[i], end[i])
                n, removed, kept = kept_words(unpack(text.as_py()), at[part], bits[part])
                kept = b" ".join(kept)
                rows.append((n, removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            n, removed, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", name])

    return joined.mapInArrow(work, f"doc_id long, n_words long, n_removed long, {name} string")
