"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over ``GRAM`` bytes picks triggers: a gram is one if it is the least (leftmost
on ties) of some string of ``SPAN`` bytes, so every such string holds one and equal strings
hold it at the same place. Triggers cut a text into phrases: the starts whose strings share a
trigger, with all bytes those strings cover. The distinct phrases are the dictionary, their
sequence in the documents is the parse.

* Occurrences of the parse meet by trigger. Of equal phrases only the first occurrence has
  strings that may be first ones; the others are repeats as a whole, whatever their length.
* A trigger with one distinct phrase needs no more. Where it has several, the suffixes of
  its phrases are put in order (over the dictionary alone, each phrase once, its bytes fetched
  from its first occurrence), and equal neighbours give the earlier start.
* Repeats of both kinds are joined with the documents, whose other bytes stay.

Phrases are equal if 64 bits of the trigger's hash, 48 of the phrase's own, its length and the
trigger's place agree; suffixes of unequal phrases are compared byte by byte. A task holds the distinct phrases
of one range of triggers and gives out repeats as it reads them. A trigger of
over ``DEAL`` distinct phrases isn't handled by one task: its strings are dealt by their own
hash and the first of each is a partial minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, one, slices

SPAN = 100
GRAM = 32
DEAL = 20_000
# Starts hashed in one step; a step's bytes overlap the next one's.
STEP = 1 << 18
TEXT_SLICE = 8 << 20
# Triggers are dealt by ranges of their hash, one for so many bytes of text; a task takes several.
RANGE_BYTES = 8 << 20
MAX_PARTITIONS = 8192
COMBINE = 1_000_000

_PICK = np.random.default_rng(20250311)
_BYTE = _PICK.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(_PICK.integers(0, 2**62) * 2 + 1)
_PLACE = np.uint64((1 << 24) - 1)
_POWERS: list[np.ndarray] = []

FOUND = "doc_id long, tag long, at long, n int"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, inverse)]
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


class Rolling:
    """Hashes of substrings of ``data``, equal for equal bytes whatever the place."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1])])

    def every(self, size: int) -> np.ndarray:
        return _mixed((self.total[size:] - self.total[:-size]) * self.down[: len(self.total) - size])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[first]) * self.down[first])


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def phrases(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(trigger, phrase, first start, number of starts) of the parse of texts that end at ``ends``.

    Starts whose string would cross the end of its text are none. Hashes are unsigned.
    """
    none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    parts = [none]
    for a in range(0, len(data) - span + 1, STEP):
        block = data[a : a + STEP + span - 1]
        rolling = Rolling(block)
        grams = rolling.every(gram)
        marked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        trigger = (_sliding_least(marked, span - gram + 1) & _PLACE).astype(np.int64)
        starts = np.arange(a, a + len(trigger))
        owner = np.searchsorted(ends, [a, a + len(block)], side="right")
        inside = ends[owner[0] : owner[1] + 1]
        limit = np.repeat(inside, np.diff(np.clip(inside, a, a + len(trigger)), prepend=a))
        at = np.flatnonzero(starts + span <= limit)
        if not len(at):
            continue
        place = trigger[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        run = np.flatnonzero(fresh)
        n = np.diff(np.append(run, len(at)))
        first = at[run]
        shape = ((place[run] - first) * (span + 1) + n).astype(np.uint64)
        # Triggers have small hashes, so these are mixed once more to spread over all ranges.
        parts.append((_mixed(grams[place[run]]), _mixed(rolling.of(first, first + n - 1 + span) + _mixed(shape)), first + a, n))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _planes(values: np.ndarray) -> bytes:
    """The bytes of an integer array, all first bytes before all second ones: packs better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplaned(raw: bytes, dtype: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(dtype)[:, 0]


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary texts in a row (null: none) and the end of each."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    return np.frombuffer(b"".join([t.as_py() or b"" for t in texts]), np.uint8), ends


def parse(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, packed) of the occurrences of all phrases in ``docs`` (doc_id, tag, text), by trigger."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, last in slices(pc.binary_length(texts).fill_null(0).to_pylist(), TEXT_SLICE):
                data, ends = _joined(texts.slice(first, last - first))
                trigger, phrase, at, n = phrases(data, ends)
                row = np.searchsorted(ends, at, side="right")
                at -= np.concatenate([[0], ends[:-1]]).astype(np.int64)[row]
                order = np.argsort(trigger, kind="stable")
                trigger, phrase, at, n, row = trigger[order], phrase[order], at[order], n[order], first + row[order]
                part = ((trigger >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                packed = []
                for a, b in zip(cuts, np.append(cuts[1:], len(part))):
                    used, place = np.unique(row[a:b], return_inverse=True)
                    arrays = [
                        np.diff(trigger[a:b], prepend=np.uint64(0)),
                        phrase[a:b] & np.uint64((1 << 48) - 1),
                        place.astype(np.uint32),
                        at[a:b],
                        n[a:b].astype(np.uint8),
                    ]
                    head = np.array([b - a, len(used)], np.int64).tobytes() + _planes(np.diff(ids[used], prepend=0)) + _planes(tags[used])
                    packed.append(pack(head + b"".join(map(_planes, arrays))))
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(packed, pa.binary())], ["part", "packed"])

    return docs.mapInArrow(work, "part int, packed binary")


def _unpacked(raw: bytes) -> list[np.ndarray]:
    """[trigger, phrase, n, doc_id, tag, at] of a block that ``parse`` packed."""
    rows, used = np.frombuffer(raw, np.int64, 2)
    ids = np.cumsum(_unplaned(raw[16 : 16 + 8 * used], "i8", used))
    tags = _unplaned(raw[16 + 8 * used : 16 + 16 * used], "i8", used)
    columns, start = [], 16 + 16 * used
    for dtype, width in (("u8", 8), ("i8", 8), ("u4", 4), ("i8", 8), ("u1", 1)):
        columns.append(_unplaned(raw[start : start + width * rows], dtype, rows))
        start += width * rows
    g, c, place, at, n = columns
    return [np.cumsum(g).view(np.int64), c, n.astype(np.int64), ids[place], tags[place], at]


class _Meeting:
    """Occurrences of the triggers of one range: the first of each phrase stays, others are repeats."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.rows = 0

    def add(self, columns: list[np.ndarray]) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])

    def _combined(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All rows in order, and whether each is the first of its phrase."""
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
        return columns, fresh

    def compact(self) -> list[np.ndarray]:
        """Give out the repeats so far; one row of each phrase is left."""
        columns, fresh = self._combined()
        self.parts, self.rows = [[c[fresh] for c in columns]], int(fresh.sum())
        return [c[~fresh] for c in columns]

    def firsts(self) -> list[np.ndarray]:
        """After ``compact``: the first occurrences of phrases whose trigger has several."""
        columns = self.parts[0]
        g = columns[0]
        several = np.zeros(len(g), bool)
        same = g[1:] == g[:-1]
        several[1:] |= same
        several[:-1] |= same
        return [c[several] for c in columns]


def meet(packed: DataFrame) -> DataFrame:
    """(g, doc_id, tag, at, n, whole) of the occurrences that matter, from the blocks of ``parse``.

    ``whole`` is true for occurrences of a phrase that occurred before, and false for the first
    one of each phrase whose trigger has several phrases. Blocks come range by range; at
    most ``COMBINE`` rows wait beside the distinct phrases of a range.
    """

    def rows(columns: list[np.ndarray], whole: bool) -> Iterator[pa.RecordBatch]:
        g, _, n, ids, tags, at = columns
        for a in range(0, len(g), 50_000):
            part = [x[a : a + 50_000] for x in (g, ids, tags, at, n.astype(np.int32), np.full(len(g), whole))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["g", "doc_id", "tag", "at", "n", "whole"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        meeting, now, limit = _Meeting(), None, COMBINE

        def end() -> Iterator[pa.RecordBatch]:
            if meeting.rows:
                yield from rows(meeting.compact(), True)
                yield from rows(meeting.firsts(), False)

        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now:
                    yield from end()
                    meeting, now, limit = _Meeting(), part, COMBINE
                meeting.add(_unpacked(unpack(raw.as_py())))
                if meeting.rows > limit:
                    yield from rows(meeting.compact(), True)
                    limit = meeting.rows + COMBINE
        yield from end()

    return packed.mapInArrow(work, "g long, doc_id long, tag long, at long, n int, whole boolean")


def _windows(content: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in a row, first byte of every string, phrase of every string) of phrases of ``n`` strings."""
    data, ends = _joined(content)
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return data, begin[owner] + inside, owner


def _islands(owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first offset, length) of runs of consecutive offsets."""
    fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]))
    return owner[fresh], offset[fresh], np.diff(np.append(fresh, len(owner)))


def repeated_suffixes(g: np.ndarray, content: pa.Array, n: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, starts) of the strings that an earlier string of the same trigger equals.

    Rows come in the order of documents; each is a phrase of ``n`` strings. Suffixes are ordered
    by hash, and equal neighbours compared byte by byte.
    """
    data, at, owner = _windows(content, n)
    inside = at - at[np.cumsum(n) - n][owner]
    key = Rolling(data).of(at, at + span) ^ _mixed(g.view(np.uint64))[owner]
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    first = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    again, source = order[~fresh], first[~fresh]
    view = np.lib.stride_tricks.sliding_window_view(data, span) if len(data) >= span else np.empty((0, span), np.uint8)
    for a in range(0, len(again), 100_000):
        x, y = again[a : a + 100_000], source[a : a + 100_000]
        if not (np.array_equal(view[at[x]], view[at[y]]) and np.array_equal(g[owner[x]], g[owner[y]])):
            return _repeated_exactly(g, view, at, owner, inside)
    again = np.sort(again)
    return _islands(owner[again], inside[again]) if len(again) else (np.empty(0, np.int64),) * 3


def _repeated_exactly(g: np.ndarray, view: np.ndarray, at: np.ndarray, owner: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same where two hashes collide: by the bytes themselves."""
    seen, again = set(), []
    for i, (trigger, start) in enumerate(zip(g[owner].tolist(), at.tolist())):
        text = (trigger, view[start].tobytes())
        if text in seen:
            again.append(i)
        seen.add(text)
    again = np.array(again, np.int64)
    return _islands(owner[again], inside[again]) if len(again) else (np.empty(0, np.int64),) * 3


def order_suffixes(ordered: DataFrame) -> DataFrame:
    """Repeated strings of the dictionary as ``FOUND``, from (g, doc_id, tag, at, n, content) sorted so."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result(rows: pa.Table) -> pa.RecordBatch:
            g, n = rows.column(0).to_numpy(), rows.column(4).to_numpy().astype(np.int64)
            row, first, starts = repeated_suffixes(g, rows.column(5).combine_chunks(), n)
            place = rows.column(3).to_numpy()[row] + first
            ids, tags = (rows.column(i).to_numpy()[row] for i in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags), pa.array(place), pa.array(starts.astype(np.int32))], ["doc_id", "tag", "at", "n"])

        for batch in batches:
            if not len(batch):
                continue
            g = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))[-1])
            if held and held[-1].column(0)[0].as_py() == g[0] and cut == 0:
                held.append(batch)
                continue
            if cut or held:
                split = cut if cut else 0
                yield result(pa.Table.from_batches([*held, batch.slice(0, split)]))
            held = [batch.slice(cut)]
        if held:
            yield result(pa.Table.from_batches(held))

    return ordered.mapInArrow(work, FOUND)


def _dealt_suffixes(rows: DataFrame) -> DataFrame:
    """The same as ``order_suffixes`` for triggers of very many phrases: strings meet by their hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                n = part.column(4).to_numpy().astype(np.int64)
                data, at, owner = _windows(part.column(5), n)
                raw = data.tobytes()
                keys = [xxhash.xxh3_128_digest(raw[i : i + SPAN]) for i in at.tolist()]
                place = part.column(3).to_numpy()[owner] + at - at[np.cumsum(n) - n][owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), *[part.column(i).take(pa.array(owner)) for i in (1, 2)], pa.array(place)],
                    ["key", "doc_id", "tag", "at"],
                )

    strings = rows.mapInArrow(work, "key binary, doc_id long, tag long, at long")
    least = strings.groupBy("key").agg(F.min(F.struct("doc_id", "tag", "at")).alias("least"))
    again = strings.join(least.hint("merge"), "key").filter("struct(doc_id, tag, at) > least")
    return again.select("doc_id", "tag", "at", F.lit(1).alias("n"))


def _compressed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` compressed (null as empty), to lessen what the joins move."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [pack(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "tag", "text"])

    return docs.mapInArrow(work, "doc_id long, tag long, text binary")


def _contents(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``firsts`` (g, doc_id, tag, at, n) with the bytes of each phrase, ``content``."""
    by_doc = firsts.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("g", "at", "n")).alias("list"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            values = batch.column(3).flatten()
            g, at, n = (values.field(i).to_numpy() for i in range(3))
            sizes = pc.list_value_length(batch.column(3)).to_numpy()
            content, end = [], np.cumsum(sizes)
            for i, text in enumerate(batch.column(2)):
                text = unpack(text.as_py())
                part = slice(end[i] - sizes[i], end[i])
                content += [text[a : a + k + SPAN - 1] for a, k in zip(at[part].tolist(), n[part].tolist())]
            row = pa.array(np.repeat(np.arange(len(batch)), sizes))
            arrays = [pa.array(g), batch.column(0).take(row), batch.column(1).take(row), pa.array(at), pa.array(n), pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["g", "doc_id", "tag", "at", "n", "content"])

    joined = _compressed(docs).join(by_doc.hint("merge"), ["doc_id", "tag"])
    return joined.select("doc_id", "tag", "text", "list").mapInArrow(work, "g long, doc_id long, tag long, at long, n int, content binary")


def repeats(scratch: Scratch, docs: DataFrame, deal: int = DEAL) -> DataFrame:
    """``FOUND`` rows: starts at..at+n-1 of a document hold strings that also start earlier."""
    size = one(docs.agg(F.sum(F.octet_length("text"))))[0] or 0
    ranges = int(max(4, size // RANGE_BYTES))
    parts = min(MAX_PARTITIONS, ranges)
    blocks = parse(docs, ranges).repartitionById(parts, (F.col("part") % parts).cast("int"))
    met = scratch.save(meet(blocks.sortWithinPartitions("part")))
    firsts = scratch.save(_contents(docs, met.filter("not whole").drop("whole")))
    wide = scratch.save(firsts.groupBy("g").count().filter(F.col("count") > deal).select("g"))
    usual = firsts.join(wide.hint("merge"), "g", "left_anti").select("g", "doc_id", "tag", "at", "n", "content")
    usual = order_suffixes(usual.repartition(parts, "g").sortWithinPartitions("g", "doc_id", "tag", "at"))
    dealt = _dealt_suffixes(firsts.join(wide.hint("merge"), "g", "left_semi").select("g", "doc_id", "tag", "at", "n", "content"))
    return met.filter("whole").select("doc_id", "tag", "at", "n").union(usual).union(dealt)


def kept_bytes(text: bytes, at: np.ndarray, n: np.ndarray, span: int = SPAN) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, remaining bytes) where ``n`` strings start from ``at`` on."""
    if not len(at):
        return 0, 0, text
    order = np.argsort(at, kind="stable")
    first, end = at[order], np.maximum.accumulate(at[order] + n[order] - 1 + span)
    fresh = np.concatenate([[True], first[1:] > end[:-1]])
    first, end = first[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]
    kept = b"".join([text[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(text)])])
    return int((end - first).sum()), len(first), kept


def without_repeats(scratch: Scratch, docs: DataFrame, digest: bool = False, deal: int = DEAL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row: ``kept`` is what is left of the text
    as bytes, or with ``digest`` its SHA-256 as ``kept_sha256``.

    A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a
    smaller doc_id, or earlier in its own. A null text is empty. Rows that repeat a doc_id with
    different texts are documents of their own, the lesser text hash first; rows that repeat as
    a whole are one document, with a result each. Rows without a doc_id lose nothing and are no
    source. An empty table gives no row. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    again = (one(ids.agg(F.max("n")))[0] or 0) > 1
    tag = F.coalesce(F.xxhash64("text"), F.lit(0)) if again else F.lit(0).cast("long")
    docs = docs.select("doc_id", tag.alias("tag"), "text")
    known = docs.filter("doc_id is not null")
    found = repeats(scratch, known.dropDuplicates(["doc_id", "tag"]) if again else known, deal)
    by_doc = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    joined = _compressed(docs).join(by_doc.hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "text", "found")
    name = "kept_sha256" if digest else "kept"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            values = batch.column(2).flatten()
            at, n = (values.field(i).to_numpy() for i in range(2))
            sizes = pc.list_value_length(batch.column(2)).fill_null(0).to_numpy()
            end, rows = np.cumsum(sizes), []
            for i, text in enumerate(batch.column(1)):
                part, text = slice(end[i] - sizes[i], end[i]), unpack(text.as_py())
                removed, spans, kept = kept_bytes(text, at[part], n[part])
                rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", name])

    return joined.mapInArrow(work, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {'string' if digest else 'binary'}")
