"""Phrase collocations from sorted streams of counts.

A window is a word and up to three words after it in its piece of text; every word starts one,
so the count of a phrase is the sum over the windows that begin with it. Windows are counted in
tasks, dealt in blocks by ranges of their order and read there in that order by ``_counted``: one
pass gives the counts of all phrases of one to ``WORDS`` words with four sums in memory, and
only phrases that straddle a range leave it as parts. The frequent ones are laid out in two
orders, by their words and by their words from the last to the first. A pass over the first
knows the counts of all beginnings of a phrase (they are its ancestors, which come before it)
and its most frequent extension to the right; a pass over the second those of its endings and
to the left. Both streams then meet by a merge join. No table of phrases is ever hashed as a
whole, and no task holds more than a batch and one line of ancestors.

Ranges are cut by a bounded sample of the windows, so only their sizes depend on it. Words are
kept with one space behind them, so no word begins another and the order of joined words is
the order of word sequences.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, one, slices

WORDS = 4
MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
# A phrase goes if a longer one that holds it has this share of its count, in hundredths.
ABSORBED = 80
UNKNOWN = "und"

TEXT_SLICE = 2 << 20
RANGE_BYTES = 4 << 20
MAX_RANGES = 8192
# The sample that cuts ranges: documents, and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 4000

_BREAK, _BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)] = 1
_KIND[list(_BREAK)] = 2
_SPACE = 32


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of consecutive values that end at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(values: pa.Array) -> np.ndarray:
    """The bytes of a binary array without nulls, in a row."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(values) else np.empty(0, np.uint8)


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words (lower-cased, a space behind each) of the texts, and the number of each one's piece."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(np.concatenate([[0], inside.view(np.int8)]))
    starts = np.flatnonzero(edge == 1)
    keep = inside.copy()
    keep[np.flatnonzero(edge == -1)] = True  # the separator behind each word
    flat = np.where(inside, data, np.uint8(_SPACE))[keep]
    ends = np.flatnonzero(flat == _SPACE) + 1
    return _binary(flat, ends), np.cumsum(kind == 2)[starts]


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in order, and for each word its place among them, from 1."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)


def windows(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, ids, counts): the distinct windows in order, ids (0: none) into the ordered words."""
    words, piece = words_of(texts)
    distinct, ids = _ranked(words)
    n = len(ids)
    wide = np.zeros((WORDS, n + WORDS), np.uint64)
    for k in range(min(WORDS, n)):
        wide[k, : n - k] = np.where(piece[k:] == piece[: n - k], ids[k:], 0)
    high, first = np.unique((wide[0, :n] << np.uint64(32)) | wide[1, :n], return_inverse=True)
    low, second = np.unique((wide[2, :n] << np.uint64(32)) | wide[3, :n], return_inverse=True)
    pairs, counts = np.unique((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), return_counts=True)
    a, b = high[(pairs >> np.uint64(32)).astype(np.int64)], low[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    mask = np.uint64(0xFFFFFFFF)
    return distinct, np.stack([a >> np.uint64(32), a & mask, b >> np.uint64(32), b & mask], axis=1).astype(np.int64), counts


def _keys(distinct: pa.Array, ids: np.ndarray) -> pa.Array:
    """Windows as their words, each with a space behind it."""
    used = ids[ids > 0]
    sizes = pc.binary_length(distinct).to_numpy().astype(np.int64)[used - 1]
    ends = np.cumsum(sizes)[np.cumsum((ids > 0).sum(axis=1)) - 1]
    return _binary(_bytes(distinct.take(pa.array(used - 1))), ends)


def _blocks(docs: DataFrame, cuts: list[tuple[str, bytes]]) -> DataFrame:
    """(part, lang, block): the windows of ``docs`` (lang, text) counted by task, by range.

    A block is the lines of one range in order: a window (each word with a space behind it) and
    its count. No word holds a line end.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), TEXT_SLICE):
                langs, texts = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                parts, names, blocks = [], [], []
                for lang in sorted(set(langs)):
                    distinct, ids, counts = windows([t.encode() for x, t in zip(langs, texts) if x == lang and t])
                    keys = _keys(distinct, ids).to_pylist()
                    inside = [key for name, key in cuts if name == lang]
                    places = [0, *[bisect_left(keys, cut) for cut in inside], len(keys)]
                    lines = [b"%b%d" % line for line in zip(keys, counts.tolist())]
                    before = sum(name < lang for name, _ in cuts)
                    for k, (x, y) in enumerate(zip(places, places[1:])):
                        if x < y:
                            parts.append(before + k)
                            names.append(lang)
                            blocks.append(b"\n".join(lines[x:y]))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(names, pa.string()), pa.array(blocks, pa.binary()).cast(pa.string())], ["part", "lang", "block"])

    return docs.mapInArrow(work, "part int, lang string, block string")


def _lines(blocks: DataFrame) -> DataFrame:
    """(lang, key, n): the windows of blocks."""
    line = F.explode(F.split("block", "\n")).alias("line")
    count = F.substring_index("line", " ", -1)
    rows = blocks.select("lang", line)
    return rows.select("lang", F.expr("left(line, length(line) - length(substring_index(line, ' ', -1)))").cast("binary").alias("key"), count.cast("long").alias("n"))


def _matrix(keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all keys, and per key and column the place of its word among them (-1: none)."""
    data = _bytes(keys)
    ends = np.flatnonzero(data == _SPACE) + 1
    key_ends = np.cumsum(pc.binary_length(keys).to_numpy().astype(np.int64))
    last = np.searchsorted(ends, key_ends, side="left") + 1
    first = np.concatenate([[0], last[:-1]])
    place = first[:, None] + np.arange(WORDS)
    return _binary(data, ends), np.where(place < last[:, None], place, -1)


class _Sums:
    """Counts of the phrases that the windows read so far begin with and that may go on."""

    def __init__(self, least: int):
        self.least = least
        self.lang: str | None = None
        self.open: list[tuple[bytes, int, bool]] = []  # phrase, sum, began before this range
        self.total = 0
        self.out: list[tuple] = []

    def _give(self, lang: str, phrases: pa.Array, size: int, sums: np.ndarray) -> None:
        self.out.append((lang, phrases, size, sums))

    def read(self, lang: str, keys: pa.Array, n: np.ndarray) -> None:
        if lang != self.lang:
            self.end()
            self.lang, fresh_task = lang, True
        else:
            fresh_task = False
        self.total += int(n.sum())
        words, place = _matrix(keys)
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        codes = np.where(place >= 0, codes[place], -1)
        same = np.ones(len(keys), bool)
        same[0] = False
        data = _bytes(keys)
        key_ends = np.cumsum(pc.binary_length(keys).to_numpy().astype(np.int64))
        word_ends = np.flatnonzero(data == _SPACE) + 1
        still_open = []
        for k in range(WORDS):
            same[1:] &= codes[1:, k] == codes[:-1, k]
            rows = np.flatnonzero(place[:, k] >= 0)
            fresh = np.flatnonzero(~same & (place[:, k] >= 0))
            if not len(rows):
                if k < len(self.open):
                    self._close(k)
                continue
            # A group is a run of rows with the same first k + 1 words; rows without that many are in none.
            head = np.searchsorted(rows, fresh)
            sums = np.add.reduceat(n[rows], head)
            begin = key_ends[fresh] - pc.binary_length(keys).to_numpy()[fresh]
            end = word_ends[place[fresh, k]]
            early = fresh_task
            if k < len(self.open):
                phrase, total, edge = self.open[k]
                if data[begin[0] : end[0]].tobytes() == phrase:
                    sums[0] += total
                    early = edge
                else:
                    self._close(k)
            last_open = True
            still_open.append((data[begin[-1] : end[-1]].tobytes(), int(sums[-1]), early if len(fresh) == 1 else False))
            inner = np.arange(len(fresh) - last_open)
            inner = inner[(sums[inner] >= self.least) | ((inner == 0) & early)]
            if len(inner):
                sizes = end[inner] - begin[inner]
                offsets = np.repeat(begin[inner] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                self._give(lang, _binary(data[offsets], np.cumsum(sizes)), k + 1, sums[inner])
        self.open = still_open

    def _close(self, k: int) -> None:
        phrase, total, edge = self.open[k]
        if total >= self.least or edge:
            self._give(self.lang, pa.array([phrase], pa.binary()), k + 1, np.array([total]))

    def end(self) -> None:
        """The range or the language ends: what is open goes out as it is."""
        for k, (phrase, total, _) in enumerate(self.open):
            self._give(self.lang, pa.array([phrase], pa.binary()), k + 1, np.array([total]))
        if self.total:
            self._give(self.lang, pa.array([b""], pa.binary()), 0, np.array([self.total]))
        self.open, self.total = [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lang, phrases, size, sums in self.out:
            rows = pa.array(np.zeros(len(phrases), np.int8))
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(rows), phrases, pa.array([size], pa.int32()).take(rows), pa.array(sums.astype(np.int64))], ["lang", "key", "size", "n"])
        self.out = []


def _counted(ordered: DataFrame, least: int) -> DataFrame:
    """(lang, key, size, n): phrases of at least ``least``, and parts of those at the ends of a task.

    A phrase of size 0 stands for all words.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(least)
        for batch in batches:
            langs = batch.column(0)
            coded = langs.dictionary_encode()
            codes = coded.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)] if len(batch) else [0]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                sums.read(part.column(0)[0].as_py(), part.column(1), part.column(2).to_numpy())
                yield from sums.batches()
        sums.end()
        yield from sums.batches()

    return ordered.mapInArrow(work, "lang string, key binary, size int, n long")


def range_cuts(docs: DataFrame, rows: int, ranges: int) -> list[tuple[str, bytes]]:
    """(lang, window): ``ranges`` - 1 cuts at most, from a sample of bounded size."""
    if ranges < 2:
        return []
    # Four times as many as needed are drawn by a hash, then the first of these.
    draw = F.pmod(F.xxhash64(F.substring("text", 1, 200), "lang"), F.lit(1 << 30)).alias("draw")
    drawn = docs.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), draw).filter(F.col("draw") * max(rows, 1) < (SAMPLE_DOCS << 32))
    sample = drawn.filter("text is not null").orderBy("draw", "lang", "text").limit(SAMPLE_DOCS).collect()
    seen = []
    for lang in sorted({r["lang"] for r in sample}):
        distinct, ids, counts = windows([r["text"].encode() for r in sample if r["lang"] == lang])
        seen += [(lang, key, c) for key, c in zip(_keys(distinct, ids).to_pylist(), counts.tolist())]
    if not seen:
        return []
    total = np.cumsum([c for _, _, c in seen])
    picked = np.unique(np.searchsorted(total, np.arange(1, ranges) * total[-1] / ranges))
    return [seen[i][:2] for i in picked.tolist()]


def phrase_counts(scratch: Scratch, docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(lang, key, size, n) of all phrases with ``least`` occurrences, and of all words as size 0."""
    rows, size = one(docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))))
    cuts = range_cuts(docs, rows, int(min(MAX_RANGES, max(4, size // RANGE_BYTES))))
    parts = len(cuts) + 1
    dealt = _lines(_blocks(docs, cuts).repartitionById(parts, F.col("part"))).sortWithinPartitions("lang", "key")
    counted = scratch.save(_counted(dealt, least))
    whole = counted.groupBy("lang", "key", "size").agg(F.sum("n").alias("n"))
    return scratch.save(whole.filter(f"size = 0 or n >= {least}"))


def _lockstep(ordered: DataFrame, ancestors: dict[tuple[str, bytes], int]) -> DataFrame:
    """(lang, key, n, parts, extension, late) in one order of the phrases.

    ``parts`` are the counts of the phrase's first one, two .. words in this order, and
    ``extension`` the most frequent phrase of one more word. A row that is ``late`` has an
    extension found in a later range than the phrase itself.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line: list[list] = []  # key, count (None: of an earlier range), most frequent extension
        lang = None
        rows: list[tuple] = []

        def leave(depth: int) -> None:
            while len(line) > depth:
                key, n, best, own = line.pop()
                if own or best:
                    rows.append((lang, key, n, [c[1] for c in line], best, not own))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "key", "n", "parts", "extension", "late"])

        for batch in batches:
            for name, key, n in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if name != lang:
                    leave(0)
                    lang = name
                depth = 0
                while depth < len(line) and key.startswith(line[depth][0]):
                    depth += 1
                leave(depth)
                words = key[:-1].split(b" ")
                while len(line) < len(words) - 1:  # only at the head of a range
                    above = b" ".join(words[: len(line) + 1]) + b" "
                    line.append([above, ancestors[lang, above], 0, False])
                if line:
                    line[-1][2] = max(line[-1][2], n)
                line.append([key, n, 0, True])
            yield flush()
        leave(0)
        yield flush()

    return ordered.mapInArrow(work, "lang string, key binary, n long, parts array<long>, extension long, late boolean")


def _in_order(scratch: Scratch, counts: DataFrame, backwards: bool) -> DataFrame:
    """(lang, key, n, parts, extension) of all phrases, by their words or by these from last to first."""
    key = F.col("key")
    if backwards:
        key = F.expr("cast(concat(array_join(reverse(split(substring(cast(key as string), 1, length(cast(key as string)) - 1), ' ')), ' '), ' ') as binary)")
    laid = counts.select("lang", key.alias("key"), "n").repartitionByRange("lang", "key").withColumn("range", F.spark_partition_id())
    laid = scratch.save(laid)
    heads = laid.groupBy("range").agg(F.min(F.struct("lang", "key")).alias("head")).select("head.*").collect()
    wanted = {(r["lang"], b" ".join(bytes(r["key"])[:-1].split(b" ")[:k]) + b" ") for r in heads for k in range(1, len(bytes(r["key"])[:-1].split(b" ")))}
    ancestors: dict[tuple[str, bytes], int] = {}
    if wanted:
        small = counts.sparkSession.createDataFrame([(lang, bytearray(k)) for lang, k in wanted], "lang string, key binary")
        ancestors = {(r["lang"], bytes(r["key"])): r["n"] for r in laid.join(F.broadcast(small), ["lang", "key"]).select("lang", "key", "n").collect()}
    ordered = laid.repartition("range").sortWithinPartitions("range", "lang", "key").select("lang", "key", "n")
    rows = scratch.save(_lockstep(ordered, ancestors))
    # At most one line of ancestors per range.
    late = rows.filter("late").groupBy("lang", "key").agg(F.max("extension").alias("more"))
    joined = rows.filter("not late").join(F.broadcast(late), ["lang", "key"], "left")
    return joined.select("lang", "key", "n", "parts", F.greatest("extension", F.coalesce("more", F.lit(0))).alias("extension"))


def collocations(scratch: Scratch, docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    Words are split at space and tab, pieces at ``.,;:!?`` and line ends, A-Z lower-cased. A
    phrase has 2 to ``WORDS`` words and occurs ``a`` >= ``least`` times within pieces. Its cut
    with the lowest score floor(SCALE * a / (l + r)) counts, where l and r are the counts of both
    sides (ties to the first cut); n is the number of words of the language. A phrase goes if a
    longer one that holds it has ``ABSORBED`` per cent of its count. Ranks go by score, count and
    then the bytes of the phrase. A null lang is ``und``, a null text has no words; repeated rows
    count each; an empty table, or one without frequent phrases, gives no row. Other columns are
    not read.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string"))
    counts = phrase_counts(scratch, docs, least)
    phrases = counts.filter("size > 0")
    left = _in_order(scratch, phrases, False)
    right = _in_order(scratch, phrases, True)
    back = F.expr("cast(concat(array_join(reverse(split(substring(cast(key as string), 1, length(cast(key as string)) - 1), ' ')), ' '), ' ') as binary)")
    right = right.select("lang", back.alias("key"), F.col("parts").alias("endings"), F.col("extension").alias("before"))
    met = left.hint("merge").join(right.hint("merge"), ["lang", "key"]).filter("size(parts) > 0")
    met = met.filter(f"100 * cast(greatest(extension, before) as decimal(20, 0)) < {ABSORBED} * cast(n as decimal(20, 0))")
    cut = "struct(cast(cast({s} as decimal(38, 0)) * n div (parts[k] + endings[size(parts) - 1 - k]) as long) as score, k as k, parts[k] as l, endings[size(parts) - 1 - k] as r)"
    scored = met.select("lang", "key", F.col("n").alias("a"), F.expr(f"array_min(transform(sequence(0, size(parts) - 1), k -> {cut.format(s=SCALE)}))").alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.col("key"))
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    words = counts.filter("size = 0").select("lang", F.col("n").alias("words"))
    out = ranked.join(words, "lang")  # a row per language
    phrase = F.expr("substring(cast(key as string), 1, length(cast(key as string)) - 1)")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), phrase.alias("phrase"), "a", "cut.l", "cut.r", F.col("words").alias("n"), "cut.score")
