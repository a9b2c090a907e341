"""Best-fit packing of tokenised documents with certified bin counts.

``pieces`` turns documents into token pieces of at most ``capacity`` tokens and ``pack``
places pieces into sequences. Pieces are dealt by hash into groups of about ``GROUP_ROWS``;
each group runs best-fit decreasing and compares its number of sequences with the largest
of several dual-feasible-function lower bounds. A group that meets its bound is certified.
Groups with a gap give up the documents of their unfilled sequences; those are dealt anew
and packed again, and the outcome is taken only if it needs fewer sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, one, slices

CAPACITY = 2048
GROUP_ROWS = 50_000
EXCHANGES = 3
# Entries kept per worker; a full table is emptied, so memory is bounded and results are equal.
CACHE_WORDS = 250_000
TEXT_SLICE = 2_000_000

# Words of these characters are in normal form C, and one regular expression splits them as
# the tokenizer's own does; any other word goes through the tokenizer as it stands.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# Fixed value: the split of the vocabulary file, for the characters above.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = 3
_KINDS[0x30:0x3A] = 2
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KINDS[0x27] = 0  # an apostrophe may begin a unit of letters
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x0A]] = True
# Second bytes of the letters above, after 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


class WordTokens:
    """Token ids of texts by way of their words: a lookup for known words, batches for new ones.

    The tokenizer never joins characters across white space, so the ids of a text are those
    of its words in a row. The ids are little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        # What a byte is: 1 letter, 2 digit, 3 mark; 0 where its word is looked at as a whole.
        self.kinds = _KINDS.copy()
        self.kinds[[t.content.encode()[0] for t in self.special if t.content]] = 0

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_units(self, new: list[str]) -> None:
        """Ids of units (letters, digit or marks): many joined by spaces, cut where a unit ends."""
        joined = [" ".join(new[i : i + 500]) for i in range(0, len(new), 500)]
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(new):
            raise AssertionError("a unit did not end in one token")
        raw = ids.tobytes()
        self.units.update(zip(new, (raw[a:b] for a, b in zip([0, *cuts], cuts))))

    def _learn_words(self, new: list[str]) -> None:
        """Ids of words that bytes alone don't split: those with an apostrophe, other characters or a special token."""
        specials = [t.content for t in self.special]
        split = {}
        for word in new:
            if _PLAIN.fullmatch(word) and not any(s in word for s in specials):
                split[word] = _SPLIT.findall(word.lower())
            else:
                self.words[word] = self._ids(word)
        if unseen := list({u for units in split.values() for u in units} - self.units.keys()):
            self._learn_units(unseen)
        for word, parts in split.items():
            self.words[word] = b"".join([self.units[u] for u in parts])

    def _found(self, distinct: list[str], whole: np.ndarray) -> list[bytes]:
        """Ids of distinct units, or of words where ``whole``; no unit is spelt like such a word."""
        if len(self.words) + len(self.units) > CACHE_WORDS:
            self.words, self.units = {}, {}
        known = list(map(self.units.get, distinct))
        unseen = [i for i, h in enumerate(known) if h is None]
        if new := [distinct[i] for i in unseen if not whole[i]]:
            self._learn_units(new)
        if new := [distinct[i] for i in unseen if whole[i] and distinct[i] not in self.words]:
            self._learn_words(new)
        for i in unseen:
            known[i] = (self.words if whole[i] else self.units)[distinct[i]]
        return known

    def forget(self) -> None:
        self.words, self.units = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text. Texts are lower-cased and cut into units in bulk; only distinct units are looked up."""
        raw = [t.encode() + b" " for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        inside = ~_SEPARATOR[data]
        kind, low = self.kinds[data], _LOWER[data]
        pair = np.flatnonzero(data[:-1] == 0xC3)
        pair = pair[_LATIN[data[pair + 1]]]
        kind[pair], kind[pair + 1] = 1, 1
        low[pair + 1] = np.where(data[pair + 1] < 0x9F, data[pair + 1] + 0x20, data[pair + 1])
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        if not len(starts):
            return [b""] * len(texts)
        odd = np.zeros(len(starts), bool)
        odd[np.searchsorted(starts, np.flatnonzero((kind == 0) & inside), side="right") - 1] = True
        whole = np.repeat(odd, sizes)
        kind, text = kind[inside], low[inside]
        text[whole] = data[inside][whole]
        cut = np.zeros(len(kind), bool)
        cut[1:] = ~whole[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        begin = np.cumsum(sizes) - sizes
        cut[begin] = True
        at = np.flatnonzero(cut)
        offsets = np.append(at, len(text)).astype(np.int32)
        units = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()
        code = units.indices.to_numpy()
        is_whole = np.zeros(len(units.dictionary), bool)
        is_whole[code] = whole[at]
        held = self._found(units.dictionary.to_pylist(), is_whole)
        counts = np.fromiter(map(len, held), np.int64, len(held)) // 4
        first, n = np.cumsum(counts) - counts, counts[code]
        before = np.cumsum(n) - n
        ids = np.frombuffer(b"".join(held), "<u4")[np.repeat(first[code] - before, n) + np.arange(n.sum())]
        # Words, then units, up to the end of each text.
        words = np.searchsorted(starts, np.cumsum([len(r) for r in raw]))
        limits = np.searchsorted(at, np.append(begin, len(text))[words])
        cuts = np.concatenate([[0], np.append(before, n.sum())[limits]])
        return [ids[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, crc: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document: its token ids, then ``end``.

    ``ids`` are little-endian unsigned 32-bit integers; with ``crc`` their checksum
    ``ids_crc32`` (long) stands in their place. Only documents of more than ``capacity``
    tokens are cut. A null text is an empty one (one piece that holds ``end``). Each input
    row gives its own pieces, also if rows repeat or doc_id is null; other columns are not
    read, and an empty table gives none.
    """
    last = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in slices(sizes, TEXT_SLICE):
                part = batch.slice(a, b - a)
                ids = [x + last for x in tokens.encode([t or "" for t in part.column(1).to_pylist()])]
                owner, number, held = [], [], []
                for i, raw in enumerate(ids):
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        owner.append(i)
                        number.append(k)
                        held.append(raw[at : at + 4 * capacity])
                number = np.array(number, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner, pa.int64())),
                        pa.array(number),
                        pa.array(number.astype(np.int64) * capacity),
                        pa.array([len(x) // 4 for x in held], pa.int64()),
                        pa.array([zlib.crc32(x) for x in held], pa.int64()) if crc else pa.array(held, pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32" if crc else "ids"],
                )
        tokens.forget()  # workers live on after the task

    schema = "doc_id long, piece int, start long, length long, " + ("ids_crc32 long" if crc else "ids binary")
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, schema)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that pieces need at least. ``counts[x]`` pieces have length x.

    The maximum over dual feasible functions: the identity, rounding down to multiples of
    1/k, and the two families with a threshold (small pieces vanish and large ones fill a
    sequence; or pieces are counted in whole thresholds).
    """
    lengths = np.flatnonzero(counts)
    many = counts[lengths].astype(np.int64)
    if not len(lengths):
        return 0
    best = -(-int((lengths * many).sum()) // capacity)
    for k in range(1, 51):  # u_k(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k
        scaled = lengths * (k + 1)
        whole = scaled % capacity == 0
        total = (np.where(whole, lengths * k, (scaled // capacity) * capacity) * many).sum()
        best = max(best, -(-int(total) // (k * capacity)))
    for e in range(1, capacity // 2 + 1):
        small, large = lengths < e, lengths > capacity - e
        total = (np.where(large, capacity, np.where(small, 0, lengths)) * many).sum()
        best = max(best, -(-int(total) // capacity))
        units = capacity // e
        over = 2 * lengths > capacity
        counted = np.where(over, 2 * (units - (capacity - lengths) // e), np.where(2 * lengths == capacity, units, 2 * (lengths // e)))
        best = max(best, -(-int((counted * many).sum()) // (2 * units)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each piece, and each bin's filled length."""
    if lengths.max(initial=0) > capacity:
        raise ValueError(f"a piece is longer than {capacity}")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r is set if a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = chosen, fill[chosen]
        fill[chosen] += size
        if size < room:
            open_bins[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fill, dtype=np.int64)


def _packed(rows: DataFrame, columns: list[str], salt: int, capacity: int) -> DataFrame:
    """One round: rows dealt by hash into groups, each packed and held against its bound."""
    groups = max(1, round(rows.count() / GROUP_ROWS))
    dealt = rows.select(*columns, F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(groups)).alias("__group"))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(columns, kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy(dtype=np.int64)
        bins, offsets, fill = best_fit(lengths, capacity)
        gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return frame.assign(sequence_id=(salt << 56) + frame["__group"].to_numpy(dtype=np.int64) * (1 << 28) + bins, offset=offsets, filled=fill[bins], gap=gap)[
            [*columns, "sequence_id", "offset", "filled", "gap"]
        ]

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", sequence_id long, offset long, filled long, gap long"
    return dealt.groupBy("__group").applyInPandas(place, schema)


def pack(scratch: Scratch, rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with ``length``, 1 to ``capacity``; carried columns of simple types) with the
    ``sequence_id`` and ``offset`` of each. Equal rows are placed separately; no row, no result."""
    columns = rows.columns
    done = scratch.save(_packed(rows, columns, 0, capacity))
    for salt in range(1, EXCHANGES + 1):
        loose = F.expr(f"gap > 0 and filled < {capacity}")
        given = done.filter(loose)
        before = one(given.agg(F.countDistinct("sequence_id")))[0]
        if before == 0:
            break
        again = scratch.save(_packed(given, columns, salt, capacity))
        if one(again.agg(F.countDistinct("sequence_id")))[0] >= before:
            break
        done = scratch.save(done.filter(~loose).withColumn("gap", F.lit(0).cast("long")).union(again))
    return done.drop("filled", "gap")
