"""Language identification by a linear-chain conditional random field over words.

Each word has a score per language from hashed features (character bigrams and trigrams,
affixes, and the word itself as a lexicon entry); learned transitions connect neighbouring
words, so a text may switch languages. Forward-backward over the whole text gives each
word's distribution, and a document's language is the one with the largest mean.

The model is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` documents a
language (of the ``LANGUAGES`` most frequent ones) of at most ``SAMPLE_CHARS`` characters,
the first by a keyed hash, from which
``SEQUENCES`` training sequences are put together, half of them switching between
languages. It is applied to every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import slices

SAMPLE = 200
SAMPLE_CHARS = 20_000
LANGUAGES = 200
SEQUENCES = 1_600
STEPS = 60
BITS = 15
UNKNOWN = "und"
TEXT_SLICE = 1_500_000
CACHE_WORDS = 250_000

_RUN = re.compile(r"[^\W\d_]+")
_START, _END = 2, 3  # code points that no word has
_MULTIPLIER = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters (and of number signs beside a letter); none without a letter."""
    found = _RUN.findall((text or "").lower())
    return [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def _slot(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(31))
    return ((value * _MULTIPLIER[0]) >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, slot, weight) of every feature of the words.

    n-grams (with the word's ends) share a weight of 4 so that long words don't outweigh
    others; the affixes of three letters and the word itself weigh 1 each.
    """
    sizes = np.array([len(w) for w in words]) + 2
    starts = np.cumsum(sizes) - sizes
    text = np.full(sizes.sum(), _START, np.uint64)
    inner = np.ones(len(text), bool)
    inner[starts] = False
    inner[starts + sizes - 1] = False
    text[inner] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    text[starts + sizes - 1] = _END
    owner = np.repeat(np.arange(len(words)), sizes)
    end = np.repeat(starts + sizes, sizes)
    at = np.arange(len(text))
    mixed = (text + np.uint64(1)) * _MULTIPLIER[1]
    gram, parts = mixed, []
    for n in (2, 3, 4):
        gram = gram[: len(text) - n + 1] * _MULTIPLIER[2] + mixed[n - 1 :]
        fits = at[: len(gram)] + n <= end[: len(gram)]
        if n == 4:  # affixes only
            fits &= ~inner[: len(gram)] | ~inner[n - 1 :]
        i = np.flatnonzero(fits)
        weight = np.ones(len(i)) if n == 4 else 2.0 / (sizes[owner[i]] - n + 1)
        parts.append((owner[i], _slot(gram[i] + np.uint64(n)), weight))
    power = np.cumprod(np.full(int(sizes.max()), _MULTIPLIER[3], np.uint64))
    whole = np.add.reduceat(mixed * power[at - starts[owner]], starts)
    parts.append((np.arange(len(words)), _slot(whole), np.ones(len(words))))
    return tuple(np.concatenate(x) for x in zip(*parts))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages
    start: np.ndarray  # log
    moves: np.ndarray  # log, from x to

    def scores(self, words: list[str]) -> np.ndarray:
        owner, slot, weight = features(words)
        order = np.argsort(owner, kind="stable")
        rows = self.weights[slot[order]] * weight[order, None]
        return np.add.reduceat(rows, np.searchsorted(owner[order], np.arange(len(words))), axis=0)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word its distribution, and the summed pair distribution of neighbours.

    ``scores`` holds the words of all texts one text after the other; ``sizes`` are at least
    1. All texts advance one word a step, the longest first, each step scaled to sum to 1.
    """
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    longest = sizes[order]
    active = np.searchsorted(-longest, -np.arange(1, longest[0] + 1), side="right")  # texts of at least t + 1 words
    phi = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves)
    alpha = np.empty_like(phi)
    a = np.exp(start) * phi[first]
    a /= a.sum(axis=1, keepdims=True)
    alpha[first] = a
    for t in range(1, longest[0]):
        k = active[t]
        at = first[:k] + t
        a = (a[:k] @ step) * phi[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    pair = np.zeros_like(step)
    b = np.ones((len(sizes), phi.shape[1]))
    for t in range(longest[0] - 2, -1, -1):
        k = active[t + 1]
        ahead = phi[first[:k] + t + 1] * b[:k]
        here = first[:k] + t
        back = ahead @ step.T
        mass = (alpha[here] * back).sum(axis=1, keepdims=True)
        pair += (alpha[here] / mass).T @ ahead
        b[:k] = back / back.sum(axis=1, keepdims=True)
        alpha[here] *= b[:k]
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha, pair * step


def fit(labelled: list[tuple[str, str]], seed: int = 0) -> Model | None:
    """A model from (language, text) rows; None if no row has a word."""
    random = np.random.default_rng(seed)
    texts: dict[str, list[list[str]]] = {}
    for language, text in labelled:
        if words := words_of(text):
            texts.setdefault(language, []).append(words)
    if not texts:
        return None
    languages = sorted(texts)
    tokens, labels, sizes = [], [], []
    for i in range(SEQUENCES):
        size = 0
        chosen = random.integers(len(languages), size=1 if i % 2 else int(random.integers(2, 5)))
        for label in [i // 2 % len(languages)] if i % 2 else chosen.tolist():
            source = texts[languages[label]]
            words = source[int(random.integers(len(source)))]
            length = int(random.integers(5, 41))
            begin = int(random.integers(max(1, len(words) - length + 1)))
            part = words[begin : begin + length]
            tokens += part
            labels += [label] * len(part)
            size += len(part)
        sizes.append(size)
    vocabulary, of = np.unique(np.array(tokens, dtype=object).astype(str), return_inverse=True)
    labels, sizes = np.array(labels), np.array(sizes)
    owner, slot, weight = features(vocabulary.tolist())
    n, count = len(languages), len(vocabulary)
    firsts = np.cumsum(sizes) - sizes
    inside = np.ones(len(labels), bool)
    inside[firsts] = False
    seen_pairs = np.zeros((n, n))
    np.add.at(seen_pairs, (labels[np.flatnonzero(inside) - 1], labels[inside]), 1)
    seen_start = np.bincount(labels[firsts], minlength=n)
    # Adam on the penalised mean log-likelihood, over all sequences at each step.
    values = [np.zeros((1 << BITS, n)), np.zeros(n), np.zeros((n, n))]
    first, second = ([np.zeros_like(v) for v in values] for _ in range(2))
    for step in range(1, STEPS + 1):
        rows = values[0][slot] * weight[:, None]
        scores = np.stack([np.bincount(owner, rows[:, j], count) for j in range(n)], axis=1)
        marginal, pairs = forward_backward(scores[of], sizes, values[1], values[2])
        starts = marginal[firsts].sum(axis=0)
        marginal[np.arange(len(labels)), labels] -= 1
        by_word = np.stack([np.bincount(of, marginal[:, j], count) for j in range(n)], axis=1)[owner] * weight[:, None]
        gradient = [np.stack([np.bincount(slot, by_word[:, j], 1 << BITS) for j in range(n)], axis=1), starts - seen_start, pairs - seen_pairs]
        for v, g, m, s in zip(values, gradient, first, second):
            g = g / len(sizes) + 1e-4 * v
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(languages, values[0].astype(np.float32), values[1], values[2])


def held_out(doc_id: Column) -> Column:
    """Rows kept from the fit: those whose crc32(doc_id as text) is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample: (language, text) of at most ``SAMPLE`` documents of each of the
    ``LANGUAGES`` most frequent languages."""
    usable = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= SAMPLE_CHARS))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    # Twice as many as needed are drawn by a keyed hash, then the first of these by language.
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, 2.0 * SAMPLE / n)])
    draw = F.xxhash64(F.lit(7), "doc_id")
    drawn = usable.filter(F.pmod(draw, F.lit(1 << 30)) / float(1 << 30) < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    firsts = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    rows = drawn.withColumn("h", draw).withColumn("row", F.row_number().over(firsts)).filter(F.col("row") <= SAMPLE)
    return sorted((r["lang"], r["text"]) for r in rows.select("lang", "text").collect())


class _Labeller:
    """A model with the scores of words seen so far; emptied when full, with equal results."""

    def __init__(self, model: Model):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((1 << 14, len(self.model.languages)), np.float32)

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: none), its mean probability, words and switches of each text."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        switches = np.zeros(len(texts), np.int64)
        split = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in split])
        held = np.flatnonzero(sizes)
        if len(held):
            flat = [w for words in split for w in words]
            if len(self.index) > CACHE_WORDS:
                self._empty()
            if new := list(set(flat) - self.index.keys()):
                n = len(self.index)
                if n + len(new) > len(self.table):
                    self.table = np.resize(self.table, (2 * (n + len(new)), self.table.shape[1]))
                self.table[n : n + len(new)] = self.model.scores(new)
                self.index.update(zip(new, range(n, n + len(new))))
            rows = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
            marginal, _ = forward_backward(self.table[rows].astype(np.float64), sizes[held], self.model.start, self.model.moves)
            starts = np.cumsum(sizes[held]) - sizes[held]
            mean = np.add.reduceat(marginal, starts, axis=0) / sizes[held, None]
            best[held] = mean.argmax(axis=1)
            score[held] = np.clip(mean.max(axis=1), 0.0, 1.0)
            top = marginal.argmax(axis=1)
            changed = np.append(0, top[1:] != top[:-1])
            changed[starts] = 0
            switches[held] = np.add.reduceat(changed, starts)
        return best, score, sizes, switches


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_words and lang_switches.

    Texts that are null or have no letter get ``und`` with score 0, as does every text when
    no labelled row could be learned from. Repeated rows get equal results, an empty table
    none; columns of these names are replaced, all others kept.
    """
    added = ["lang_pred", "lang_score", "lang_words", "lang_switches"]
    docs = docs.drop(*added)
    model = model or fit(training_rows(docs))
    languages = model.languages if model else []

    @F.arrow_udf(T.StructType([*map(T.StructField, added, [T.StringType(), T.DoubleType(), T.LongType(), T.LongType()])]))
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = _Labeller(model) if model else None
        for batch in batches:
            parts = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))]
            for a, b in slices(pc.binary_length(batch).fill_null(0).to_pylist(), TEXT_SLICE):
                nothing = np.full(b - a, -1), np.zeros(b - a), np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                parts.append(labeller.label(batch.slice(a, b - a).to_pylist()) if labeller else nothing)
            best, score, sizes, switches = (np.concatenate(c) for c in zip(*parts))
            names = [languages[i] if i >= 0 else UNKNOWN for i in best]
            arrays = [pa.array(names, pa.string()), pa.array(score), pa.array(sizes.astype(np.int64)), pa.array(switches)]
            yield pa.StructArray.from_arrays(arrays, added)

    # Only the text goes through Python; the rest of the row stays where it is. As a deterministic
    # function it would be computed once more for a filter on its result.
    found = docs.select("*", labelled.asNondeterministic()(F.col("text").cast("string")).alias("__found"))
    return found.select(*docs.columns, *[F.col(f"__found.{c}").alias(c) for c in added])
