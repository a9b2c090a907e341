"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns give the base spans. Around digits and ``@`` the random field then looks at
every segment of at most ``LONGEST`` tokens: features of the whole segment (digit count,
checksums, number ranges, characters, what stands on either side) score it for each kind,
and dynamic programming picks the best set of segments and their kinds together. Elsewhere
no segment can start, and the best set outside is empty. Segments that meet a base span are
left out, as base spans always stay.

The field is fitted on a bounded sample: at most ``SAMPLE`` documents of at most
``SAMPLE_CHARS`` characters that hold a digit or ``@``, labelled with the base spans and
with values assigned to secret-like names. It is applied to every text as a whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "secret")
SAMPLE = 1_500
SAMPLE_CHARS = 20_000
LONGEST = 16
LONGEST_CHARS = 128
STEPS = 120
TEXT_SLICE = 4_000_000

Span = tuple[str, int, int]

_HOT = re.compile(r"[0-9@]")
# Patterns of the contract. Each is written so that it starts at the first place of a run
# where it could, which finds the same leftmost matches in linear time.
_MAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*@[A-Za-z0-9._%+@-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_REGION = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?:\s[^\s0-9@]*[0-9@]\S*)*")
_TOKEN = re.compile(r"[^\W_]+|[\W_]")
_SECRET = re.compile(r"(?i)\b(?:token|secret|api_?key|password|passwd)\b\s*[=:]\s*[\"']?([A-Za-z0-9]{12,})")
_SECRET_NAME = re.compile(r"(?i)(?:token|secret|key|password|passwd)\W{0,5}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octets(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isdecimal() and p.isascii() and (q := p.lstrip("0") or "0") and len(q) <= 3 and int(q) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then start; end exclusive."""
    found: list[Span] = []
    if "@" in text:
        for run in _MAIL_RUN.finditer(text):
            at_from, end = run.span()
            while (at := text.find("@", at_from, end)) >= 0:
                domain = _DOMAIN.match(text, at + 1, end) if at > at_from else None
                if domain:
                    found.append(("email", at_from, domain.end()))
                at_from = domain.end() if domain else at + 1
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in "\"'`" else 3 if c in ".@-_%+" else 4


SIDES = 5
_NAMES = 26
FEATURES = _NAMES + 2 * SIDES


def segment_features(text: str, start: int, end: int) -> tuple[int, ...]:
    """Numbers of the features that hold for the whole segment."""
    x = text[start:end]
    digits = _NOT_DIGIT.sub("", x)
    n, letters = len(digits), any(c.isalpha() for c in x)
    at = x.count("@")
    local, _, domain = x.partition("@")
    has = [
        True,
        n == len(x),
        0 < n < 8,
        8 <= n <= 15,
        16 <= n <= 19,
        n > 19,
        at == 1,
        at > 1,
        at == 1 and bool(local) and "." in domain.strip("."),
        at == 1 and "." in domain and domain.rpartition(".")[2].isalpha(),
        x.count(".") == 3,
        _octets(x),
        x[0] == "+",
        any(c in "() " for c in x),
        "-" in x,
        16 <= n <= 19 and luhn(digits),
        letters,
        letters and n > 0 and x.isalnum(),
        letters and n > 0 and x.isalnum() and len(x) >= 16,
        len(x) >= 32,
        letters and n > 0 and all(c in "0123456789abcdefABCDEF" for c in x),
        any(c.isspace() for c in x),
        any(not c.isalnum() and c not in "@.+-_() %" for c in x),
        bool(_SECRET_NAME.search(text, max(0, start - 20), start)),
        x.isalnum(),
        n == 0,
    ]
    sides = [_NAMES + _side(text[start - 1 : start]), _NAMES + SIDES + _side(text[end : end + 1])]
    return tuple([i for i, h in enumerate(has) if h] + sides)


def regions(text: str) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
    """Token boundaries of each stretch of words with a digit or ``@``, and its segments
    (from, to) as positions in the boundaries."""
    for m in _REGION.finditer(text):
        tokens = [t.span() for t in _TOKEN.finditer(text, *m.span())]
        bounds = [m.start(), *(e for _, e in tokens)]
        segments = []
        for i, (s, _) in enumerate(tokens):
            if not (text[s].isalnum() or text[s] in "+(") or text[s].isspace():
                continue
            hot = False
            for j in range(i, min(i + LONGEST, len(tokens))):
                a, b = tokens[j]
                if b - s > LONGEST_CHARS:
                    break
                hot = hot or bool(_HOT.search(text, a, b))
                if hot and text[b - 1].isalnum():
                    segments.append((i, j + 1))
        yield bounds, segments


def best_segments(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(segment, kind) of the best set of segments that don't overlap; ``n`` tokens."""
    kind = scores.argmax(axis=1) if len(segments) else []
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    by_end: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(segments):
        by_end.setdefault(j, []).append(k)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in by_end.get(j, ()):
            if (value := best[segments[k][0]] + scores[k, kind[k]]) > best[j]:
                best[j], back[j] = value, k
    chosen, j = [], n
    while j > 0:
        if back[j] >= 0:
            chosen.append((back[j], int(kind[back[j]])))
            j = segments[back[j]][0]
        else:
            j -= 1
    return chosen[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def segment_marginals(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each (segment, kind) under the field, by forward and backward sums."""
    total = np.logaddexp.reduce(scores, axis=1).tolist()
    ends: dict[int, list[int]] = {}
    begins: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(segments):
        ends.setdefault(j, []).append(k)
        begins.setdefault(i, []).append(k)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        value = forward[j - 1]
        for k in ends.get(j, ()):
            value = _log_add(value, forward[segments[k][0]] + total[k])
        forward[j] = value
    for i in range(n - 1, -1, -1):
        value = backward[i + 1]
        for k in begins.get(i, ()):
            value = _log_add(value, backward[segments[k][1]] + total[k])
        backward[i] = value
    around = np.array([forward[i] + backward[j] for i, j in segments]) - forward[n]
    return np.exp(scores + around[:, None])


def fit(texts: list[str]) -> np.ndarray | None:
    """Weights (features x kinds) by penalised maximum likelihood; None without a segment."""
    seen: dict[tuple, int] = {}
    for text in texts:
        gold = {(s, e): k for k, s, e in base_spans(text)}
        gold |= {m.span(1): "secret" for m in _SECRET.finditer(text)}
        for bounds, segments in regions(text):
            if segments:
                rows = tuple((i, j, segment_features(text, bounds[i], bounds[j])) for i, j in segments)
                labels = tuple(KINDS.index(gold[s]) if (s := (bounds[i], bounds[j])) in gold else -1 for i, j in segments)
                key = (len(bounds) - 1, rows, labels)
                seen[key] = seen.get(key, 0) + 1
    if not seen:
        return None
    problems = list(seen)
    count = np.array([seen[p] for p in problems], dtype=float)
    sizes = [len(p[1]) for p in problems]
    ends = np.cumsum(sizes)
    x = np.zeros((ends[-1], FEATURES))
    y = np.zeros((ends[-1], len(KINDS)))
    for r, (on, label) in enumerate((f, lab) for p in problems for (_, _, f), lab in zip(p[1], p[2])):
        x[r, list(on)] = 1
        if label >= 0:
            y[r, label] = 1
    weight = np.repeat(count, sizes)[:, None]
    w, m, s = (np.zeros((FEATURES, len(KINDS))) for _ in range(3))
    for step in range(1, STEPS + 1):
        scores = x @ w
        expected = np.concatenate([segment_marginals(p[0], [(i, j) for i, j, _ in p[1]], scores[e - k : e]) for p, e, k in zip(problems, ends, sizes)])
        g = x.T @ ((expected - y) * weight) / count.sum() + 1e-4 * w
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w = w - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """The field's spans that meet no base span."""
    taken = sorted((s, e) for _, s, e in base)
    added = []
    for bounds, segments in regions(text):
        if not segments:
            continue
        scores = np.stack([weights[list(segment_features(text, bounds[i], bounds[j]))].sum(axis=0) for i, j in segments])
        for k, kind in best_segments(len(bounds) - 1, segments, scores):
            added.append((KINDS[kind], bounds[segments[k][0]], bounds[segments[k][1]]))
    kept, at = [], 0
    for span in sorted(added, key=lambda p: p[1]):
        while at < len(taken) and taken[at][1] <= span[1]:
            at += 1
        # Base spans of different kinds may overlap, so the earlier ones are looked at again.
        if not any(s < span[2] and span[1] < e for s, e in taken[max(0, at - 8) : at + 8]):
            kept.append(span)
    return kept


def spans_of(text: str | None, weights: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """(base, all) spans of a text, each by kind as listed, then start."""
    if not text or not _HOT.search(text):
        return [], []
    base = base_spans(text)
    extra = added_spans(text, base, weights) if weights is not None else []
    return base, sorted(base + extra, key=lambda p: (KINDS.index(p[0]), p[1], p[2]))


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans as one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda p: (p[1], -p[2])):
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def model(docs: DataFrame) -> np.ndarray | None:
    """The field fitted on the bounded sample of ``docs``."""
    rows = docs.count()
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    hot = docs.select("text", draw.alias("draw")).filter((F.col("draw") * max(rows, 1) < 8 * SAMPLE) & (F.length("text") <= SAMPLE_CHARS)).filter(F.col("text").rlike("[0-9@]"))
    # Copies of a text have one draw, so each counts once, and reruns fit the same texts.
    drawn = hot.distinct().orderBy("draw", "text").limit(SAMPLE).collect()
    return fit([r["text"] for r in drawn])


def find(docs: DataFrame, weights: np.ndarray | None, masked: bool = False) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: arrays of (kind, start, end) in code points.

    With ``masked``, ``text`` is replaced by its masked form and ``n_chars``, where there is
    one, by its length. A null or empty text has no span and stays. Repeated rows get equal
    results, an empty table none; columns of the added names are replaced, others kept.
    """
    docs = docs.drop("pii_base", "pii_spans")
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ["pii_base", "pii_spans", "masked"]

    @F.arrow_udf(T.StructType([*map(T.StructField, names, [span, span, T.StringType()])]))
    def spanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            both, texts = ([], []), []
            for a, b in slices(pc.binary_length(batch).fill_null(0).to_pylist(), TEXT_SLICE):
                for text in batch.slice(a, b - a).to_pylist():
                    found = spans_of(text, weights)
                    for i in (0, 1):
                        both[i].append([{"kind": k, "start": s, "end": e} for k, s, e in found[i]])
                    # Null stands for a text that stays as it is.
                    texts.append(mask(text, found[1]) if masked and found[1] else None)
            yield pa.StructArray.from_arrays([*(pa.array(x, arrow) for x in both), pa.array(texts, pa.string())], names)

    # Only the text goes through Python, and only texts that change come back.
    found = docs.select("*", spanned.asNondeterministic()(F.col("text").cast("string")).alias("__found"))
    text = F.coalesce("__found.masked", "text").alias("text")
    out = found.select(*[text if masked and c == "text" else c for c in docs.columns], "__found.pii_base", "__found.pii_spans")
    if masked and "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
