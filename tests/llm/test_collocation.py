"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from tests.llm.helpers import AWKWARD, documents
from tracewell.llm import collocation
from tracewell.llm.common import Scratch


def expected(rows, least, top):
    counts, words = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            found = re.findall("[^ \t]+", piece)
            words[lang] += len(found)
            for m in range(1, 5):
                for i in range(len(found) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(found[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            longer = [b for p, b in f.items() if len(p) > len(phrase) and b >= least and any(p[i : i + len(phrase)] == phrase for i in range(len(p)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            cuts = [(2000000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def found(spark, rows, least, top):
    with Scratch(spark) as scratch:
        docs = documents(spark, [(i, t, lang) for i, t, lang in rows]).repartition(3)
        return sorted(tuple(r) for r in collocation.collocations(scratch, docs, least, top).collect())


def text(pick, n):
    words = ["The", "of", "and", "cat", "sat", "mat", "Ä", "é", "a\x01", "a", "a\x00b", "und", "日本"]
    return "".join(pick.choice(words) + pick.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("ranges", [1, 40])
def test_equals_plain_counts(spark, conf, monkeypatch, ranges):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    monkeypatch.setattr(collocation, "RANGE_BYTES", 4000 // ranges if ranges > 1 else 1 << 30)
    monkeypatch.setattr(collocation, "TEXT_SLICE", 500)
    pick = random.Random(2)
    rows = [(i, text(pick, pick.randint(0, 80)), pick.choice(["en", "en", "de", None, "und", ""])) for i in range(120)]
    rows += [(500 + i, "in the hot line all the time. In the hot line", "en") for i in range(40)]
    assert found(spark, rows, 4, 25) == expected(rows, 4, 25)
    assert found(spark, rows, 30, 2000) == expected(rows, 30, 2000)


def test_awkward_rows(spark):
    rows = [(r[0], r[1], r[2]) for r in AWKWARD]
    assert found(spark, rows, 1, 50) == expected(rows, 1, 50)
    assert found(spark, [], 1, 50) == []
    assert found(spark, [(1, None, "en"), (2, " ., ", "en")], 1, 50) == []


def test_windows_are_in_order_and_complete():
    pick = random.Random(4)
    texts = [text(pick, 300).encode() for _ in range(5)]
    distinct, ids, counts = collocation.windows(texts)
    keys = collocation._keys(distinct, ids).to_pylist()
    assert keys == sorted(set(keys)) and counts.sum() == len(collocation.words_of(texts)[0])
    assert Counter(dict(zip(keys, counts.tolist()))) == Counter(
        b"".join(w.encode() + b" " for w in found[i : i + 4])
        for t in texts
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in t.decode()))
        for found in [re.findall("[^ \t]+", piece)]
        for i in range(len(found))
    )
