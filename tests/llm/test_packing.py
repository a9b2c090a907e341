import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import AWKWARD, documents, prose
from tracewell.llm import packing
from tracewell.llm.common import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


def run(spark, docs, capacity=2048):
    with Scratch(spark) as scratch:
        rows = scratch.save(packing.pieces(docs, PATH, capacity, crc=True))
        return [r.asDict() for r in packing.pack(scratch, rows, capacity).collect()]


def check_layout(rows, capacity=2048):
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def expected(docs, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def plain(rows):
    return sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str)


def test_awkward_documents(spark):
    rows = run(spark, documents(spark, AWKWARD))
    assert plain(rows) == sorted(expected([r[:2] for r in AWKWARD]), key=str)
    check_layout(rows)


def test_words_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    tokens = packing.word_tokens(PATH)
    texts = ["It's l'été, DON'T!!  x<|endoftext|>y 3.14 a_b__c", "İstanbul ﬁ ½²³ Σίσυφος ς", "é ́x   a\x1cb", "日本語 text\ttab\r\nline", "'s 't're''ll", prose(3, 500).title()]
    for text, raw in zip(texts, tokens.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    tokens = packing.WordTokens(PATH)
    texts = [prose(i, 40) for i in range(20)]
    fresh = packing.WordTokens(PATH)
    for text in texts:
        assert tokens.encode([text]) == fresh.encode([text])


def test_bounds_and_best_fit():
    random = np.random.default_rng(1)
    for capacity in (10, 64, 2048):
        for _ in range(20):
            lengths = random.integers(1, capacity + 1, random.integers(1, 60))
            bins, offsets, fill = packing.best_fit(lengths, capacity)
            bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            assert bound <= len(fill) and fill.max() <= capacity
            assert fill.sum() == lengths.sum()
    assert packing.lower_bound(np.bincount([6, 6, 6, 5], minlength=11), 10) == 4  # the sum alone gives 3
    assert packing.lower_bound(np.bincount([4] * 9, minlength=11), 10) == 5


def test_groups_exchange_when_it_helps(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 12)
    lengths = np.random.default_rng(2).integers(200, 1200, 300).tolist()
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    with Scratch(spark) as scratch:
        rows = [r.asDict() for r in packing.pack(scratch, frame).collect()]
        alone = packing._packed(frame, frame.columns, 0, 2048).select("sequence_id").distinct().count()
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    assert check_layout(rows) <= alone


def test_empty_table(spark):
    assert run(spark, documents(spark, [])) == []


def test_wrong_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([11]), 10)


def test_units_cut_by_bytes_give_the_tokenizer_ids():
    """Case, accents, apostrophes, marks, control characters and special tokens, word by word and joined."""
    tokens = packing.WordTokens(PATH)
    pick, letters = random.Random(3), "abcXYZéÉÀß×÷ÿ019.,!?-_'’\t <>|[]/　日本 Ğ½\n\x0b\x00 's 't"
    specials = [t.content for t in tokens.special]
    texts = ["", "   ", "\n", "it's we'll X'S ''s"]
    texts += ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) + pick.choice(["", " ", *specials]) for _ in range(500)]
    want = [np.array(tokens.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tokens.encode(texts) == want and tokens.encode([]) == []
    assert [tokens.encode([t])[0] for t in texts[:50]] == want[:50]
