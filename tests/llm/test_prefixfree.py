"""Prefix-free parsing against brute force over all strings of 100 bytes."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import AWKWARD, documents, prose
from tracewell.llm import prefixfree
from tracewell.llm.common import Scratch

SPAN = prefixfree.SPAN


def expected(rows):
    """doc_id -> (bytes, removed, spans, kept) for rows with distinct doc_ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - SPAN + 1):
            string = raw[i : i + SPAN]
            if string in seen:
                gone[i : i + SPAN] = b"\x01" * SPAN
            seen.add(string)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len([1 for part in bytes(gone).split(b"\x00") if part])
        out[doc_id] = (len(raw), sum(gone), spans, kept)
    return out


def found(spark, rows, **options):
    with Scratch(spark) as scratch:
        docs = documents(spark, [(i, t) for i, t in rows]).repartition(3)
        result = prefixfree.without_repeats(scratch, docs, **options).collect()
    return {r["doc_id"]: tuple(bytes(c) if isinstance(c, bytearray) else c for c in tuple(r)[1:]) for r in result}


def passages(seed=3, n=40):
    pick = random.Random(seed)
    shared = [prose(100 + i, pick.randint(15, 80)) for i in range(6)] + ["é" * 90, "ab" * 80]
    rows = []
    for i in range(n):
        parts = [prose(1000 + 10 * i + j, pick.randint(5, 60)) for j in range(3)]
        for _ in range(pick.randint(0, 3)):
            parts.insert(pick.randint(0, 3), pick.choice(shared))
        rows.append((i * 3, " ".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(5)]
    rows += [(2000, rows[7][1] + rows[7][1]), (2001, "x" * 700), (2002, "x" * 99), (2003, "y" * 100), (2004, "y" * 100 + "z"), (2005, None), (2006, "")]
    return rows


@pytest.mark.parametrize("deal", [prefixfree.DEAL, 1])
def test_equals_brute_force(spark, conf, deal):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = passages()
    assert found(spark, rows, deal=deal) == expected(rows)


def test_digest_and_awkward_rows(spark):
    rows = [r[:2] for r in AWKWARD if r[0] not in (None, 5)]
    want = {k: (n, m, s, hashlib.sha256(kept).hexdigest()) for k, (n, m, s, kept) in expected(rows).items()}
    got = found(spark, [r[:2] for r in AWKWARD], digest=True)
    assert {k: v for k, v in got.items() if k not in (None, 5)} == want
    assert got[None] == (len(AWKWARD[6][1]), 0, 0, hashlib.sha256(AWKWARD[6][1].encode()).hexdigest())
    assert found(spark, []) == {}


def test_rows_that_repeat_a_doc_id(spark):
    long = prose(5, 60)
    with Scratch(spark) as scratch:
        rows = prefixfree.without_repeats(scratch, documents(spark, [(1, long), (1, long), (2, long + " end"), (2, "other " + long)])).collect()
    first = [r for r in rows if r["doc_id"] == 1]
    assert len(first) == 2 and all(r["n_removed"] == 0 for r in first)
    assert all(r["n_removed"] >= len(long) for r in rows if r["doc_id"] == 2) and len(rows) == 4


def test_steps_do_not_matter(monkeypatch):
    """Texts longer than a step give the same strings as in one step."""
    texts = [prose(i, 300).encode() for i in range(3)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    for step in (1 << 18, 101, 500):
        monkeypatch.setattr(prefixfree, "STEP", step)
        _, _, at, n = prefixfree.phrases(data, ends)
        starts = np.sort(np.concatenate([np.arange(a, a + k) for a, k in zip(at, n)]))
        want = np.concatenate([np.arange(e - len(t), e - SPAN + 1) for e, t in zip(ends, texts)])
        assert np.array_equal(starts, want)


def test_colliding_hashes_fall_back_to_bytes(monkeypatch):
    content = pa.array([b"a" * 50 + b"b" * 60, b"c" * 110, b"z" + b"a" * 50 + b"b" * 59], pa.binary())
    g, n = np.array([7, 7, 7]), np.array([11, 11, 11])
    want = [x.tolist() for x in prefixfree.repeated_suffixes(g, content, n)]
    monkeypatch.setattr(prefixfree.Rolling, "of", lambda self, first, end: np.zeros(len(first), np.uint64))
    assert [x.tolist() for x in prefixfree.repeated_suffixes(g, content, n)] == want
    assert want[0] == [1, 2] and want[1] == [1, 1] and want[2] == [10, 10]
