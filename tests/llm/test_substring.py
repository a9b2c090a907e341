import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tests.llm.helpers import AWKWARD, documents, prose
from tracewell.llm import substring


def plain(rows):
    """The contract's rule, word by word; rows are (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    least = {}
    for (doc_id, _), w in zip(rows, words):
        for i in range(len(w) - 12):
            if doc_id is not None:
                key = tuple(w[i : i + 13])
                least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 12):
            if doc_id is not None and least[tuple(w[i : i + 13])] < doc_id:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    found = substring.without_repeats(documents(spark, rows), digest=True)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()), key=str)


def passages(seed, n):
    pick = random.Random(seed)
    shared = [prose(i, pick.randint(10, 80)) for i in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(1000 + i * 7 + k, pick.randint(0, 30)) if pick.random() < 0.5 else pick.choice(shared) for k in range(pick.randint(0, 6))]
        text = pick.choice([" ", "\n", "\t "]).join(parts)
        if pick.random() < 0.2:
            text = text.replace("a", "á", 1)
        rows.append((pick.randint(0, 10**12) if i % 9 else i, text))
    return rows


def test_passages_of_many_documents(spark):
    rows = passages(1, 120)
    assert run(spark, rows) == plain(rows)


def test_awkward_documents(spark):
    rows = [r[:2] for r in AWKWARD] + [(20, "a " * 40), (21, "a " * 30), (22, "b a " * 20), (19, " ".join("abcdefghijklm")), (23, "x " + " ".join("abcdefghijklm") + " y")]
    assert run(spark, rows) == plain(rows)


def test_rows_that_repeat_an_id(spark):
    shared = prose(5, 40)
    rows = [(1, shared), (2, shared + " tail"), (2, shared + " tail"), (2, "head " + shared), (1, prose(6, 20) + " " + shared), (None, shared)]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_kept_words_are_returned_as_text(spark):
    shared = " ".join("abcdefghijklm")
    rows = substring.without_repeats(documents(spark, [(1, shared), (2, f"x  {shared}\ny")])).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in rows) == [(1, shared), (2, "x y")]


def test_hashes_depend_on_the_words_alone():
    texts = [b"", b"  one two ", b"two\tone", "é two".encode(), b"one two"]
    hashes, counts = substring.word_hashes(texts)
    assert counts.tolist() == [0, 2, 2, 2, 2]
    one, two = hashes[0], hashes[1]
    assert hashes.tolist() == [one, two, two, one, hashes[4], two, one, two] and len({one, two, hashes[4]}) == 3
    long = prose(1, 3000).encode()
    whole, _ = substring.word_hashes([long])
    later, _ = substring.word_hashes([b"x " * 999, long])
    assert np.array_equal(whole, later[999:])


def test_buckets_may_be_cut_anywhere():
    """The same bits, however the sorted pieces are cut into batches."""
    pick = np.random.default_rng(0)
    bucket = np.sort(pick.integers(0, 6, 200))
    ids = pick.integers(0, 9, 200)
    order = np.lexsort((ids, bucket))
    bucket, ids = bucket[order], ids[order]
    sizes = pick.integers(0, 4, 200)
    edges = [pick.integers(0, 5, n).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : substring.EDGE_BYTES].tobytes() for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids), pa.array(np.arange(200)), pa.array(np.zeros(200, np.int32)), pa.array(edges, pa.binary())], ["bucket", "doc_id", "place", "known", "edges"])

    def bits(step):
        carried = substring._Bucket()
        return np.concatenate([substring._bits(batch.slice(at, step), carried) for at in range(0, 200, step)])

    want = np.zeros(200, int)
    for i in range(200):
        for k in range(sizes[i]):
            edge = edges[i][k * 6 : k * 6 + 6]
            if any(bucket[j] == bucket[i] and ids[j] < ids[i] and edge in [edges[j][m * 6 : m * 6 + 6] for m in range(sizes[j])] for j in range(i)):
                want[i] |= 1 << k
    for step in (200, 50, 7, 1):
        assert np.array_equal(bits(step), want), step
