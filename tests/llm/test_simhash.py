import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import AWKWARD, documents, prose
from tracewell.llm import simhash
from tracewell.llm.common import Scratch


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(top(i), []).append(ids[i])
    return [min((x for x in groups[top(i)] if x is not None), default=None) for i in range(len(fps))]


def test_awkward_documents(spark):
    rows = [*AWKWARD, *[(100 + i, prose(i % 9, 30), None, None) for i in range(40)]]
    with Scratch(spark) as scratch:
        got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_groups(scratch, documents(spark, rows)).collect()), key=str)
    fps = [plain_fingerprint(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    assert got == sorted(zip(ids, fps, plain_components(fps, ids)), key=str)


@pytest.mark.parametrize("hot", [4, 512])
@pytest.mark.parametrize("skewed", [False, True])
def test_links_of_any_fingerprints(spark, monkeypatch, hot, skewed):
    """Dense and skewed fingerprints, with buckets above and below the pairwise limit."""
    monkeypatch.setattr(simhash, "HOT", hot)
    pick = random.Random(4)
    fps = set()
    for _ in range(60):
        fp = pick.getrandbits(64) & (0x00FFFF0000FFFFFF if skewed else 2**64 - 1)
        for _ in range(pick.randint(1, 12)):
            fps.add(fp)
            fp ^= 1 << pick.randrange(64)
            if pick.random() < 0.5:
                fp ^= 1 << pick.randrange(64)
    fps = sorted(fps)
    ids = list(range(len(fps)))
    pick.shuffle(ids)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame(list(zip(signed, ids)), "fp long, rep long")
    with Scratch(spark) as scratch:
        from tracewell.llm.components import components

        least = {r["a"]: r["b"] for r in components(scratch, simhash.links(scratch, scratch.save(frame))).collect()}
    assert [least.get(i, i) for i in ids] == plain_components(fps, ids)


def test_thresholds_cover_every_pair_within_tau():
    best, thresholds = simhash.allot([{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 1.0, 1: 3.0}], 1)
    assert (best, thresholds) == (8.0, [0, 1])
    n, both = 1000, np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    for m in simhash.PARTITIONS:
        groups = simhash.group_bits(n, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))


def test_correlated_bits_share_a_partition():
    both = np.full((64, 64), 250.0)
    for i in range(0, 64, 2):
        both[i, i + 1] = both[i + 1, i] = 490.0
    np.fill_diagonal(both, 500.0)
    for group in simhash.group_bits(1000, both, 2):
        assert all((b ^ 1) in group for b in group)


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "q r s t u v"), (9, "q r s t u v"), (None, "a b c d e")]
    docs = documents(spark, rows)
    with Scratch(spark) as scratch:
        kept = simhash.first_of_group(scratch, docs)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 1), (False, 2), (True, None)]


def test_empty_table(spark):
    with Scratch(spark) as scratch:
        assert simhash.near_groups(scratch, documents(spark, [])).collect() == []
