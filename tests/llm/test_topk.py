import math

import numpy as np
import pytest

from tracewell.llm import topk
from tracewell.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, score long, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def run(spark, queries, rows, k=20):
    with Scratch(spark) as scratch:
        found = topk.search(scratch, table(spark, queries), table(spark, rows), k).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)


def plain(queries, rows, k=20):
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(64 * float(np.float32(x))) for x in v]
    out = []
    first = {}
    for i, v in queries:
        if i is not None and usable(v):
            first[i] = min(first.get(i, v), v)
    for q, v in first.items():
        scored = sorted((-sum(a * b for a, b in zip(whole(v), whole(w))), i) for i, w in rows if i is not None and i != q and usable(w))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(seed, n, width=9):
    random = np.random.default_rng(seed)
    rows = random.normal(size=(n, width)).round(1)
    rows[random.random(rows.shape) < 0.6] = 0
    return [(i, [float(x) for x in r]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [4096, 7])
def test_equals_brute_force_with_many_ties(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    rows = vectors(1, 300)
    assert run(spark, rows[::10], rows, 5) == plain(rows[::10], rows, 5)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0] * 3), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (7, [0.5]), (8, [-1.0, 2.0]), (None, [9.0, 9.0]), (9, [3e18, 1.0])]
    small = rows[:-1]
    assert run(spark, small, small) == plain(small, small)
    assert len(run(spark, [(0, [1.0])], rows)) > 0


def test_large_scores_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**19))]) for i in range(40)]
    assert run(spark, rows[:3], rows, 7) == plain(rows[:3], rows, 7)


def test_empty_tables(spark):
    assert run(spark, [], vectors(1, 5)) == [] and run(spark, vectors(1, 5), []) == []
