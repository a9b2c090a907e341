import numpy as np
import pytest

from tracewell.llm import neardup
from tracewell.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, n long, kept boolean, a long, b long"


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, label, 1, 2, True, 3, 4) for i, v, label in rows], SCHEMA)
    with Scratch(spark) as scratch:
        found, recall = neardup.near_duplicates(scratch, frame, **options)
        return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found.collect()), key=str), recall


def plain(rows):
    usable = [v is not None and label is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, label in rows]
    links = [[] for _ in rows]
    units = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if u else None for (_, v, _), u in zip(rows, usable)]
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            if usable[i] and usable[j] and label == rows[j][2] and len(v) == len(rows[j][1]) and units[i] @ units[j] >= 0.93:
                links[i].append(j)
                links[j].append(i)
    root = list(range(len(rows)))
    changed = True
    same = {}
    for i, (vec, _, _) in enumerate(rows):
        if usable[i]:
            same.setdefault(vec, []).append(i)
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in links[i] + same.get(rows[i][0] if usable[i] else None, []):
                if root[j] < root[i]:
                    root[i], changed = root[j], True
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[root[i]] = min(least.get(root[i], vec), vec)
    return sorted(((vec, len(links[i]), least[root[i]] if vec is not None else None, vec is not None and vec == least[root[i]]) for i, (vec, _, _) in enumerate(rows)), key=str)


def clustered(seed, n, width=16, labels=2, spread=0.16):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(n // 6, width))
    rows = centres[random.integers(len(centres), size=n)] + spread * random.normal(size=(n, width))
    return [(int(i), [float(np.float32(x)) for x in r], int(random.integers(labels))) for i, r in zip(random.permutation(n), rows)]


@pytest.mark.parametrize("limits", [(1200, 1500), (60, 1500), (60, 50)])
def test_links_and_components_equal_brute_force(spark, monkeypatch, limits):
    """One shard, many overlapping shards, and shards cut into pairs of sub-blocks."""
    monkeypatch.setattr(neardup, "SHARD", limits[0])
    monkeypatch.setattr(neardup, "LIMIT", limits[1])
    rows = clustered(3, 500)
    got, recall = run(spark, rows)
    want = plain(rows)
    found, truth = (sum(r[1] for r in x) for x in (got, want))
    assert truth > 500 and found >= 0.95 * truth and recall >= neardup.TARGET
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    if limits == (1200, 1500):
        assert got == want


def test_copies_and_a_dense_cluster(spark):
    dense = np.random.default_rng(0).normal(size=8)
    rows = [(i, [float(x) for x in np.float32(dense + 0.02 * np.random.default_rng(i).normal(size=8))], 1) for i in range(150)]
    rows += [(1000 + i, [float(x) for x in np.float32(-dense)], 1) for i in range(60)]
    got, _ = run(spark, rows)
    assert got == plain(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, -0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 2.0], None)]
    rows += [(8, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0], 2), (12, [1.0, 2.0, 0.0], 1), (None, [1.0, 2.0], 1), (13, [1e-30, 2e-30], 1)]
    got, _ = run(spark, rows)
    assert got == plain(rows)


def test_empty_table(spark):
    assert run(spark, [])[0] == []


def test_pruned_graph_keeps_no_needless_edge():
    x = np.random.default_rng(1).normal(size=(80, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = neardup.pruned_graph(x)
    half = len(a) // 2
    assert not (a == b).any() and np.bincount(a[:half]).max() <= neardup.DEGREE
    assert set(zip(a[:half].tolist(), b[:half].tolist())) == set(zip(b[half:].tolist(), a[half:].tolist()))


def test_a_recall_below_target_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_audit", lambda nodes, found: 0.5)
    frame = spark.createDataFrame([(i, 0, [1.0, i / 100]) for i in range(20)], "vec_id long, label long, embedding array<double>")
    with Scratch(spark) as scratch, pytest.raises(RuntimeError, match="0.5000"):
        neardup.near_duplicates(scratch, frame)
