import re

from tests.llm.helpers import AWKWARD, documents, prose
from tracewell.llm import mixing
from tracewell.llm.common import Scratch


def run(spark, docs):
    with Scratch(spark) as scratch:
        return [r.asDict() for r in mixing.mix(scratch, docs).collect()]


def goals(sizes):
    """Targets by repeated sharing, as the rule is worded."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        share = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * share >= 3 * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * share) for s in order}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_awkward_documents(spark):
    rows = run(spark, documents(spark, AWKWARD))
    assert len(rows) == len(AWKWARD)
    sizes, texts = {}, {}
    for doc_id, text, _, source in AWKWARD:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        texts.setdefault(doc_id, []).append(n)
    target = goals(sizes)
    for r in rows:
        assert r["size"] in texts[r["doc_id"]]
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0


def test_sources_come_near_their_targets_and_reruns_agree(spark, monkeypatch):
    rows = [(i, prose(i, 5 + i % 30), None, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    docs = documents(spark, rows)
    first = sorted(map(str, run(spark, docs)))
    monkeypatch.setattr("tracewell.llm.common.RANGE_ROWS", 50)  # many ranges of the global order
    second = run(spark, docs.repartition(7))
    assert first == sorted(map(str, second))
    taken, target = {}, {}
    for r in second:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in taken)
    assert 0 <= sum(r["size"] for r in second) - sum(taken.values()) <= 40


def test_the_mix_repeats_rows(spark):
    rows = [(i, prose(i, 20), "en", f"s{i % 4}") for i in range(80)] + [(5, prose(5, 20), "en", "s1")]
    docs = documents(spark, rows)
    with Scratch(spark) as scratch:
        out = mixing.mixed(scratch, docs)
        assert out.columns == docs.columns
        count = {}
        for r in out.collect():
            count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
        want = {}
        for r in mixing.mix(scratch, docs).collect():
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    assert count == {k: v for k, v in want.items() if v}


def test_empty_table(spark):
    assert run(spark, documents(spark, [])) == []
