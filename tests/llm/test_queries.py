"""Every query of the subpackage that has SQL, against it; the pipeline, stage by stage."""

import os

import pytest

from tests.compare import differences, duck
from tests.llm.helpers import AWKWARD, documents, prose
from tests.llm.test_packing import check_layout
from tracewell.llm.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables absent")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert differences(spark, duck(SF), QUERIES[name], SQL[name], SF) == []


def test_all_operators_are_registered():
    assert {f"op{n}" for n in range(1, 14)} <= {name.split("_")[0] for name in QUERIES}
    assert "pipeline" in QUERIES


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = [(i, prose(i % 40, 60) + f" mail{i}@example.com", "en", f"s{i % 3}") for i in range(80)]
    docs = documents(spark, rows + [r for r in AWKWARD if r[0] in (1, 2, 3)])
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        left = {r["doc_id"] for r in after.collect()}
        if name == "language_id":
            assert left == set(range(80))
        if name == "near_dedup":
            assert left <= ids and after.count() == len(left) < 80
        if name == "pii_masking":
            assert left == ids and all("[EMAIL]" in r["text"] and "@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in after.collect())
        docs, ids = after, left
    packed = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()]
    assert check_layout(packed) >= 1 and {r["doc_id"] for r in packed} == ids


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []
