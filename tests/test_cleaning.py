"""Cleaning rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import cleaning as C
from tracewell.operators import prepare
from tracewell.sources import learner_files, logs, tables

HEADER = "timestamp,solving_id,question_id,user_answer,elapsed_time\n"
QUESTIONS = (
    "question_id,bundle_id,explanation_id,correct_answer,part,tags,deployed_at\n"
    "q1,b1,e1,a,1,10,1000\nq2,b2,e2,b,2,20;21,2000\nq3,b3,e3,c,3,-1,-1\n"
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "kt").mkdir()
    (tmp_path / "meta" / "contents").mkdir(parents=True)
    (tmp_path / "meta" / "contents" / "questions.csv").write_text(QUESTIONS)
    return tmp_path


def questions(spark, folder):
    return prepare.require_valid_questions(prepare.normalize_questions(logs.read_questions(spark, str(folder / "meta"))))


def test_questions(spark, folder):
    found = {r.question_id: r for r in questions(spark, folder).collect()}
    assert (found["q1"].skill_ids, found["q1"].skill_count, found["q1"].primary_skill_id) == ("10", 1, 10)
    assert (found["q2"].skill_ids, found["q2"].skill_count, found["q2"].primary_skill_id) == ("20;21", 2, None)
    assert (found["q3"].skill_ids, found["q3"].skill_count, found["q3"].deployed_at_ms) == ("", 0, None)


def test_bad_questions_are_fatal(spark):
    columns = "question_id string, bundle_id string, explanation_id string, correct_answer string, part string, tags string, deployed_at string"
    for rows in ([("q1", "", "", "a", "1", "1", "1")] * 2, [("x1", "", "", "a", "1", "1", "1")], [("q1", "", "", "e", "1", "1", "1")]):
        with pytest.raises(ValueError):
            prepare.require_valid_questions(prepare.normalize_questions(spark.createDataFrame(rows, columns)))


def test_five_row_learner(spark, folder):
    (folder / "kt" / "u7.csv").write_text(HEADER + "3000,1,q1,a,100\n2500,1,q2,b,200\n2500,1,q2,b,200\n4000,2,q3,z,-1\n5000,3,q999,a,bad\n")
    raw, errors = learner_files.read(spark, str(folder / "kt"))
    assert errors.count() == 0
    cleaned = prepare.interactions(raw, questions(spark, folder), extreme_elapsed_ms=150)
    rows = cleaned.orderBy("sequence_index").collect()
    assert [r.timestamp_ms for r in rows] == [2500, 2500, 3000, 4000, 5000]
    assert [r.source_row for r in rows] == [3, 4, 2, 5, 6]
    assert not rows[0].quality_flags & 16 and rows[1].quality_flags & 16
    assert rows[4].quality_flags & 1 and rows[4].quality_flags & 2048
    s = prepare.learner_summary(cleaned).first()
    assert (s.non_monotonic_count, s.duplicate_count, s.unknown_question_count, s.invalid_response_count) == (1, 1, 1, 1)
    assert (s.negative_elapsed_count, s.extreme_elapsed_count, s.raw_rows) == (1, 2, 5)


def test_four_row_learner(spark, folder):
    (folder / "kt" / "U9.CSV").write_text(HEADER + "2000,1,q1,a,1000\n1500,1,q2,c,-5\n1500,1,q2,c,-5\n3000,2,q999,z,abc\n")
    raw, _ = learner_files.read(spark, str(folder / "kt"))
    s = prepare.learner_summary(prepare.interactions(raw, questions(spark, folder), 2000)).first()
    assert (s.learner_id, s.non_monotonic_count, s.duplicate_count, s.unknown_question_count) == (9, 1, 1, 1)
    assert (s.invalid_response_count, s.negative_elapsed_count) == (1, 2)


def test_files_errors_and_inventory(spark, folder):
    kt = folder / "kt"
    (kt / "u1.csv").write_bytes(b"\xef\xbb\xbf" + (HEADER + "1000,1,q1,a,50\r\n\r\n2000,2,q2,a,60\r\n").encode())
    (kt / "u2.csv").write_text("elapsed_time,user_answer,question_id,solving_id,timestamp\n" + '70,"c, d",q3,1,1000\n')
    (kt / "u3.csv").write_text("timestamp,question_id\n1,q1\n")
    (kt / "u4.csv").write_text("")
    raw, errors = learner_files.read(spark, str(kt))
    rows = sorted((r.learner_id, r.source_row, r.timestamp, r.user_answer, r.elapsed_time) for r in raw.collect())
    assert rows == [(1, 2, "1000", "a", "50"), (1, 3, "2000", "a", "60"), (2, 2, "1000", "c, d", "70")]
    assert sorted(r.learner_id for r in errors.collect()) == [3, 4]
    summary = prepare.add_failed_learners(prepare.learner_summary(prepare.interactions(raw, questions(spark, folder))), errors)
    totals = {r.shard_id: r for r in prepare.run_totals(summary.withColumn("shard_id", F.lit(0))).collect()}
    assert (totals[None].learner_rows, totals[None].interaction_rows, totals[None].file_errors) == (4, 3, 2)
    assert totals[None].status == "COMPLETED_WITH_FILE_ERRORS"
    inventory = learner_files.inventory(spark, str(kt))
    report = logs.inventory_report(inventory).first()
    assert (report.learner_files, report.unexpected_files, report.minimum_learner_id, report.maximum_learner_id) == (4, 0, 1, 4)
    assert report.total_bytes == sum(f.stat().st_size for f in kt.iterdir())
    (kt / "u9.csv").write_text("timestamp,solving_id,question_id,user_answer,elapsed_time\n")
    raw, errors = learner_files.read(spark, str(kt))
    found = prepare.add_failed_learners(prepare.learner_summary(prepare.interactions(raw, questions(spark, folder))), errors)
    whole = {r.learner_id: r for r in prepare.add_silent_learners(found, learner_files.inventory(spark, str(kt))).collect()}
    assert sorted(whole) == [1, 2, 3, 4, 9] and (whole[9].raw_rows, whole[9].source_file, whole[9].file_error) == (0, "u9.csv", None)
    (kt / "u9.csv").unlink()
    (kt / "other.csv").write_text("x\n")
    with pytest.raises(ValueError):
        logs.require_clean_inventory(learner_files.inventory(spark, str(kt)))
    assert logs.inventory_report(learner_files.inventory(spark, str(kt))).first().fingerprint != report.fingerprint


@pytest.mark.parametrize("size", [100, 8000, 1 << 20])
def test_large_file_is_numbered_across_ranges(spark, folder, size):
    lines = [f"{1000 + i},{i},q{1 + i % 3},a,{i}" for i in range(4000 if size > 100 else 60)]
    (folder / "kt" / "u5.csv").write_text(HEADER + "\n".join(lines) + "\n\n")
    (folder / "kt" / "u6.csv").write_text(HEADER + "5,1,q1,a,9\n")
    raw, errors = learner_files.read(spark, str(folder / "kt"), size)
    rows = raw.where("learner_id = 5").orderBy("source_row").collect()
    assert [r.source_row for r in rows] == list(range(2, len(lines) + 2))
    assert [r.elapsed_time for r in rows] == [str(i) for i in range(len(lines))]
    assert raw.count() == len(lines) + 1 and errors.count() == 0


def test_file_that_cannot_be_decoded_is_an_error_as_a_whole(spark, folder):
    (folder / "kt" / "u5.csv").write_bytes((HEADER + "1,1,q1,a,9\n" * 200).encode() + b"2,1,q1,\xff,9\n")
    (folder / "kt" / "u6.csv").write_text(HEADER + "5,1,q1,a,9\n")
    for size in (500, 1 << 20):
        raw, errors = learner_files.read(spark, str(folder / "kt"), size)
        assert [r.learner_id for r in raw.collect()] == [6] and [r.learner_id for r in errors.collect()] == [5]


def test_learner_files_are_written_and_read_back(spark, tmp_path):
    rows = [(i % 5, i, str(1000 - i), None, f'q{i}', 'say "a, b"', "") for i in range(2, 60)]
    df = spark.createDataFrame(rows, "learner_id long, source_row long, timestamp string, solving_id string, question_id string, user_answer string, elapsed_time string")
    learner_files.write(df, str(tmp_path / "kt"))
    assert sorted(f.name for f in (tmp_path / "kt").iterdir()) == [f"u{i}.csv" for i in range(5)]
    raw, errors = learner_files.read(spark, str(tmp_path / "kt"), 100)
    back = sorted((r.learner_id, r.source_row, r.timestamp, r.solving_id, r.user_answer) for r in raw.collect())
    want = [(k, i, r[2], "", r[5]) for k in range(5) for i, r in enumerate([r for r in rows if r[0] == k], 2)]
    assert back == sorted(want) and errors.count() == 0


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "x"), (1, "y")], "skill_id int, name string")
    tables.write_csv(df, str(tmp_path / "c"), gzip=True)
    assert sorted(r.name for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == ["x", "y"]
    tables.write_parquet(df, str(tmp_path / "p"), ["skill_id"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    tables.write_errors(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
    bundle = {n: df for n in tables.BUNDLE}
    tables.write_bundle(bundle, str(tmp_path / "b"))
    assert set(tables.read_bundle(spark, str(tmp_path / "b"))) == set(tables.BUNDLE)
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "b" / "selected_pairs"))
    with pytest.raises(ValueError):
        tables.read_bundle(spark, str(tmp_path / "b"))


def test_parsers_on_literals(spark):
    cases = {"": None, "  ": None, "+5": 5, " 12 ": 12, "1_0": 10, "_1": None, "3.7": None, "-4": -4, "9" * 20: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", C.parse_int(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases
    tags = {"": "", "-1": "", "nan": "", "5;5; 7;x;-2;": "5;7", "3": "3"}
    df = spark.createDataFrame([(k,) for k in tags], "t string").select("t", C.tag_text(C.tag_list(F.col("t"))).alias("v"))
    assert {r.t: r.v for r in df.collect()} == tags
    with pytest.raises(Exception):
        spark.createDataFrame([("x1",)], "q string").select(C.question_number(F.col("q"))).collect()
