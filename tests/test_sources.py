"""Digests, ordered sinks and the tables that queries leave behind."""

import os

import pytest
from pyspark.sql import functions as F

from tracewell.operators import skew
from tracewell.sources import logs, tables


def numbers(spark, n, change=None):
    rows = [(i, f"name {i % 7}", None if i % 5 == 0 else i / 4, [i]) for i in range(n)]
    if change is not None:
        rows[change] = (rows[change][0], "other", *rows[change][2:])
    return spark.createDataFrame(rows, "id long, name string, share double, list array<int>")


def test_digest_merges_and_sees_every_change(spark):
    whole = logs.data_fingerprint(numbers(spark, 200)).first()
    shuffled = logs.data_fingerprint(numbers(spark, 200).repartition(7).orderBy(F.desc("id"))).first()
    assert whole == shuffled and whole.rows == 200
    parts = [logs.digest_state(numbers(spark, 200).where(c)) for c in ("id < 50", "id >= 50")]
    assert logs.digest(logs.merged_state(parts[0].union(parts[1]))).first() == whole
    assert logs.data_fingerprint(numbers(spark, 200, change=31)).first().digest != whole.digest
    assert logs.data_fingerprint(numbers(spark, 200).withColumnRenamed("share", "part")).first().digest != whole.digest
    assert logs.data_fingerprint(numbers(spark, 200).withColumn("id", F.col("id").cast("int"))).first().digest != whole.digest
    twice = numbers(spark, 200).union(numbers(spark, 200).where("id = 3"))
    assert logs.data_fingerprint(twice).first().digest != whole.digest
    assert logs.data_fingerprint(numbers(spark, 0)).first().rows == 0


def test_ordered_sink(spark, conf, tmp_path):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    manifest = tables.write_ordered(df, str(tmp_path / "o"), ["g", "k"])
    found = tables.order_inversions(manifest).first()
    assert (found.files, found.rows, found.inversions) == (8, 5000, 0)
    rows = tables.read_ordered(spark, str(tmp_path / "o")).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(5000))
    keys = [(r.g is not None, r.g or 0, r.k) for r in rows]
    assert keys == sorted(keys)
    swapped = manifest.withColumn("file_number", -F.col("file_number"))
    assert tables.order_inversions(swapped).first().inversions == 7


def test_queries_leave_only_their_result(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(skew, "shared_dir", lambda spark: str(tmp_path))

    @skew.tables_dropped
    def twice(spark, sf):
        return skew.materialise(skew.materialise(spark.range(10)).withColumn("x", F.lit(1)))

    @skew.tables_dropped
    def fails(spark, sf):
        skew.materialise(spark.range(10))
        raise ValueError

    assert twice(spark, "").count() == 10 and len(os.listdir(tmp_path)) == 1
    with pytest.raises(ValueError):
        fails(spark, "")
    assert len(os.listdir(tmp_path)) == 1 and not skew._OPEN
