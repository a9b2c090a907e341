"""Hot groups take another path; its results must equal those of plain windows and joins."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import prepare, skew

TASK = skew.TASK_ROWS_CONF


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def lopsided(spark):
    """1500 rows: key 1 holds two thirds, half of them at the same time."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        key = 1 if i % 3 else int(rng.integers(2, 40))
        t = 500 if key == 1 and i % 2 else int(rng.integers(0, 1000))
        rows.append((key, t, i, None if i % 7 == 0 else int(rng.integers(0, 50)), float(i % 11)))
    return spark.createDataFrame(rows, "k long, t long, i long, v long, w double")


def test_prefix_equals_plain_windows(lopsided, conf):
    args = dict(
        count="position", sums={"v_before": F.col("v")}, lasts={"v_last": F.col("v")}, totals={"v_total": F.col("v"), "n": F.lit(1)}
    )
    plain = rows_of(skew.prefix(lopsided, ["k"], ["t", "i"], **args))
    conf(TASK, "60")
    hot, limit = skew.hot_groups(lopsided, ["k"])
    assert [r["k"] for r in hot] == [1] and limit == 60
    ranged = skew.prefix(lopsided, ["k"], ["t", "i"], **args)
    assert rows_of(ranged) == plain


def test_ranges_split_a_hot_group_evenly(lopsided, conf):
    conf(TASK, "60")
    ranged = skew._with_ranges(lopsided, ["k"], ["t", "i"], 60)
    sizes = [r["count"] for r in ranged.where("k = 1").groupBy("__range").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 4 * 60
    plan = skew.prefix(lopsided, ["k"], ["t", "i"], count="p")._jdf.queryExecution().toString()
    assert "__blocks" not in plan and "__range" in plan


def test_prefix_over_the_whole_table(lopsided, conf):
    conf(TASK, "60")
    found = skew.prefix(lopsided, [], ["t", "i"], count="p", sums={"s": F.col("i")}, totals={"n": F.lit(1)}).orderBy("t", "i").collect()
    assert [r.p for r in found] == list(range(1500)) and {r.n for r in found} == {1500}
    assert [r.s for r in found] == [0, *np.cumsum([r.i for r in found])[:-1].tolist()]


def test_prefix_with_null_group_key(spark, conf):
    df = spark.createDataFrame([(None if i % 3 else 5, i) for i in range(300)], "k long, i long")
    w = Window.partitionBy("k").orderBy("i")
    expected = rows_of(df.withColumn("p", (F.row_number().over(w) - 1).cast("long")))
    conf(TASK, "20")
    assert rows_of(skew.prefix(df, ["k"], ["i"], count="p")) == expected


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_above_broadcast_cap(spark, lopsided, conf, how):
    table = spark.createDataFrame([(k, k * 10) for k in range(1, 30)], "k long, x long")
    expected = rows_of(lopsided.join(table, "k", how))
    conf(skew.BROADCAST_ROWS_CONF, "5")
    conf(TASK, "60")
    assert rows_of(skew.lookup_join(lopsided, table, ["k"], how)) == expected


def test_bottom_k_matches_single_window(lopsided):
    order = [F.col("w"), F.col("i")]
    w = Window.partitionBy("k").orderBy(*order)
    expected = rows_of(lopsided.withColumn("r", F.row_number().over(w)).where("r <= 7").drop("r"))
    assert rows_of(skew.bottom_k(lopsided, ["k"], order, 7, ["i"], salts=5)) == expected


def test_quantiles_match_numpy_on_both_paths(lopsided, conf):
    probabilities = (0.025, 0.1, 0.5, 0.9, 0.975)
    data = {}
    for r in lopsided.where("v is not null").collect():
        data.setdefault(r.k, []).append(r.v)
    for limit in ("1000000", "60"):
        conf(TASK, limit)
        found = {r.k: r.quantiles for r in skew.exact_quantiles(lopsided, ["k"], "v", probabilities).collect()}
        assert set(found) == set(data)
        for k, values in data.items():
            assert np.allclose(found[k], np.quantile(values, probabilities), atol=1e-12)


def test_cleaning_is_the_same_for_hot_learners(spark, conf):
    """One learner holds most rows and many copies of a single event."""
    rows = []
    for i in range(600):
        learner = 1 if i % 4 else 2 + i % 5
        stamp = None if i % 17 == 0 else str(1000 if i % 3 == 0 else 5000 - (i * 37) % 3000)
        rows.append((learner, f"u{learner}.csv", i + 2, stamp, "1", f"q{i % 3}", "abz"[i % 3], "10"))
    raw = spark.createDataFrame(
        rows, "learner_id long, source_file string, source_row long, timestamp string, solving_id string, question_id string, user_answer string, elapsed_time string"
    )
    parsed = prepare.parse_responses(raw)
    plain = rows_of(prepare.sequence_responses(parsed))
    assert sum(r[-1] for r in plain) > 100
    conf(TASK, "40")
    assert rows_of(prepare.sequence_responses(parsed).select(prepare.sequence_responses(parsed).columns)) == plain
