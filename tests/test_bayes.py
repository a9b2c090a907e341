"""Empirical-Bayes golden values, item shifts, intervals, hashing and scoring rules."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import hashing as H
from tracewell.functions.intervals import inversions, kendall_p_value, order_statistic_ranks, t_critical
from tracewell.operators import bayes, experiments, scoring

# Published forgetting-rate fits (value, standard error) of twenty skills.
RATES = [
    (0.001207921449665223, 0.00023425342669028623),
    (0.0009792489077791457, 0.00023798673424235367),
    (0.002187890414715415, 0.0003538842328757301),
    (0.0015784040642202505, 0.0002748190736544885),
    (0.0011218786738955667, 0.00020351441995105428),
    (0.0008013596488973029, 0.00016038527470282253),
    (0.0014401638885538771, 0.0002690154219039303),
    (0.0012923602211470187, 0.00021960666028280644),
    (0.0017429251215710657, 0.0003268065298212888),
    (0.0009506573784460698, 0.00015025820960123162),
    (0.0006580499145644471, 0.0001958815510466537),
    (0.0008208050775037638, 0.00018973076758060489),
    (0.0011848891330371385, 0.0002259685393412331),
    (0.0009011656591063008, 0.00027970021501463714),
    (0.0007755977538254368, 0.00015184046663010495),
    (0.0009248167484401023, 0.00015977192084682076),
    (0.0008035847092305102, 0.00015734722787563363),
    (0.0010394200577745426, 0.00015299943368790806),
    (0.0012094719396925678, 0.000195975799101905),
    (0.0011199633757900847, 0.00018670689255879442),
]


def test_reml_reproduces_published_hyperparameters(spark):
    rows = [("lambda_per_day", float(np.log(v)), s / v) for v, s in RATES]
    fit = bayes.reml(spark.createDataFrame(rows, "parameter string, y double, se double")).first()
    assert fit.global_transformed_mean == pytest.approx(-6.800199690254255, rel=1e-7)
    assert fit.between_skill_variance == pytest.approx(0.05158693932555888, rel=1e-6)


# Published shrunk rates of the same skills.
SHRUNK = [
    0.0011671933852067345, 0.001048788048934533, 0.0017431190439219757, 0.0013872016659286595, 0.0011186286417957892,
    0.0009252956845411339, 0.0012982045779226902, 0.0012251089114108645, 0.0014535157642700043, 0.0010010006638899777,
    0.0009175882904915384, 0.000958602682424661, 0.001154853772522863, 0.001034328925920447, 0.0009048805622755285,
    0.0009899579590602681, 0.0009234985772717172, 0.0010608175699748732, 0.0011762300333088183, 0.0011177147383196811,
]


def test_shrinkage_reproduces_published_rates(spark):
    rows = [(i, "lambda_per_day", v, float(np.log(v)), s / v, False) for i, (v, s) in enumerate(RATES)]
    known = spark.createDataFrame(rows, "skill_id int, parameter string, raw_value double, y double, se double, boundary boolean")
    found = bayes.shrink(known, bayes.hyperparameters(known)).orderBy("skill_id").collect()
    assert [r.shrunk_value for r in found] == pytest.approx(SHRUNK, rel=1e-7)


def test_reml_needs_three_rows(spark):
    with pytest.raises(ValueError):
        bayes.reml(spark.createDataFrame([("a", 0.1, 0.2)] * 2, "parameter string, y double, se double"))


def test_item_shift_root_solves_its_equation(spark):
    rng = np.random.default_rng(0)
    rows = []
    while len(rows) < 2000:
        p0, p1, q, t = rng.uniform(0.02, 0.47), rng.uniform(0.5, 0.98), rng.uniform(0, 1), rng.uniform(0.01, 0.99)
        rows.append(tuple(map(float, (p0, p1, q, t))))
    df = spark.createDataFrame(rows, "p0 double, p1 double, q double, t double")
    solved = df.withColumn("d", bayes.shift_root(F.col("t"), F.col("q"), F.col("p0"), F.col("p1"))).collect()
    for r in solved:
        s = lambda p: 1 / (1 + np.exp(-(np.log(p / (1 - p)) + r.d)))
        assert (1 - r.q) * s(r.p0) + r.q * s(r.p1) == pytest.approx(r.t, abs=1e-12)


def test_holdout_is_one_fifth_and_disjoint(spark):
    rows = [(f"q{s}_{i}", s, -2 + 4 * i / 89, 200 + i) for s in (1, 2, 3) for i in range(90)]
    df = spark.createDataFrame(rows, "question_id string, skill_id int, shrunk_item_shift double, interaction_rows long")
    held = bayes.item_holdout(df)
    counts = {(r.skill_id, r.set): r["count"] for r in held.groupBy("skill_id", "set").count().collect()}
    assert all(counts[(s, "test")] == 18 and counts[(s, "practice")] == 72 for s in (1, 2, 3))
    sizes = bayes.difficulty_bins(held, 9).groupBy("skill_id", "set", "item_bin").count().collect()
    assert {r["count"] for r in sizes if r.set == "practice"} == {8} and {r["count"] for r in sizes if r.set == "test"} == {2}


def test_hash_matches_big_integers(spark):
    mask = (1 << 64) - 1

    def mix(x):
        z = (x + H.GOLDEN) & mask
        z = ((z ^ (z >> 30)) * H.MIX_1) & mask
        z = ((z ^ (z >> 27)) * H.MIX_2) & mask
        return z ^ (z >> 31)

    values = [0, 1, 2, 12345, (1 << 63) - 1, -1, -(1 << 63), 987654321987] + [int(v) for v in np.random.default_rng(1).integers(-(2**62), 2**62, 300)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    rows = df.select("x", H.unsigned_decimal(H.splitmix64("x")).alias("h"), H.learner_split("x").alias("s")).collect()
    for r in rows:
        assert int(r.h) == mix(r.x & mask)
        bucket = mix((r.x & mask) ^ H.SPLIT_SALT) % 10_000
        assert r.s == (0 if bucket < 7000 else 1 if bucket < 8500 else 2)


def test_driver_scalars():
    assert t_critical(9) == pytest.approx(2.2621571627409915, abs=1e-10)
    assert t_critical(29) == pytest.approx(2.045229642132703, abs=1e-10)
    for n in (1_000, 10_000, 100_000):
        low, high, coverage = order_statistic_ranks(n, 0.025)
        assert low < 0.025 * n < high and 0.95 <= coverage < 0.96
    low, high, coverage = order_statistic_ranks(200, 0.025)
    assert (low, high) == (1, 11) and coverage == pytest.approx(0.9811046153906396, abs=1e-12)
    assert kendall_p_value(4, 0) == pytest.approx(2 / 24) and kendall_p_value(4, 3) == 1.0
    for n in (1, 2, 5, 6):
        orders = [inversions(list(p)) for p in itertools.permutations(range(n))]
        assert orders == [sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        most = n * (n - 1) // 2
        for d in range(most + 1):
            share = sum(k <= min(d, most - d) for k in orders) / len(orders)
            assert kendall_p_value(n, d) == pytest.approx(1.0 if 2 * d == most else min(1.0, 2 * share), abs=1e-12)
    # Beyond any table: close to the normal approximation, and without a break.
    for n in (33, 34, 60):
        d, spread = n * (n - 1) // 4 - 40, math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
        assert kendall_p_value(n, d) == pytest.approx(math.erfc((n * (n - 1) / 2 - 2 * d - 1) / spread / math.sqrt(2)), abs=2e-3)


def test_interval_edge_cases(spark):
    rows = [("one", 0.5), ("none", None), ("none", float("nan")), ("two", 1.0), ("two", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r.g: r for r in experiments.interval_summary(df, ["g"], {"v": "v"}).collect()}
    assert (out["one"].v_low, out["one"].v_high) == (0.5, 0.5)
    assert out["none"].v_mean is None and out["none"].v_low is None
    assert out["two"].v_high == pytest.approx(2 + t_critical(1))


def test_duplicate_baseline_is_rejected(spark):
    df = spark.createDataFrame([("A", "p", 1, 0, 1.0)] * 2, "world_model string, policy string, replicate int, order_id int, m double")
    with pytest.raises(ValueError):
        experiments.paired_benefit(df, "p", {"m": "benefit"})


def test_curriculum_order_breaks_ties_and_information_is_not_negative(spark):
    beliefs = spark.createDataFrame([(1, s, 0.5, 0.0, 3) for s in (1, 2, 3)], "learner_id long, skill_id int, belief double, idle_days double, practice_count long")
    shifts = spark.createDataFrame([(s, b, (b - 4) / 4, 0.2, 0.1) for s in (1, 2, 3) for b in range(9)], "skill_id int, item_bin int, shift double, guess double, slip double")
    rows = scoring.with_bins(beliefs, scoring.item_endpoints(shifts))
    order = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "skill_id int, position int")
    assert scoring.nearest_target(rows).first().skill_id == 1
    for rule in (scoring.least_mastery, scoring.nearest_target, scoring.balanced_mastery, scoring.maximum_uncertainty, scoring.maximum_information):
        assert rule(rows, order).first().skill_id == 2
    b = F.col("id") / 1000.0
    worst = spark.range(1001).select(F.min(scoring.response_information(b, F.lit(0.2), F.lit(0.9), grid=4097)).alias("m")).first().m
    assert worst >= 0.0
    with pytest.raises(ValueError):
        scoring.robust_bins(shifts, (1.1, 1.25))
