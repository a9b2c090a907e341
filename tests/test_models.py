"""Recursion, filtering of long sequences, likelihood, fitting and calibration."""

import numpy as np
import pytest

from tracewell.functions import recursion as R
from tracewell.operators import bkt, fit, metrics
from tracewell.operators.skew import materialise
from tracewell.plans import model_queries as M
from tracewell.plans import views as V

KEYS = ["learner_id", "skill_id"]


def one_sequence(gaps, y, p):
    """Plain reference recursion for one sequence."""
    p_init, learn, slip, guess, rate = p
    m, out = p_init, []
    for gap, hit in zip(gaps, y):
        pre = m * np.exp(-rate * gap)
        q = min(max(guess + pre * (1 - slip - guess), 1e-12), 1 - 1e-12)
        know, other = (1 - slip, guess) if hit else (slip, 1 - guess)
        post = pre * know / (pre * know + (1 - pre) * other)
        m = learn + (1 - learn) * post
        out.append((q, m))
    return out


def synthetic(spark, learners, events, seed=1, skill=1):
    rng = np.random.default_rng(seed)
    p_init, learn, slip, guess, rate = 0.25, 0.18, 0.09, 0.21, 0.06
    rows = []
    for u in range(learners):
        known = rng.random() < p_init
        for i in range(events):
            gap = 0.0 if i == 0 else (rng.uniform(1 / 1440, 0.05) if rng.random() < 0.55 else rng.uniform(0.5, 12.0))
            gap_ms = int(gap * 86_400_000)
            known = known and rng.random() < np.exp(-rate * gap_ms / 86_400_000)
            y = bool(rng.random() < (1 - slip if known else guess))
            rows.append((u, skill, i, gap_ms, y))
            known = known or rng.random() < learn
    return spark.createDataFrame(rows, "learner_id long, skill_id int, within_skill_index long, gap_ms long, is_correct boolean").repartition(4)


def parameters(spark, skill=1):
    return spark.createDataFrame(
        [(skill, "BKT", 0.3, 0.1, 0.1, 0.2, 0.0), (skill, "BKT-F", 0.4, 0.2, 0.15, 0.25, 0.05)],
        "skill_id int, model string, p_init double, p_learn double, slip double, guess double, lambda_per_day double",
    )


def test_filter_matches_plain_recursion_for_any_piece_size(spark, conf):
    events = synthetic(spark, 12, 37)
    stored = {}
    for r in events.collect():
        stored.setdefault(r.learner_id, []).append((r.within_skill_index, r.gap_ms / 86_400_000, r.is_correct))
    expected = {}
    for model in parameters(spark).collect():
        p = tuple(model[c] for c in bkt.MODEL_COLUMNS)
        for u, seq in stored.items():
            seq.sort()
            for i, pair in enumerate(one_sequence([s[1] for s in seq], [s[2] for s in seq], p)):
                expected[(u, model.model, i)] = pair
    for size in ("1024", "37", "5", "1"):
        conf(bkt.PIECE_CONF, size)
        scored = bkt.filter_sequences(bkt.sequence_pieces(events, KEYS), parameters(spark), KEYS).collect()
        assert len(scored) == len(expected)
        for r in scored:
            assert (r.prediction, r.state) == pytest.approx(expected[(r.learner_id, r.model, r.within_skill_index)], abs=1e-9)


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(5)
    length = np.array([9, 7, 4, 1])
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    days, y = rng.uniform(0, 5, length.sum()), rng.integers(0, 2, length.sum())

    def nll(p):
        n = len(length)
        full = [np.full(n, v) for v in p]
        return R.adjoint(full[0], first, length, days, y, *full[1:])

    p = np.array([0.3, 0.15, 0.12, 0.22, 0.04])
    total, gradient = nll(p)[0].sum(), nll(p)[1].sum(axis=0)
    for i in range(5):
        h = np.zeros(5)
        h[i] = 1e-6
        slope = (nll(p + h)[0].sum() - nll(p - h)[0].sum()) / 2e-6
        assert slope == pytest.approx(gradient[i], abs=2e-5 * max(1, abs(total)))
        ends = [R.adjoint(*[np.full(4, v) for v in q[:1]], first, length, days, y, *[np.full(4, v) for v in q[1:]], likelihood=False) for q in (p + h, p - h, p)]
        assert (ends[0][0] - ends[1][0]) / 2e-6 == pytest.approx(ends[2][1][:, i], abs=1e-6)


def test_likelihood_is_the_same_for_any_piece_size(spark, conf):
    events = synthetic(spark, 6, 30)
    points = {1: np.array([[0.3, 0.1, 0.1, 0.2, 0.0], [0.4, 0.2, 0.15, 0.25, 0.05]])}
    results = []
    for size in ("1024", "7", "1"):
        conf(bkt.PIECE_CONF, size)
        training = fit.Training.of(bkt.sequence_pieces(events, KEYS))
        rows = fit.likelihood(training, points).orderBy("candidate").collect()
        results.append(np.array([[r[c] for c in fit._SUMS] for r in rows]))
    assert results[0].shape == (2, 21)
    for other in results[1:]:
        assert np.allclose(results[0], other, rtol=1e-9, atol=1e-9)


def test_fit_recovers_parameters(spark):
    pieces = bkt.sequence_pieces(synthetic(spark, 1200, 24), KEYS)
    config = fit.FitConfig(starts_bkt=1, starts_bktf=2, max_steps=25, polish_steps=4)
    rows = {r.model: r for r in fit.fit_models(pieces, config).collect()}
    f = rows["BKT-F"]
    truth = {"p_init": (0.25, 0.10), "p_learn": (0.18, 0.08), "slip": (0.09, 0.06), "guess": (0.21, 0.06), "lambda_per_day": (0.06, 0.04)}
    for name, (value, tolerance) in truth.items():
        assert abs(f[name] - value) < tolerance, name
        assert f[f"se_{name}_approx"] > 0
    assert f.hessian_status == "positive_definite" and f.gradient_inf_norm < 1e-3
    assert f.nll_train < rows["BKT"].nll_train
    assert rows["BKT"].lambda_per_day == 0.0 and rows["BKT"].retention_half_life_days == float("inf")
    assert f.aic_train == pytest.approx(10 + 2 * f.nll_train)
    assert f.n_train_events == 1200 * 24 and f.n_train_sequences == 1200


def newton(x, y, steps=80):
    """The regression on the events themselves: (intercept, slope, status)."""
    b = np.array([0.0, 1.0])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
        w = np.maximum(mu * (1 - mu), 1e-8)
        columns = np.stack([np.ones_like(x), x])
        step = np.linalg.solve((columns * w) @ columns.T + 1e-8 * np.eye(2), columns @ (mu - y))
        b = b - step
        if np.abs(step).max() < 1e-9:
            return b[0], b[1], "converged"
    return b[0], b[1], "maxiter"


def test_calibration_line_equals_regression_on_events(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(p), int(rng.random() < 0.2 + 0.6 * p)) for g in range(3) for p in rng.uniform(0.02, 0.98, 3000)]
    rows += [(4, p, y) for p, y in ((0.3, 0), (0.35, 1), (0.3, 1), (0.9, 1), (0.1, 0))]
    rows += [(5, 0.4, 1), (5, 0.4, 0), (5, 0.4, 1)]  # one prediction
    rows += [(6, 0.2, 0), (6, 0.3, 0), (6, 0.7, 1)]  # outcomes that a threshold separates
    rows += [(9, 0.4, 1), (9, 0.6, 1)]
    df = spark.createDataFrame(rows, "g int, prediction double, y int")
    found = {r.g: r for r in metrics.calibration_line(df, ["g"]).collect()}
    assert found[9].calibration_fit_status == "single_outcome" and found[9].calibration_slope is None
    for g in (0, 1, 2, 4, 5, 6):
        p, y = np.array([r[1:] for r in rows if r[0] == g]).T
        intercept, slope, status = newton(np.log(p / (1 - p)), y)
        assert found[g].calibration_fit_status == status or g == 5, g
        assert found[g].calibration_intercept == pytest.approx(intercept, abs=1e-6)
        assert found[g].calibration_slope == pytest.approx(slope, abs=1e-6)
    assert found[6].calibration_fit_status == "maxiter" and found[5].calibration_fit_status == "converged"


def test_prediction_tables_add_up(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(int(g), float(p), int(rng.random() < p)) for g, p in zip(rng.integers(0, 3, 500), rng.uniform(0, 1, 500).round(2))], "g int, prediction double, y int")
    whole = metrics.prediction_metrics(df, ["g"]).orderBy("g").collect()
    parts = metrics.prediction_table(df.limit(200), ["g"]).union(metrics.prediction_table(df.exceptAll(df.limit(200)), ["g"]))
    merged = metrics.table_metrics(metrics._merged(parts, ["g"]), ["g"]).select(*whole[0].asDict()).orderBy("g").collect()
    for a, b in zip(whole, merged):
        assert [x if isinstance(x, (int, str)) else pytest.approx(x, abs=1e-9) for x in b] == list(a)
    basic = metrics.basic_metrics(df, ["g"]).orderBy("g").collect()
    ece = metrics.calibration_error(df, ["g"]).orderBy("g").collect()
    for a, b, c in zip(whole, basic, ece):
        assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in b.asDict()) and a.ece_equal_width == pytest.approx(c.ece_equal_width, abs=1e-12)


def test_auc_with_ties_and_hot_group(spark, conf):
    rng = np.random.default_rng(4)
    p, y = np.round(rng.random(400), 2), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(0, float(a), int(b)) for a, b in zip(p, y)], "g int, prediction double, y int")
    wins = ((p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])).mean()
    assert metrics.area_under_curve(df, ["g"]).first().auc == pytest.approx(wins, abs=1e-12)
    conf("spark.tracewell.taskRows", "10")
    assert metrics.area_under_curve(df, ["g"]).first().auc == pytest.approx(wins, abs=1e-12)


def test_model_selection_rules(spark):
    scores = spark.createDataFrame(
        [(s, m, "calibration", "all", loss) for s, pair in {1: (0.6, 0.6), 2: (0.6, 0.59), 3: (0.6, 0.59999)}.items() for m, loss in zip(("BKT", "BKT-F"), pair)],
        "skill_id int, model string, split string, sample_class string, log_loss double",
    )
    fits = spark.createDataFrame([(s, "BKT-F", 0.01, True) for s in (1, 2, 3)], "skill_id int, model string, lambda_per_day double, optimizer_success boolean")
    found = {r.skill_id: (r.preferred_by_calibration_log_loss, r.forgetting_supported_conservative) for r in metrics.model_selection(scores, fits).collect()}
    assert found == {1: ("BKT", False), 2: ("BKT-F", True), 3: ("BKT-F", False)}


def test_published_model_difference(spark):
    """Held-out values of both models on the published test learners, and their differences."""
    rows = [("BKT", "test", "all", 0.635403429228529, 0.594429770519676, 0.2221050864835672), ("BKT-F", "test", "all", 0.6344797526768551, 0.598031953017336, 0.2217145636317173)]
    names = ["micro_weighted_log_loss", "micro_weighted_auc", "micro_weighted_brier"]
    table = spark.createDataFrame(rows, "model string, split string, sample_class string, " + ", ".join(f"{n} double" for n in names))
    found = {r.metric: r.BKT_F_minus_BKT for r in metrics.model_difference(table).collect()}
    assert found == pytest.approx(dict(zip(names, (-0.0009236765516739132, 0.003602182497659978, -0.00039052285184990043))), abs=1e-12)


def test_predictions_have_the_bits_of_the_formula():
    """Rounded predictions are ranked, so a last bit may part two ties: no rearranged operations."""
    rng = np.random.default_rng(11)
    gaps, y = rng.integers(0, 10**9, 400), rng.integers(0, 2, 400)
    p_init, learn, slip, guess, rate = 0.3, 0.1, 0.1, 0.2, 0.02
    found = R.forward(np.array([p_init]), np.array([0]), np.array([400]), gaps.astype(float), y, *[np.array([v]) for v in (learn, slip, guess, rate)])
    state = p_init
    for i in range(400):
        before = state * np.exp(-rate * float(gaps[i]) / 86400000.0)
        known = before * (1 - slip if y[i] else slip)
        state = learn + (1 - learn) * known / (known + (1 - before) * (guess if y[i] else 1 - guess))
        assert found[0][i] == guess + before * (1 - slip - guess) and found[1][i] == state

def test_calibration_line_of_steep_groups(spark):
    """Outcomes that a threshold nearly separates: the line is steep, and its cells are the values themselves."""
    rng = np.random.default_rng(8)
    p = 0.5 + 0.02 * (rng.random((6, 40)) - 0.5)
    y = (p + 0.002 * rng.standard_normal(p.shape) > 0.5).astype(int)
    rows = [(g, float(a), int(b)) for g in range(6) for a, b in zip(p[g], y[g])]
    df = spark.createDataFrame(rows, "g int, prediction double, y int")
    for found in (metrics.calibration_line(df, ["g"]).collect(), metrics.prediction_metrics(df, ["g"]).collect()):
        assert len(found) == 6
        for r in found:
            intercept, slope, status = newton(np.log(p[r.g] / (1 - p[r.g])), y[r.g])
            assert r.calibration_fit_status == status
            assert r.calibration_intercept == pytest.approx(intercept, rel=1e-6, abs=1e-5)
            assert r.calibration_slope == pytest.approx(slope, rel=1e-6)


def test_selection_reads_the_calibration_losses_of_the_full_evaluation(spark):
    sf = "/root/testdata/sf0.01"
    full = metrics.evaluate_models(M.labelled(spark, sf)).where("split = 'calibration' and sample_class = 'all'")
    sequences = materialise(V.sequences(spark, sf))
    found = M.calibration_losses(sequences, M.fixed_parameters(sequences)).collect()
    assert {(r.skill_id, r.model): pytest.approx(r.log_loss, abs=1e-12) for r in found} == {(r.skill_id, r.model): r.log_loss for r in full.collect()}


def test_searches_that_meet_go_on_as_one():
    """The better of two near searches of a model stays; other models, skills and distant points are kept."""
    skills, forgetting = np.array([1, 1, 1, 1, 2, 1]), np.array([False, False, False, True, False, False])
    search = fit._Searches(None, skills, forgetting, fit.FitConfig())
    z = np.zeros((6, 5))
    z[1] += 0.5 * fit.SAME_POINT
    z[2] += 1.0
    z[0, 4] = 3.0  # the rate of plain BKT doesn't count
    nll = np.array([10.0, 9.0, 8.0, 9.0, 9.0, np.inf])
    assert search.met(z, nll, np.ones(6, bool)).tolist() == [0]
    assert search.met(z, nll, np.array([False, True, True, True, True, False])).tolist() == []


def test_blocks_hold_every_event_and_give_the_plain_likelihood(spark):
    """Sequences of several lengths and skills, packed step by step, against the plain recursion; also its slopes."""
    events = synthetic(spark, 60, 40).selectExpr("learner_id", "cast(learner_id % 2 as int) as skill_id", "within_skill_index", "gap_ms", "is_correct").where("within_skill_index < 1 + learner_id % 39")
    stored = {}
    for r in events.collect():
        stored.setdefault((r.skill_id, r.learner_id), []).append((r.within_skill_index, r.gap_ms / 86_400_000, r.is_correct))
    training = fit.Training.of(bkt.sequence_pieces(events, KEYS))
    packed = training.blocks.collect()
    assert {s: sum(b.events for b in packed if b.skill_id == s) for s in (0, 1)} == {s: sum(len(v) for k, v in stored.items() if k[0] == s) for s in (0, 1)}
    assert sum(b.sequences for b in packed) == 60 and len(packed) < 60
    firsts = {s: np.mean([min(v)[2] for k, v in stored.items() if k[0] == s]) for s in (0, 1)}
    assert {r.skill_id: r.first_rate for r in training.facts().collect()} == pytest.approx(firsts)

    def nll(skill, p):
        total = 0.0
        for key, seq in stored.items():
            seq = sorted(seq)
            if key[0] == skill:
                total -= sum(np.log(q if hit else 1 - q) for (q, _), (_, _, hit) in zip(one_sequence([e[1] for e in seq], [e[2] for e in seq], p), seq))
        return total

    points = np.array([[0.3, 0.1, 0.1, 0.2, 0.0], [0.4, 0.2, 0.15, 0.25, 0.05], [0.3, 0.1, 0.1, 0.2, 1.5]])
    for r in fit.likelihood(training, {0: points, 1: points[:2]}).collect():
        p = points[r.candidate]
        assert r.nll == pytest.approx(nll(r.skill_id, p), rel=1e-10)
        for i in range(4 if p[4] == 0 else 5):
            shift = 1e-6 * np.eye(5)[i]
            assert (nll(r.skill_id, p + shift) - nll(r.skill_id, p - shift)) / 2e-6 == pytest.approx(r[f"g{i}"], rel=1e-5, abs=1e-4)


def test_chances_are_clipped_only_where_they_can_reach_the_limit():
    rng = np.random.default_rng(6)
    steps = [(rng.uniform(0, 5, n), rng.choice([0.5, -0.5], n)) for n in (7, 7, 5, 2) for _ in range(9)]
    p = np.array([[0.3, 0.1, 0.1, 0.2, 0.02], [0.9, 0.4, 1e-9, 0.3, 0.5]])
    assert fit._inside(p) and not fit._inside(p - 1e-10)
    start, rest = np.repeat(p[:, :1], 7, axis=1), p.T[1:, :, None]
    for plain, clipped in zip(R.step_major(start, steps, *rest, clip=False), R.step_major(start, steps, *rest)):
        assert np.allclose(plain, clipped, rtol=1e-9, atol=1e-9)
    certain = np.array([[1.0, 0.5, 0.0, 0.0, 0.0]])  # an impossible answer costs the logarithm of the limit
    value, gradient = R.step_major(np.ones((1, 1)), [(np.zeros(1), np.full(1, -0.5))], *certain.T[1:, :, None])
    assert value[0, 0] == pytest.approx(-np.log(R.TINY)) and np.isfinite(gradient).all()


def test_search_takes_two_points_a_step(monkeypatch):
    """A search through a curved valley with few evaluations, each of which reads every event of a skill."""
    spent = []

    def evaluate(self, owner, z):
        spent.append(len(z))
        a, b = z[:, 0], z[:, 1]
        r = np.stack([1.0 - a, 10.0 * (b - a * a)], axis=1)
        j = np.zeros((len(z), 2, 5))
        j[:, 0, 0], j[:, 1, 0], j[:, 1, 1] = -1.0, -20.0 * a, 10.0
        return 0.5 * (r**2).sum(axis=1), np.einsum("nr,nrp->np", r, j), np.einsum("nri,nrj->nij", j, j)

    monkeypatch.setattr(fit._Searches, "evaluate", evaluate)
    search = fit._Searches(None, np.array([1]), np.array([False]), fit.FitConfig())
    z, nll, _, _, good = search.descend(np.array([[-1.2, 1.0, 0.0, 0.0, 0.0]]))
    assert good[0] and z[0, :2] == pytest.approx([1.0, 1.0], abs=1e-5) and nll[0] < 1e-9
    assert max(spent) == 2 and sum(spent) < 80


def test_sequences_read_the_questions_once(spark, monkeypatch):
    """The questions come from all events, so a build derives and stores them once."""
    calls, whole = [], V.raw_questions
    monkeypatch.setattr(V, "raw_questions", lambda *a: calls.append(a) or whole(*a))
    assert V.sequences(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
