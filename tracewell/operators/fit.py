"""Distributed fitting of the knowledge-tracing models.

Every search (skill, model, start) advances in lock-step: the driver keeps five numbers per
search, and one Spark job per step evaluates the likelihood, its gradient and the summed
outer products of per-sequence gradients for all trial points of all searches. Steps are
damped Gauss-Newton on the bounded raw scale; the winners are polished with a Hessian from
gradient differences, which also gives the standard errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import recursion as R
from tracewell.functions.numeric import MAX_EMISSION_ERROR, half_life
from tracewell.operators.bkt import _flat, is_long
from tracewell.operators.skew import materialise

NAMES = R.PARAMETERS
# Starting points (p_init, p_learn, slip, guess, lambda_per_day) after the first.
STARTS = [
    (0.20, 0.10, 0.10, 0.20, 0.005),
    (0.35, 0.15, 0.10, 0.25, 0.010),
    (0.50, 0.20, 0.15, 0.20, 0.030),
    (0.25, 0.30, 0.05, 0.30, 0.080),
    (0.60, 0.08, 0.20, 0.15, 0.150),
    (0.40, 0.35, 0.08, 0.10, 0.300),
    (0.15, 0.20, 0.20, 0.30, 0.600),
    (0.70, 0.05, 0.05, 0.25, 1.000),
    (0.30, 0.45, 0.15, 0.10, 0.020),
    (0.55, 0.25, 0.25, 0.20, 0.100),
    (0.05, 0.12, 0.08, 0.35, 0.400),
]
# The first start (p_learn, slip, guess, lambda_per_day), and the range of its p_init.
FIRST_START = (0.12, 0.10, 0.20, 0.03)
FIRST_P_INIT = (0.03, 0.90)
# Largest values of the four probabilities.
CAPS = np.array([1.0, 1.0, MAX_EMISSION_ERROR, MAX_EMISSION_ERROR])
# Event steps times candidates that one evaluation holds.
TRACE = 4_000_000
# Most sequences and events of a block, and sequences times candidates of one array, so that a step stays in a core's cache.
BLOCK_SEQUENCES = 4_096
BLOCK_EVENTS = 65_536
# Fewest sequences that a block is cut to for the sake of more tasks.
LEAST_SEQUENCES = 256
ARRAY = 4_096
_TRIANGLE = [(i, j) for i in range(5) for j in range(i, 5)]
_SUMS = ["nll", *[f"g{i}" for i in range(5)], *[f"h{i}{j}" for i, j in _TRIANGLE]]
_LEVEL = 256
# Trial points of a step: the damping a tenth and ten times what it was; without a gain it grows by DAMP_MORE.
DAMPING = np.array([0.1, 10.0])
DAMP_MORE = 1e2
# Largest difference of raw parameters at which two searches of one model count as one.
SAME_POINT = 0.02


@dataclass(frozen=True)
class FitConfig:
    starts_bkt: int = 8
    starts_bktf: int = 12
    max_steps: int = 350
    polish_steps: int = 6
    ftol: float = 1e-11
    gtol: float = 1e-6
    lambda_min: float = 1e-8
    lambda_max: float = 10.0
    raw_bound: float = 9.0
    skills_per_block: int = 200


def to_natural(z: np.ndarray, forgetting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural parameters and their derivatives with respect to the raw ones (rows of 5).

    A probability is its cap times the logistic function of z; the rate is exp(z)."""
    share = 1.0 / (1.0 + np.exp(-z[:, :4]))
    natural, slope = np.zeros_like(z), np.zeros_like(z)
    natural[:, :4], slope[:, :4] = CAPS * share, CAPS * share * (1.0 - share)
    natural[forgetting, 4] = slope[forgetting, 4] = np.exp(z[forgetting, 4])
    return natural, slope


def to_raw(natural: np.ndarray, config: FitConfig) -> np.ndarray:
    """The raw parameters of rows of natural ones."""
    share = np.clip(natural[:, :4] / CAPS, 1e-8, 1.0 - 1e-8)
    rate = np.clip(natural[:, 4:], config.lambda_min, config.lambda_max)
    return np.hstack([np.log(share / (1.0 - share)), np.log(rate)])


def _groups(skills: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(skill, rows with the longest first) of every skill."""
    for s in np.unique(skills):
        rows = np.flatnonzero(skills == s)
        yield int(s), rows[R.longest_first(length[rows])]


def _blocks(skills: np.ndarray, candidates: dict[int, np.ndarray], length: np.ndarray):
    """(skill, first candidate, candidates, sequences longest first) in pieces of bounded size."""
    for s, rows in _groups(skills, length):
        points = candidates.get(s)
        if points is None:
            continue
        width = max(1, TRACE // max(1, int(length[rows].sum())))
        for at in range(0, len(points), width):
            yield s, at, points[at : at + width], rows


_BLOCK_SCHEMA = "skill_id int, events long, sequences long, first_right long, running binary, days binary, answers binary"


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Whole sequences as blocks of one skill and at most ``most`` sequences, laid out step by step: the numbers of sequences that run at
    each step, and the days and answers of step 0, then of step 1, and so on."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, first, length, days, y, _ = _flat(batch)
        out = []
        for skill, rows in _groups(np.asarray(batch.column("skill_id")), length):
            parts = max(-(-len(rows) // most), -(-int(length[rows].sum()) // BLOCK_EVENTS))
            out += [(skill, *_laid_out(first[part], length[part], days, y)) for part in np.array_split(rows, parts)]
        names = [c.split()[0] for c in _BLOCK_SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _laid_out(first: np.ndarray, length: np.ndarray, days: np.ndarray, y: np.ndarray) -> tuple:
    steps = [first[:n] + t for t, n in R.running(length)]
    at = np.concatenate(steps)
    right = (y[at] > 0).astype("u1")
    running = np.array([len(s) for s in steps], "<i4")
    return len(at), len(first), int(right[: len(first)].sum()), running.tobytes(), days[at].astype("<f8").tobytes(), right.tobytes()


def _steps_of(block: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Days and answers (0.5 or -0.5) of each step of a block."""
    cuts = np.cumsum(np.frombuffer(block["running"], "<i4"))[:-1]
    half = np.frombuffer(block["answers"], "u1") - 0.5
    return list(zip(np.split(np.frombuffer(block["days"], "<f8"), cuts), np.split(half, cuts)))


def _inside(points: np.ndarray) -> bool:
    """Whether no chance of an answer can come near 0 or 1 at these parameters."""
    edge = np.array([0.0, 0.0, 1e-9, 1e-9])
    return bool(((points[:, :4] >= edge) & (points[:, :4] <= 1.0 - edge)).all() and (points[:, 4] >= 0).all())


def _evaluate(batches: Iterator[pa.RecordBatch], candidates: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Likelihood sums of blocks of whole sequences; one output row per (skill, candidate) and task."""
    sums = {s: np.zeros((len(points), len(_SUMS))) for s, points in candidates.items()}
    seen = set()
    upper = np.array([5 * i + j for i, j in _TRIANGLE])
    for batch in batches:
        for i in range(batch.num_rows):
            block = {c: batch.column(c)[i].as_py() for c in ("skill_id", "sequences", "events", "running")}
            block |= {c: batch.column(c)[i].as_buffer() for c in ("days", "answers")}
            points, total = candidates[block["skill_id"]], sums[block["skill_id"]]
            seen.add(block["skill_id"])
            steps, n = _steps_of(block), block["sequences"]
            width = max(1, min(ARRAY // n, TRACE // max(1, block["events"])))
            clip = not (_inside(points) and all((days >= 0).all() for days, _ in steps))
            for chosen in (np.flatnonzero(points[:, 4] == 0), np.flatnonzero(points[:, 4] != 0)):
                for low in range(0, len(chosen), width):
                    rows = chosen[low : low + width]
                    p = points[rows].T[:, :, None]
                    nll, g = R.step_major(np.repeat(p[0], n, axis=1), steps, *p[1:], clip=clip)
                    g = np.ascontiguousarray(g.transpose(1, 0, 2))
                    outer = (g @ g.transpose(0, 2, 1)).reshape(len(rows), 25)
                    total[rows] += np.hstack([nll.sum(axis=1)[:, None], g.sum(axis=2), outer[:, upper]])
    yield _sum_batch({(s, k): sums[s][k] for s in seen for k in range(len(sums[s]))})


def _sum_batch(sums: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    keys = list(sums)
    table = np.array([sums[k] for k in keys]).reshape(len(keys), len(_SUMS))
    columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32())]
    columns += [pa.array(table[:, i], pa.float64()) for i in range(len(_SUMS))]
    return pa.RecordBatch.from_arrays(columns, names=["skill_id", "candidate", *_SUMS])


_PIECE_VALUES = [f"{kind}{s}" for s in range(2) for kind in ("nll", "end")]
_PIECE_SLOPES = [f"{kind}{s}_{i}" for s in range(2) for kind in ("dn", "de") for i in range(5)]
_PIECE_COLUMNS = [*_PIECE_VALUES, *_PIECE_SLOPES]


def _evaluate_pieces(batches: Iterator[pa.RecordBatch], candidates: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    """Effect of each piece of a long sequence on start states 1 and 0, per candidate."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, first, length, days, y, _ = _flat(batch)
        for _, at, points, rows in _blocks(np.asarray(batch.column("skill_id")), candidates, length):
            n, m = len(rows), len(points)
            seq, p = np.repeat(rows, m), np.tile(points, (n, 1))
            out = {c: np.asarray(batch.column(c))[seq] for c in ("learner_id", "skill_id", "piece")}
            out["candidate"] = np.tile(np.arange(at, at + m, dtype=np.int32), n)
            for s, start in enumerate((1.0, 0.0)):
                inputs = (np.full(n * m, start), first[seq], length[seq], days, y, *p[:, 1:].T)
                nll, dn = R.adjoint(*inputs)
                end, de = R.adjoint(*inputs, likelihood=False)
                dn[:, 0] = de[:, 0] = 0.0  # the start state of a piece is fixed here
                out[f"nll{s}"], out[f"end{s}"] = nll, end
                for i in range(5):
                    out[f"dn{s}_{i}"], out[f"de{s}_{i}"] = dn[:, i], de[:, i]
            columns = ["learner_id", "skill_id", "candidate", "piece", *_PIECE_COLUMNS]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out)[columns], preserve_index=False)


def _as_piece(row) -> dict:
    slopes = lambda kind: np.array([[row[f"{kind}{s}_{i}"] for i in range(5)] for s in range(2)])
    return {
        "nll": np.array([row["nll0"], row["nll1"]]), "end": np.array([row["end0"], row["end1"]]),
        "d_nll": slopes("dn"), "d_end": slopes("de"),
    }


def _chain_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("piece")
    pieces = [_as_piece(row) for row in pdf.to_dict("records")]
    total = pieces[0]
    for piece in pieces[1:]:
        total = R.chain(total, piece)
    head = pdf.iloc[0]
    out = {c: [head[c]] for c in ("learner_id", "skill_id", "candidate")}
    out["piece"] = [int(head["piece"]) // _LEVEL]
    for s in range(2):
        out[f"nll{s}"], out[f"end{s}"] = [total["nll"][s]], [total["end"][s]]
        for i in range(5):
            out[f"dn{s}_{i}"], out[f"de{s}_{i}"] = [total["d_nll"][s, i]], [total["d_end"][s, i]]
    return pd.DataFrame(out)[["learner_id", "skill_id", "candidate", "piece", *_PIECE_COLUMNS]]


def _finish_long(batches: Iterator[pa.RecordBatch], candidates: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Enter each whole long sequence at its candidate's p_init and sum."""
    sums: dict[tuple, np.ndarray] = {}
    unit = np.eye(5)[0]
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["skill_id"], row["candidate"])
            nll, gradient, _, _ = R.enter(candidates[key[0]][key[1]][0], unit, _as_piece(row))
            outer = np.outer(gradient, gradient)
            sums[key] = sums.get(key, 0.0) + np.array([nll, *gradient, *[outer[i, j] for i, j in _TRIANGLE]])
    yield _sum_batch(sums)


@dataclass
class Training:
    """Stored training sequences and what the searches need to know about them.

    Whole sequences are packed in blocks once; only pieces of long ones stay rows."""

    blocks: DataFrame
    pieces: DataFrame
    last_piece: int
    has_long: bool

    @classmethod
    def of(cls, pieces: DataFrame) -> Training:
        columns = pieces.select("learner_id", F.col("skill_id").cast("int").alias("skill_id"), "piece", "events")
        # In the order of skills, so that blocks are full and a step's filter on the live skills skips the others'
        # row groups, and of lengths, so that the sequences of a block end together.
        stored = materialise(columns.sortWithinPartitions("skill_id", F.size("events").desc()))
        row = stored.agg(F.max("piece"), F.max(is_long(stored).cast("int")), F.count(F.lit(1))).first()
        # Evenly over the cores, since every step waits for its last task.
        tasks = stored.sparkSession.sparkContext.defaultParallelism
        most = min(BLOCK_SEQUENCES, max(LEAST_SEQUENCES, row[2] // (2 * tasks)))
        packed = stored.where(~is_long(stored)).mapInArrow(lambda it: _pack(it, most), _BLOCK_SCHEMA)
        blocks = materialise(packed.repartition(tasks).sortWithinPartitions("skill_id"))
        return cls(blocks, stored, row[0] or 0, bool(row[1]))

    def facts(self) -> DataFrame:
        """Events, sequences and the rate of right first answers of each skill."""
        parts = self.blocks.select("skill_id", "events", "sequences", "first_right")
        if self.has_long:
            first = F.col("piece") == 0
            pieces = self.pieces.where(is_long(self.pieces)).select(
                "skill_id", F.size("events").cast("long").alias("events"), first.cast("long").alias("sequences"),
                F.when(first, F.get("events", F.lit(0)).y).otherwise(0).cast("long").alias("first_right"),
            )
            parts = parts.unionByName(pieces)
        totals = parts.groupBy("skill_id").agg(*[F.sum(c).alias(c) for c in ("events", "sequences", "first_right")])
        return totals.select("skill_id", "events", "sequences", (F.col("first_right") / F.col("sequences")).alias("first_rate"))


def likelihood(training: Training, candidates: dict[int, np.ndarray]) -> DataFrame:
    """Likelihood sums per (skill_id, candidate): nll, gradient g0..g4, outer products h00..h44.

    ``candidates`` maps a skill to rows of natural parameters; it travels with the tasks, so
    callers keep it to one block of skills."""
    schema = "skill_id int, candidate int, " + ", ".join(f"{c} double" for c in _SUMS)
    live = F.col("skill_id").isin(sorted(candidates))
    columns = ["skill_id", "sequences", "events", "running", "days", "answers"]
    sums = training.blocks.where(live).select(*columns).mapInArrow(lambda it: _evaluate(it, candidates), schema)
    if training.has_long:
        pieces = training.pieces.where(live & is_long(training.pieces))
        piece_schema = "learner_id long, skill_id int, candidate int, piece int, " + ", ".join(f"{c} double" for c in _PIECE_COLUMNS)
        parts = pieces.mapInArrow(lambda it: _evaluate_pieces(it, candidates), piece_schema)
        last = training.last_piece
        while True:
            key = F.floor(F.col("piece") / _LEVEL).alias("level")
            parts = parts.groupBy("learner_id", "skill_id", "candidate", key).applyInPandas(_chain_group, piece_schema)
            if last < _LEVEL:
                break
            last //= _LEVEL
        sums = sums.unionByName(parts.mapInArrow(lambda it: _finish_long(it, candidates), schema))
    return sums.groupBy("skill_id", "candidate").agg(*[F.sum(c).alias(c) for c in _SUMS])


class _Searches:
    """Driver-side state of all searches of one block: rows of raw parameters."""

    def __init__(self, training: Training, skills: np.ndarray, forgetting: np.ndarray, config: FitConfig):
        self.training, self.skills, self.forgetting, self.config = training, skills, forgetting, config
        bound = np.full(5, config.raw_bound)
        self.low, self.high = -bound, bound.copy()
        self.low[4], self.high[4] = math.log(config.lambda_min), math.log(config.lambda_max)

    def evaluate(self, owner: np.ndarray, z: np.ndarray):
        """(nll, raw gradient, raw outer products) of trial rows; ``owner`` is their search."""
        natural, chain = to_natural(z, self.forgetting[owner])
        skills = self.skills[owner]
        candidates, where = {}, {}
        for s in np.unique(skills):
            rows = np.flatnonzero(skills == s)
            candidates[int(s)] = natural[rows]
            where[int(s)] = rows
        nll, g, h = np.full(len(z), np.inf), np.zeros((len(z), 5)), np.zeros((len(z), 5, 5))
        for r in likelihood(self.training, candidates).collect():  # a row per trial point
            k = where[r["skill_id"]][r["candidate"]]
            nll[k] = r["nll"]
            g[k] = [r[f"g{i}"] for i in range(5)]
            for i, j in _TRIANGLE:
                h[k, i, j] = h[k, j, i] = r[f"h{i}{j}"]
        return nll, g * chain, h * chain[:, :, None] * chain[:, None, :]

    def free(self, k: int, z: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Parameters that may move: not the rate of plain BKT, not pushed against a bound."""
        held = ((z <= self.low) & (g > 0)) | ((z >= self.high) & (g < 0))
        held[4] |= not self.forgetting[k]
        return ~held

    def steps(self, k: int, z: np.ndarray, g: np.ndarray, h: np.ndarray, damping) -> np.ndarray:
        free = self.free(k, z, g)
        out = np.repeat(z[None, :], len(damping), axis=0)
        if free.any():
            sub, scale = h[np.ix_(free, free)], np.maximum(np.diag(h)[free], 1e-8)
            for i, mu in enumerate(damping):
                move = np.linalg.lstsq(sub + mu * np.diag(scale), -g[free], rcond=None)[0]
                out[i, free] += np.clip(move, -3.0, 3.0)
        return np.clip(out, self.low, self.high)

    def descend(self, z: np.ndarray):
        """Damped Gauss-Newton on every search until its improvement or gradient is small."""
        n = len(z)
        nll, g, h = self.evaluate(np.arange(n), z)
        mu, done, good, taken = np.full(n, 1e-2), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, int)
        for _ in range(self.config.max_steps):
            live = np.flatnonzero(~done)
            if not len(live):
                break
            trial = np.concatenate([self.steps(k, z[k], g[k], h[k], mu[k] * DAMPING) for k in live])
            owner = np.repeat(live, len(DAMPING))
            t_nll, t_g, t_h = self.evaluate(owner, trial)
            for i, k in enumerate(live):
                rows = slice(i * len(DAMPING), (i + 1) * len(DAMPING))
                best = i * len(DAMPING) + int(np.argmin(np.where(np.isfinite(t_nll[rows]), t_nll[rows], np.inf)))
                gain = nll[k] - t_nll[best]
                taken[k] += 1
                if gain > 0:
                    mu[k] = max(1e-8, mu[k] * DAMPING[best - i * len(DAMPING)])
                    z[k], nll[k], g[k], h[k] = trial[best], t_nll[best], t_g[best], t_h[best]
                else:
                    mu[k] *= DAMP_MORE
                small = np.max(np.abs(g[k][self.free(k, z[k], g[k])]), initial=0.0) < self.config.gtol
                good[k] = small or 0 < gain <= self.config.ftol * max(1.0, abs(nll[k]))
                done[k] = good[k] or mu[k] > 1e12  # beyond that the search is stuck, which is no success
            met = self.met(z, nll, ~done)
            done[met], nll[met] = True, np.inf
        return z, nll, g, taken, good

    def met(self, z: np.ndarray, nll: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Live searches within ``SAME_POINT`` of a better one of their skill and model, which goes on
        for both (or has ended there). Of equal ones the first goes on."""
        out = []
        groups = np.unique(np.stack([self.skills, self.forgetting]), axis=1, return_inverse=True)[1].ravel()
        for group in np.unique(groups[live]):
            kept = []
            rows = np.flatnonzero((groups == group) & np.isfinite(nll))
            for k in rows[np.argsort(nll[rows], kind="stable")]:
                size = 5 if self.forgetting[k] else 4
                if live[k] and any(np.max(np.abs(z[k, :size] - z[j, :size])) <= SAME_POINT for j in kept):
                    out.append(k)
                else:
                    kept.append(k)
        return np.array(out, int)

    def hessian(self, rows: np.ndarray, z: np.ndarray):
        """Hessian of every row from gradients on either side along each axis: one job."""
        width = 1e-4 * np.maximum(1.0, np.abs(z))
        shifts = width[:, :, None] * np.eye(5)
        points = np.stack([z[:, None, :] + shifts, z[:, None, :] - shifts])
        _, g, _ = self.evaluate(np.tile(np.repeat(rows, 5), 2), points.reshape(-1, 5))
        above, below = g.reshape(2, len(z), 5, 5)
        curve = (above - below) / (2.0 * width[:, :, None])
        return (curve + curve.transpose(0, 2, 1)) / 2.0

    def polish(self, rows: np.ndarray, z: np.ndarray, nll: np.ndarray, g: np.ndarray):
        """Newton steps with the difference Hessian; returns it at the final point."""
        h = self.hessian(rows, z)
        factors = np.array([0.0, 1e-3, 1e-1])
        for _ in range(self.config.polish_steps):
            norms = [np.max(np.abs(g[k][self.free(rows[k], z[k], g[k])]), initial=0.0) for k in range(len(z))]
            if max(norms) < self.config.gtol:
                break
            trial = np.concatenate([self.steps(rows[k], z[k], g[k], h[k], factors) for k in range(len(z))])
            t_nll, t_g, _ = self.evaluate(np.repeat(rows, len(factors)), trial)
            moved = False
            for k in range(len(z)):
                best = k * len(factors) + int(np.argmin(t_nll[k * len(factors) : (k + 1) * len(factors)]))
                if t_nll[best] < nll[k]:
                    moved = moved or nll[k] - t_nll[best] > 1e-13 * abs(nll[k])
                    z[k], nll[k], g[k] = trial[best], t_nll[best], t_g[best]
            if not moved:
                break
            h = self.hessian(rows, z)
        return z, nll, g, h


def _starting_points(first_rate: float, forgetting: bool, config: FitConfig) -> np.ndarray:
    """Raw starting points: one that explains the rate of correct first answers, then STARTS."""
    learn, slip, guess, rate = FIRST_START
    explained = (first_rate - guess) / (1.0 - slip - guess)
    first = (min(max(explained, FIRST_P_INIT[0]), FIRST_P_INIT[1]), learn, slip, guess, rate)
    return to_raw(np.array([first, *STARTS])[: config.starts_bktf if forgetting else config.starts_bkt], config)


def _errors(h: np.ndarray, slope: np.ndarray, k: int) -> tuple[list, str]:
    """Standard errors of the first k natural parameters: with H = L L', the covariance of
    the raw ones is the square of L's inverse, and ``slope`` carries it over."""
    information = h[:k, :k]
    if not np.isfinite(information).all():
        return [None] * 5, "failed"
    try:
        np.linalg.cholesky(information - 1e-8 * np.eye(k))  # smallest eigenvalue above 1e-8
        spread = np.linalg.solve(np.linalg.cholesky(information), np.diag(slope[:k]))
    except np.linalg.LinAlgError:
        return [None] * 5, "not_positive_definite"
    return [*np.sqrt((spread**2).sum(axis=0)).tolist(), *[None] * (5 - k)], "positive_definite"


FIT_SCHEMA = (
    "skill_id int, model string, optimizer_success boolean, n_train_events long, n_train_sequences long, nll_train double, "
    "n_parameters int, n_iterations int, gradient_inf_norm double, hessian_status string, p_init double, p_learn double, slip double, "
    "guess double, lambda_per_day double, " + ", ".join(f"se_{p}_approx double" for p in NAMES)
)


def fit_models(pieces: DataFrame, config: FitConfig = FitConfig()) -> DataFrame:
    """Fit BKT and BKT-F to every skill of ``pieces``; one row per (skill, model).

    Skills are taken in blocks so that the driver and the tasks hold a bounded number of
    parameter vectors at a time."""
    training = Training.of(pieces)
    spark = pieces.sparkSession
    facts = materialise(training.facts())
    out, low = [], None
    while True:
        rest = facts if low is None else facts.where(F.col("skill_id") > low)
        block = rest.orderBy("skill_id").limit(config.skills_per_block).collect()
        if not block:
            break
        low = block[-1]["skill_id"]
        out.append(spark.createDataFrame(_fit_block(training, block, config), FIT_SCHEMA))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return with_criteria(result)


def _fit_block(training: Training, block: list, config: FitConfig) -> list[tuple]:
    skills, forgetting, z = [], [], []
    for r in block:
        for f in (False, True):
            for point in _starting_points(r["first_rate"], f, config):
                skills.append(r["skill_id"])
                forgetting.append(f)
                z.append(point)
    search = _Searches(training, np.array(skills), np.array(forgetting), config)
    z, nll, g, taken, good = search.descend(np.array(z))
    if not np.isfinite(nll).any():
        raise FloatingPointError("no start has a finite likelihood")
    nll = np.where(np.isfinite(nll), nll, np.inf)
    best = []
    for r in block:
        for f in (False, True):
            rows = np.flatnonzero((search.skills == r["skill_id"]) & (search.forgetting == f))
            best.append(rows[np.argmin(nll[rows])])
    best = np.array(best)
    zb, nb, gb, h = search.polish(best, z[best].copy(), nll[best].copy(), g[best].copy())
    natural, chain = to_natural(zb, search.forgetting[best])
    facts = {r["skill_id"]: r for r in block}
    rows = []
    for i, k in enumerate(best):
        f = bool(search.forgetting[k])
        size = 5 if f else 4
        se, status = _errors(h[i], chain[i], size)
        free = search.free(k, zb[i], gb[i])
        norm = float(np.max(np.abs(gb[i][free]), initial=0.0))
        fact = facts[int(search.skills[k])]
        success = bool(good[k] or norm < 1e-3)
        rows.append(
            (int(search.skills[k]), "BKT-F" if f else "BKT", success, fact["events"], fact["sequences"], float(nb[i]), size,
             int(taken[k]), norm, status, *[float(x) for x in natural[i]], *se)
        )
    return rows


def with_criteria(fits: DataFrame) -> DataFrame:
    """Add per-event loss, AIC, BIC and the retention half-life."""
    k, n, nll = F.col("n_parameters"), F.col("n_train_events"), F.col("nll_train")
    return fits.withColumns(
        {
            "log_loss_train_objective": nll / n,
            "aic_train": 2 * k + 2 * nll,
            "bic_train": k * F.ln(n) + 2 * nll,
            "retention_half_life_days": half_life(F.col("lambda_per_day")),
        }
    )
