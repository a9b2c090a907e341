"""Knowledge-tracing recursion over many sequences at once, for use inside tasks.

Sequences are ragged: ``first`` and ``length`` index flat event arrays, longest first, so
that step ``t`` touches one leading slice. Parameters are arrays with one entry per sequence.
"""

from __future__ import annotations

import numpy as np

from tracewell.functions.cleaning import DAY_MS

TINY = 1e-12
# Factors of at least TINY whose product is a normal number.
PRODUCT = 16
PARAMETERS = ("p_init", "p_learn", "slip", "guess", "lambda_per_day")


def longest_first(length: np.ndarray) -> np.ndarray:
    return np.argsort(-length, kind="stable")


def running(length: np.ndarray):
    """(step, number of sequences still running)."""
    ascending = np.sort(length)
    n = len(length)
    for t in range(int(length[0]) if n else 0):
        yield t, n - int(np.searchsorted(ascending, t, side="right"))


def _chances(right, slip, guess):
    """Probability of the observed answer with and without mastery."""
    return np.where(right, 1.0 - slip, slip), np.where(right, guess, 1.0 - guess)


def forward(start, first, length, gap_ms, y, learn, slip, guess, rate):
    """Predictions and states after each event (flat arrays), last states and log-likelihoods.

    Operations are in the order of the formula, without rearrangement, so that another engine
    that evaluates it gets the same bits."""
    state, total = start.astype(float).copy(), np.zeros(len(start))
    prediction, after = np.empty(len(y)), np.empty(len(y))
    for t, n in running(length):
        at = first[:n] + t
        right = y[at] > 0
        before = state[:n] * np.exp(-rate[:n] * gap_ms[at] / DAY_MS)
        p = np.clip(guess[:n] + before * (1.0 - slip[:n] - guess[:n]), TINY, 1.0 - TINY)
        with_, without = _chances(right, slip[:n], guess[:n])
        known = before * with_
        state[:n] = learn[:n] + (1.0 - learn[:n]) * known / np.maximum(known + (1.0 - before) * without, TINY)
        prediction[at], after[at] = p, state[:n]
        total[:n] += np.log(np.where(right, p, 1.0 - p))
    return prediction, after, state, total


def _sweep(start, steps, learn, slip, guess, rate, clip):
    """One forward pass over ``steps``: what the pass back reads of each step, the states after the last
    events, and the negative log-likelihoods.

    The chance of an answer is p if right, 1 - p if wrong; ``signed`` is p or p - 1, so its inverse carries
    the sign that the derivatives need. Logarithms are taken of products of up to ``PRODUCT`` steps."""
    state, span, stays = start.copy(), 1.0 - slip - guess, 1.0 - learn
    guessed, held = guess - 0.5, 0.5 - slip
    nll, product = np.zeros(start.shape), np.ones(start.shape)
    kept, loses, forgets = [], -rate, np.any(rate)
    for t, (days, half) in enumerate(steps):
        n = days.shape[-1]
        now = state[..., :n]
        decay = None
        if forgets:
            decay = loses[..., :n] * days
            before = now * np.exp(decay, out=decay)
        else:
            before = now.copy()
        signed = before * span[..., :n]
        signed += guessed[..., :n]
        signed += half
        if clip:
            chance = np.maximum(signed * (2.0 * half), TINY)
            product[..., :n] *= np.minimum(chance, 1.0 - TINY)
            inverse = 2.0 * half / chance
        else:
            product[..., :n] *= signed
            inverse = np.divide(1.0, signed, out=signed)
        known = held[..., :n] + half
        known *= before
        known *= inverse
        np.multiply(known, stays[..., :n], out=now)
        now += learn[..., :n]
        kept.append((before, inverse, known, decay))
        if (t + 1) % PRODUCT == 0:
            nll -= np.log(np.abs(product))
            product[...] = 1.0
    nll -= np.log(np.abs(product))
    return kept, state, nll


def step_major(start, steps, learn, slip, guess, rate, likelihood=True, clip=True):
    """Value and gradient of each sequence's negative log-likelihood, or of its end state.

    ``steps`` holds per step (days since the previous event, 0.5 for a right answer and -0.5 for a wrong one) of the
    sequences still running, longest first. ``start`` has the shape of the result, (n,) or (candidates, n);
    parameters are (n,) or (candidates, 1). Returns (value, gradient); the first axis of the gradient is the
    start state, then learn, slip, guess and rate. ``clip`` may be left out if slip and guess lie in
    [1e-9, 1 - 1e-9], states in [0, 1] and no days are negative: no chance comes near ``TINY`` then.

    One forward sweep keeps the mastery before each event. The sweep back carries a single number per sequence:
    the derivative of the value with respect to the state after the event (0 behind the last event for the
    likelihood, 1 for the end state). Every operation is on whole contiguous arrays of a step.
    """
    kept, last, nll = _sweep(start, steps, learn, slip, guess, rate, clip)
    gradient = np.zeros((5, *start.shape))
    weight = gradient[0]
    weight[...] = 0.0 if likelihood else 1.0
    loss = 1.0 if likelihood else 0.0
    stays, pull = np.maximum(1.0 - learn, 1e-200), loss * (1.0 - slip - guess)
    # The product of an answer's two chances is ``centre`` plus ``half`` times ``tilt``.
    tilt, centre = guess - slip, 0.5 * (guess + slip) - slip * guess
    for t in range(len(kept) - 1, -1, -1):
        before, inverse, known, decay = kept[t]
        days, half = steps[t]
        n = days.shape[-1]
        behind, g = weight[..., :n], gradient[..., :n]
        # The state after the event reacts to mastery and to both chances by Bayes' rule.
        moved = behind * stays[..., :n]
        by_before = tilt[..., :n] * half
        by_before += centre[..., :n]
        by_before *= inverse
        by_before *= moved
        by_before -= pull[..., :n]
        by_before *= inverse
        known *= moved
        moved -= known
        g[1] += moved
        np.subtract(loss, moved, out=moved)
        known += loss
        with_ = before * inverse
        moved *= with_
        g[2] += moved
        inverse -= with_
        inverse *= known
        g[3] -= inverse
        if decay is None:
            behind[...] = by_before
        else:
            np.multiply(by_before, decay, out=behind)
        before *= by_before
        before *= days
        g[4] -= before
    gradient[1] /= stays
    return (nll if likelihood else last), gradient


def adjoint(start, first, length, days, y, learn, slip, guess, rate, likelihood=True):
    """:func:`step_major` over ragged sequences; the gradient's columns are its first axis."""
    at = [first[:n] + t for t, n in running(length)]
    by_step = [(days[i], np.where(y[i] > 0, 0.5, -0.5)) for i in at]
    value, gradient = step_major(np.asarray(start, float), by_step, learn, slip, guess, rate, likelihood)
    return value, gradient.T


def chain(earlier: dict, later: dict) -> dict:
    """Compose two adjacent pieces of one sequence.

    A piece holds, for a start state of 1 and of 0 (axis 0), the negative log-likelihood
    ``nll`` (2,), end state ``end`` (2,) and their gradients ``d_nll``, ``d_end`` (2, 5).
    The likelihood is linear in the start state, so the composition is exact."""
    out = {"nll": np.empty(2), "end": np.empty(2), "d_nll": np.empty((2, 5)), "d_end": np.empty((2, 5))}
    for s in range(2):
        nll, d_nll, end, d_end = enter(earlier["end"][s], earlier["d_end"][s], later)
        out["nll"][s], out["end"][s] = earlier["nll"][s] + nll, end
        out["d_nll"][s], out["d_end"][s] = earlier["d_nll"][s] + d_nll, d_end
    return out


def enter(state: float, slope: np.ndarray, piece: dict):
    """Negative log-likelihood, end state and gradients of ``piece`` entered at ``state``."""
    base = piece["nll"].min()
    e = np.exp(base - piece["nll"])
    mix = np.array([state * e[0], (1.0 - state) * e[1]])
    total = max(mix.sum(), 1e-300)
    share = mix / total
    d_total = slope * (e[0] - e[1]) / total - share @ piece["d_nll"]
    end = share @ piece["end"]
    moved = slope * (e[0] * piece["end"][0] - e[1] * piece["end"][1]) / total
    d_end = moved + share @ (piece["d_end"] - piece["end"][:, None] * piece["d_nll"]) - end * d_total
    return base - np.log(total), -d_total, end, d_end
