"""Critical values and rank bounds computed once on the driver from a few integers."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            delta = d * c
            h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@lru_cache(maxsize=None)
def t_critical(df: int, level: float = 0.95) -> float:
    """Two-sided Student t critical value by bisection."""
    tail = 1.0 - level
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = 0.5 * (low + high)
        if beta_cdf(df / 2.0, 0.5, df / (df + mid * mid)) > tail:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def _binomial_terms(n: int, p: float):
    """Probabilities of 0, 1, ... n successes, from their logarithms so that no n overflows."""
    for k in range(n + 1):
        if p in (0.0, 1.0):
            yield float(k == n * p)
        else:
            ways = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
            yield math.exp(ways + k * math.log(p) + (n - k) * math.log1p(-p))


def order_statistic_ranks(n: int, q: float, level: float = 0.95) -> tuple[int, int, float]:
    """1-based ranks whose order statistics bracket the ``q`` quantile, and the coverage."""
    tail = (1.0 - level) / 2.0
    below, total = [0.0], 0.0  # below[k]: probability of fewer than k successes
    low = None
    for k, term in enumerate(_binomial_terms(n, q)):
        total += term
        below.append(total)
        if low is None and total >= tail:
            low = k
        if total >= 1.0 - tail:
            break
    high = len(below) - 2
    low_rank, high_rank = max(low or 0, 1), min(high + 1, n)
    return low_rank, high_rank, below[high_rank] - below[low_rank]


def inversions(ranks: list[int]) -> int:
    """Pairs out of order, counted while runs of doubling length are merged."""
    values, total, width = np.asarray(ranks), 0, 1
    while width < len(values):
        for a in range(0, len(values) - width, 2 * width):
            left, right = values[a : a + width], values[a + width : a + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            values[a : a + 2 * width] = np.sort(values[a : a + 2 * width], kind="stable")
        width *= 2
    return total


@lru_cache(maxsize=64)
def _inversion_shares(n: int) -> np.ndarray:
    """Shares of the orders of n things by their number of inversions, for any n.

    An n-th thing adds 0 .. n-1 inversions with equal chance, which is a running mean."""
    shares = np.ones(1)
    for size in range(2, n + 1):
        sums = np.cumsum(np.concatenate([shares, np.zeros(size - 1)]))
        shares = (sums - np.concatenate([np.zeros(size), sums[:-size]])) / size
    return shares


def kendall_p_value(n: int, discordant: int) -> float:
    """Exact two-sided p-value of Kendall's tau without ties, from inversion counts."""
    fewest = min(discordant, n * (n - 1) // 2 - discordant)
    if 4 * discordant == n * (n - 1):
        return 1.0
    return float(min(1.0, 2.0 * _inversion_shares(n)[: fewest + 1].sum()))
