"""Tail probabilities of t, F, chi-square and normal laws, for small result tables (no SciPy).

Regularised incomplete beta and gamma functions by continued fractions and series (modified Lentz).
"""

from __future__ import annotations

import math

TINY, EPS, ROUNDS = 1e-300, 1e-15, 500


def _lentz(terms, first: float) -> float:
    f, c, d = first or TINY, first or TINY, 0.0
    for a, b in terms:
        d = b + a * d or TINY
        c = b + a / c or TINY
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < EPS:
            break
    return f


def betainc(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)

    def terms():
        for m in range(ROUNDS):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return front / _lentz(terms(), 1.0)


def gammaincc(a: float, x: float) -> float:
    """Q(a, x), the upper tail."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        total = term = 1 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * EPS:
                break
        return 1 - front * total
    return front / _lentz(((-n * (n - a), x + 2 * n + 1 - a) for n in range(1, 10_000)), x + 1 - a)


def t_two_sided(t: float | None, dof: float | None) -> float | None:
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return None
    return 0.0 if math.isinf(t) else betainc(dof / 2, 0.5, dof / (dof + t * t))


def f_sf(f: float | None, d1: float, d2: float) -> float | None:
    if f is None or d1 <= 0 or d2 <= 0 or math.isnan(f):
        return None
    return 0.0 if math.isinf(f) else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float | None, dof: float) -> float | None:
    return None if x is None or dof <= 0 else gammaincc(dof / 2, x / 2)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def mann_whitney_two_sided(u: float, n1: int, n2: int) -> float:
    """P of a U at least so far from its mean, without ties: the ways to reach each U are the coefficients of a Gaussian binomial."""
    small, large = sorted((n1, n2))
    ways = [1]
    for k in range(1, small + 1):  # times (1 - q^(large + k)) / (1 - q^k)
        size = len(ways) + large
        out = ways + [0] * (size - len(ways))
        for i in range(size - 1, large + k - 1, -1):
            out[i] -= out[i - large - k]
        for i in range(k, size):
            out[i] += out[i - k]
        ways = out
    least = math.ceil(max(u, n1 * n2 - u) - 1e-9)
    return min(1.0, 2 * sum(ways[least:]) / sum(ways))


def t_ppf(p: float, dof: float) -> float:
    """Quantile by bisection on the two-sided tail."""
    if p < 0.5:
        return -t_ppf(1 - p, dof)
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, dof) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, dof) / 2 < p else (low, mid)
    return (low + high) / 2


def binomial_tail(hits: int, n: int, p: float = 0.5) -> float:
    """P(X >= hits)."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(hits, n + 1))


def digamma_int(n: int) -> float:
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))
