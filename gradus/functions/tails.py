"""Upper tails of distributions, for test statistics that are few."""

from __future__ import annotations

from math import exp, lgamma, log


def incomplete_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x): by its series below a + 1, by its continued fraction from there on."""
    if x <= 0:
        return 1.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        top = -i * (i - a)
        b += 2
        d = 1 / ((top * d + b) or tiny)
        c = (b + top / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * front


def chi_square_p_value(x: float, df: int) -> float:
    """Probability of a chi-square of ``df`` degrees of freedom of at least ``x``; 1 without any degree."""
    return incomplete_gamma(df / 2, x / 2) if df > 0 else 1.0
