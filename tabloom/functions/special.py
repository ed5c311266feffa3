"""Tail probabilities, computed on the driver from aggregated statistics."""

from __future__ import annotations

from math import exp, lgamma, log, sqrt


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction (Lentz) above."""
    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def chi2_tail(statistic: float, freedom: float) -> float:
    return 1.0 if freedom <= 0 else gamma_tail(freedom / 2, statistic / 2)


def kolmogorov_tail(statistic: float, n: float, m: float) -> float:
    """The two-sample test's asymptotic p-value, with Stephens' correction for small samples."""
    size = sqrt(n * m / (n + m))
    x = (size + 0.12 + 0.11 / size) * statistic
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
