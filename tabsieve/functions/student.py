"""Two-sided p-value of a correlation coefficient (Student t, n - 2 degrees).

Works on the pair table, whose size depends on the number of columns only.
With v degrees of freedom and sin(u) = r, the tail is the integral of
cos(u)^(v - 1) from asin|r| to pi/2 over that from 0. One quadrature serves
all sizes: beyond REACH / sqrt(v) from its lower end the integrand has vanished.
"""

from __future__ import annotations

import math

import numpy as np

REACH, PANELS = 12.0, 32
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


def _log_gamma_half_step(a: float) -> float:
    """ln(gamma(a + 1/2) / gamma(a)). From 10^4 on by two terms of its series, which
    miss less than 10^-14; a difference of large logarithms would miss more."""
    if a > 1e4:
        return 0.5 * math.log(a) - 1.0 / (8.0 * a)
    return math.lgamma(a + 0.5) - math.lgamma(a)


def correlation_p_value(r: float, n: int, method: str = "pearson") -> float | None:
    """P(|T| >= t) for the t statistic of r; two points decide nothing."""
    if n < 3:
        return 1.0 if method == "pearson" else None
    if abs(r) >= 1.0:
        return 0.0
    if r == 0.0:
        return 1.0
    v = n - 2
    low = math.asin(abs(r))
    high = min(math.pi / 2, low + REACH / math.sqrt(v))
    half = (high - low) / (2 * PANELS)
    middles = low + half * (2 * np.arange(PANELS) + 1)
    u = middles[:, None] + half * _NODES
    # log(cos(u)), exact for small u as well.
    height = np.exp((v - 1) * np.log1p(-2 * np.sin(u / 2) ** 2))
    area = half * float((height * _WEIGHTS).sum())
    return min(1.0, 2 * math.exp(_log_gamma_half_step(v / 2)) / math.sqrt(math.pi) * area)
