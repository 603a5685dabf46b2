"""Tail probabilities in numpy, for pandas UDFs: no special-function library is at hand.

Regularised incomplete gamma and beta functions by their series, vectorised over rows.
"""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_p(a, x, terms: int = 500) -> np.ndarray:
    """Lower regularised gamma P(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.where(x > 0, x, 1.0)
    term = np.exp(-safe + a * np.log(safe) - _lgamma(a + 1))
    total = term.copy()
    for n in range(1, terms):
        term = term * safe / (a + n)
        total += term
    return np.where(x > 0, np.minimum(total, 1.0), 0.0)


def beta_i(a, b, x, terms: int = 3000) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x >= (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    safe = np.clip(z, 1e-300, 1 - 1e-16)
    term = np.exp(_lgamma(p + q) - _lgamma(q) - _lgamma(p + 1) + p * np.log(safe) + q * np.log1p(-safe))
    total = term.copy()
    for n in range(1, terms):
        term = term * (p + q + n - 1) / (p + n) * safe
        total += term
        if np.all(term < 1e-16 * np.maximum(total, 1e-300)):
            break
    total = np.where(z <= 0, 0.0, np.minimum(total, 1.0))
    return np.where(flip, 1 - total, total)


def chi2_sf(x, k) -> np.ndarray:
    return 1 - gamma_p(np.asarray(k, float) / 2, np.maximum(np.asarray(x, float), 0) / 2)


def t_two_tailed(t, df) -> np.ndarray:
    df = np.asarray(df, float)
    return beta_i(df / 2, 0.5, df / (df + np.asarray(t, float) ** 2))


def f_sf(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return np.where(f <= 0, 1.0, beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))))


def normal_cdf(z) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(np.asarray(z, float) / math.sqrt(2)))


def kolmogorov_sf(d: float, n: int) -> float:
    """Asymptotic tail of the one-sample statistic, with the usual small-sample correction."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101)))))
