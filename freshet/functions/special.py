"""Special functions that Spark SQL lacks, vectorised over numpy arrays, and their column forms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def digamma(x: float) -> float:
    """psi(x) for x > 0: recurrence up to 10, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * 691 / 32760)))))


def gamma_shape(mean: float, mean_log: float) -> float:
    """Maximum-likelihood shape of a gamma law with location 0: the root of ln k - psi(k) = ln(mean) - mean_log."""
    s = math.log(mean) - mean_log
    if s <= 0:
        raise ValueError("a gamma fit needs positive values that are not all equal")
    lo, hi = 1e-8, 1e12
    for _ in range(200):  # ln k - psi(k) falls from infinity to 0
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if math.log(mid) - digamma(mid) > s else (lo, mid)
        if hi / lo < 1 + 1e-15:
            break
    return math.sqrt(lo * hi)


def gamma_tails(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The regularised lower and upper incomplete gamma functions (P, Q), each accurate where it is small."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    p, q = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    p[x <= 0], q[x <= 0] = 0.0, 1.0
    front = np.zeros(a.shape)
    ok = x > 0
    front[ok] = np.exp(a[ok] * np.log(x[ok]) - x[ok] - _LGAMMA(a[ok])) if ok.any() else 0
    low = ok & (x < a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = total = 1 / aa
        n = aa.copy()
        for _ in range(10_000):
            n = n + 1
            term = term * xx / n
            total = total + term
            if (term < total * 1e-17).all():
                break
        p[low] = total * front[low]
        q[low] = 1 - p[low]
    high = ok & ~low
    if high.any():  # Lentz's continued fraction
        aa, xx = a[high], x[high]
        b = xx + 1 - aa
        c, d = np.full(aa.shape, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        q[high] = front[high] * h
        p[high] = 1 - q[high]
    return p, q


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z) of the standard normal law for z >= 0."""
    return 0.5 * gamma_tails(np.full(np.shape(z), 0.5), np.square(z) / 2)[1]


def normal_upper_quantile(q: np.ndarray) -> np.ndarray:
    """z with P(Z > z) = q for 0 < q <= 0.5: a rational start, then Newton steps on the log of the tail."""
    q = np.asarray(q, float)
    t = np.sqrt(-2 * np.log(q))
    z = np.maximum(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3), 0.0)
    for _ in range(6):
        tail = normal_tail(z)
        density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        z = np.maximum(z + (np.log(tail) - np.log(q)) * tail / density, 0.0)
    return z


def gamma_normal_score(x: np.ndarray, shape: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The standard-normal quantile of the gamma distribution function, from whichever tail is smaller."""
    p, q = gamma_tails(shape, np.asarray(x, float) / scale)
    out = np.full(p.shape, np.nan)
    low, high = (p > 0) & (p <= 0.5), (q > 0) & (q < 0.5)
    out[low], out[high] = -normal_upper_quantile(p[low]), normal_upper_quantile(q[high])
    out[p <= 0], out[q <= 0] = -np.inf, np.inf
    out[np.isnan(np.asarray(x, float))] = np.nan
    return out


@F.pandas_udf(DoubleType())
def gamma_score(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series(gamma_normal_score(x.to_numpy(), shape.to_numpy(), scale.to_numpy()))
