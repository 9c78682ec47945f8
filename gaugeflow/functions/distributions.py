"""Student's t, the normal law and signed-rank sums, vectorized over Arrow batches.

These run on the short tables that are left after aggregation: one row per comparison.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 4e-16):
            break
    return h


def reg_inc_beta(a, b, x):
    """Regularized incomplete beta function."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, b, x)])
    x = np.clip(x, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1.0) / (a + b + 2.0)
        xs = np.where(low, x, 1.0 - x)
        part = front * _beta_fraction(np.where(low, a, b), np.where(low, b, a), xs) / np.where(low, a, b)
    out = np.where(low, part, 1.0 - part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_upper(t, df):
    """P(T > t)."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    half = 0.5 * reg_inc_beta(df / 2.0, 0.5, df / (df + t * t))
    return np.where(np.isnan(t), np.nan, np.where(t >= 0, half, 1.0 - half))


def t_quantile(p, df):
    """Value with P(T <= value) = p, for p >= 0.5, by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, dtype=float), np.asarray(df, dtype=float))
    lo, hi = np.zeros(p.shape), np.full(p.shape, 1e4)
    for _ in range(66):
        mid = 0.5 * (lo + hi)
        below = 1.0 - t_upper(mid, df) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return 0.5 * (lo + hi)


def normal_upper(z):
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2.0))


def signed_rank_p(doubled: list[int] | np.ndarray, positive: int) -> float:
    """Two-sided exact p of a signed-rank sum: the law of the (doubled, possibly tied) rank sum by
    one convolution per rank, in probabilities, which do not overflow as counts would."""
    ranks = np.asarray(doubled, dtype=int)
    law = np.zeros(ranks.sum() + 1)
    law[0], top = 1.0, 0
    for r in ranks:
        top += r
        law[: top + 1] *= 0.5
        law[r: top + 1] += law[: top + 1 - r].copy()
    return float(min(1.0, 2.0 * min(law[: positive + 1].sum(), law[positive:].sum())))


def ranks_of(n: int, tied: list[tuple[int, int]]) -> np.ndarray:
    """Doubled ranks of n values, from the (doubled rank, size) of the groups of equal ones."""
    ranks = 2 * np.arange(1, n + 1)
    for doubled, size in tied:
        first = (doubled - size + 1) // 2
        ranks[first - 1: first - 1 + size] = doubled
    return ranks


def _udf(fn):
    return F.pandas_udf(fn, DoubleType())


def _nulls(out, *args) -> pd.Series:
    s = pd.Series(np.asarray(out, dtype=float))
    for a in args:
        s[pd.isna(a).to_numpy()] = np.nan
    return s.where(s.notna(), None)


def t_two_sided_p(t: Column, df: Column) -> Column:
    def f(t: pd.Series, df: pd.Series) -> pd.Series:
        df = df.where(df >= 1)
        return _nulls(np.minimum(1.0, 2.0 * t_upper(t.abs().fillna(0), df.fillna(1))), t, df)

    return _udf(f)(t.cast("double"), df.cast("double"))


def t_upper_p(t: Column, df: Column) -> Column:
    def f(t: pd.Series, df: pd.Series) -> pd.Series:
        df = df.where(df >= 1)
        return _nulls(t_upper(t.fillna(0), df.fillna(1)), t, df)

    return _udf(f)(t.cast("double"), df.cast("double"))


def t_critical(p: float, df: Column) -> Column:
    def f(df: pd.Series) -> pd.Series:
        df = df.where(df >= 1)
        return _nulls(t_quantile(p, df.fillna(1)), df)

    return _udf(f)(df.cast("double"))


def normal_upper_p(z: Column) -> Column:
    def f(z: pd.Series) -> pd.Series:
        return _nulls(normal_upper(z.fillna(0)), z)

    return _udf(f)(z.cast("double"))


def exact_signed_rank_p(n: Column, tied: Column, positive: Column) -> Column:
    """p of ``positive``, the doubled rank sum of the positive ones among n; ``tied`` lists (doubled, ties) of equal ones; NULL without n."""
    def f(n: pd.Series, tied: pd.Series, pos: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(k) or k == 0 else signed_rank_p(ranks_of(int(k), [(x["doubled"], x["ties"]) for x in t]), int(p)) for k, t, p in zip(n, tied, pos)],
                         dtype=object)

    return _udf(f)(n, tied, positive)


# Rational approximation of the normal quantile (AS 241, PPND16).
_CENTRE_P = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
             45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
_CENTRE_Q = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867,
             39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
_NEAR_P = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
           1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4)
_NEAR_Q = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
           0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_FAR_P = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
          0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_FAR_Q = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4,
          1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def polynomial(coefs, x: Column) -> Column:
    """c0 + c1 x + c2 x^2 + ..."""
    out = F.lit(float(coefs[-1]))
    for c in reversed(coefs[:-1]):
        out = out * x + float(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile as a column expression, for 0 < p < 1."""
    q = p - 0.5
    r = 0.180625 - q * q
    centre = q * polynomial(_CENTRE_P, r) / polynomial(_CENTRE_Q, r)
    tail = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    near, far = tail - 1.6, tail - 5.0
    size = F.when(tail <= 5.0, polynomial(_NEAR_P, near) / polynomial(_NEAR_Q, near)).otherwise(
        polynomial(_FAR_P, far) / polynomial(_FAR_Q, far))
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -size).otherwise(size)
