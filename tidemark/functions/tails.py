"""Upper tail probabilities of t, F and chi-square, vectorised in numpy."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a, b, x):
    """Lentz evaluation of the continued fraction of the incomplete beta."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * (d * c)
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    inside = (x > 0) & (x < 1)
    xs = np.where(inside, x, 0.5)
    flip = xs > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - xs, xs)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + aa * np.log(xx) + bb * np.log1p(-xx))
    part = front * _beta_fraction(aa, bb, xx) / aa
    out = np.where(flip, 1.0 - part, part)
    return np.where(inside, out, np.where(x <= 0, 0.0, 1.0))


def t_two_sided(t, dof):
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    ok = np.isfinite(t) & (dof > 0)
    ts, ds = np.where(ok, t, 0.0), np.where(ok, dof, 1.0)
    return np.where(ok, beta_inc(ds / 2.0, 0.5, ds / (ds + ts * ts)), np.nan)


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    ok = np.isfinite(f) & (f >= 0) & (d1 > 0) & (d2 > 0)
    fs, a, b = np.where(ok, f, 1.0), np.where(ok, d1, 1.0), np.where(ok, d2, 1.0)
    return np.where(ok, beta_inc(b / 2.0, a / 2.0, b / (b + a * fs)), np.nan)


def _gamma_q(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:  # series for the lower part
        term = total = 1.0 / a
        k = a
        for _ in range(2000):
            k += 1.0
            term *= x / k
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def chi2_upper(x, dof):
    q = np.vectorize(lambda v, k: _gamma_q(k / 2.0, v / 2.0) if np.isfinite(v) and k > 0 else np.nan, otypes=[float])
    return q(np.asarray(x, float), np.asarray(dof, float))
