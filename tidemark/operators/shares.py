"""Additive beta regression of shares: smooths, precision and a tested end.

Tasks score their rows at the group's present coefficients and precision and
add up gradient and expected information; Spark sums those blocks, and a small
step per group is solved in a task.  Groups leave as they settle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gamma import digamma, lgamma, trigamma
from ..session import cut
from .regress import full
from .relational import _names, merge
from .smooth import BASIS, FLUSH, SMOOTH_COLS, SMOOTH_SCHEMA, Fit, _map_fits, _no_fit, _rows_of, blocks, design, with_ranges

BETA_SCHEMA = f"{SMOOTH_SCHEMA}, est double, phi double, loglik double, passes int, gap double, settled boolean"
BETA_COLS = [*SMOOTH_COLS, "est", "phi", "loglik", "passes", "gap", "settled"]
STATE = {
    "n": "double", "go": "array<double>", "at": "array<double>", "ll": "double", "lam": "array<double>", "norm": "array<double>",
    "chosen": "boolean", "sums": "array<double>", "halved": "int", "passes": "int", "gap": "double", "done": "boolean",
}
LONGEST = 2.0  # the furthest a step moves the precision's logarithm
ROUGH = np.diff(np.eye(BASIS), n=2, axis=0)


def scores(x: np.ndarray, y: np.ndarray, v: np.ndarray):
    """Sums over rows at coefficients ``v`` (the last one is the log precision): expected
    information of the coefficients, then their gradient, their information with the log
    precision, its gradient and information, log likelihood and squared working residuals."""
    k, phi = x.shape[1], np.exp(v[-1])
    mu = 1 / (1 + np.exp(-np.clip(x @ v[:k], -25, 25)))
    a, b, t = mu * phi, (1 - mu) * phi, phi * mu * (1 - mu)
    up, down = trigamma(a), trigamma(b)
    off = np.log(y) - np.log1p(-y) - digamma(a) + digamma(b)
    w = t * t * (up + down)
    cross = t * phi * (mu * up - (1 - mu) * down)
    slope = phi * (mu * off + np.log1p(-y) - digamma(b) + digamma(phi)).sum()
    bend = phi**2 * (mu**2 * up + (1 - mu) ** 2 * down - trigamma(phi)).sum()
    ll = (lgamma(phi) - lgamma(a) - lgamma(b) + (a - 1) * np.log(y) + (b - 1) * np.log1p(-y)).sum()
    info = (x.T @ (x * w[:, None]))[np.triu_indices(k)]
    return np.concatenate([info, x.T @ (t * off), x.T @ cross, [slope, bend, ll, ((t * off) ** 2 / w).sum()]])


def score_blocks(rows: DataFrame, y: str, smooths, linear, by, eps: float) -> DataFrame:
    """``scores`` summed per group at the coefficients ``go`` that rows carry."""
    by = _names(by)
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        acc: dict = {}

        def emit():
            out = [(*key, s.tolist()) for key, s in acc.items()]
            acc.clear()
            return pd.DataFrame(out, columns=[*by, "found"])

        for pdf in batches:
            for key, g in pdf.groupby(by, dropna=False, sort=False):
                s = scores(design(g, smooths, linear), np.clip(g[y].to_numpy(float), eps, 1 - eps), np.asarray(g["go"].iloc[0], float))
                acc[key] = s + acc.get(key, 0.0)
                if len(acc) >= FLUSH:
                    yield emit()
        yield emit()

    parts = rows.mapInPandas(run, f"{keys}, found array<double>")
    cells = parts.select(*by, F.posexplode("found").alias("i", "v")).groupBy(*by, "i").agg(F.sum("v").alias("v"))
    # one entry per place of the block
    return cells.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("found"))


def _split(sums, k: int):
    s = np.asarray(sums, float)
    e = k * (k + 1) // 2
    return full(s[:e], k), s[e : e + k], s[e + k : e + 2 * k], *s[e + 2 * k :]


def _working(sums, at: np.ndarray, n: float, smooths, linear, **how) -> Fit:
    """The penalised fit of the working responses that ``sums`` stand for."""
    k = len(at) - 1
    g, u, _, _, _, _, left = _split(sums, k)
    b, m = at[:k], np.zeros((k + 1, k + 1))
    m[:k, :k] = g
    m[:k, k] = m[k, :k] = g @ b + u
    m[k, k] = b @ g @ b + 2 * b @ u + left
    return Fit(m, n, smooths, linear, known=True, **how)


def _rough(v: np.ndarray, weight: dict, head: int):
    """Gradient of the penalty at ``v`` and its value."""
    grad = np.zeros(len(v) - 1)
    for i, w in enumerate(weight.values()):
        at = slice(head + i * BASIS, head + (i + 1) * BASIS)
        grad[at] = w * ROUGH.T @ (ROUGH @ v[at])
    return grad, 0.5 * grad @ v[:-1]


def _advance(r: dict, smooths, linear, tol: float, choose: int) -> dict:
    """A group's state after its candidate ``go`` was scored as ``found``."""
    r = dict(r, passes=r["passes"] + 1)
    go, head = np.asarray(r["go"], float), 1 + len(linear)
    k = len(go) - 1
    ll = _split(r["found"], k)[5]
    if r["at"] is not None:
        at = np.asarray(r["at"], float)
        weight = {s: a * b for s, a, b in zip(smooths, r["lam"], r["norm"])}
        new, old = ll - _rough(go, weight, head)[1], r["ll"] - _rough(at, weight, head)[1]
        if not new >= old - 1e-10 * (1 + abs(old)):
            return r | {"go": ((at + go) / 2).tolist(), "halved": r["halved"] + 1, "done": r["halved"] >= 40}
    r |= {"at": go.tolist(), "ll": float(ll), "sums": list(r["found"]), "halved": 0}
    if r["chosen"]:
        fit = _working(r["sums"], go, r["n"], smooths, linear, lam=dict(zip(smooths, r["lam"])), norm=dict(zip(smooths, r["norm"])))
    else:
        start = dict(zip(smooths, r["lam"])) if r["lam"] is not None else None
        fit = _working(r["sums"], go, r["n"], smooths, linear, start=start)
        lam = [float(fit.lam[s]) for s in smooths]
        # from here on the same penalty, so that there is one maximum to settle at
        r |= {"chosen": (start is not None and lam == list(r["lam"])) or r["passes"] >= choose, "lam": lam, "norm": [float(fit.norm[s]) for s in smooths]}
    _, u, cross, slope, bend, _, _ = _split(r["sums"], k)
    grad = np.append(fit.t.T @ (u - _rough(go, {s: fit.lam[s] * fit.norm[s] for s in smooths}, head)[0]), slope)
    info = np.zeros((len(grad), len(grad)))
    info[:-1, :-1] = fit.penalised(fit.lam)
    info[:-1, -1] = info[-1, :-1] = fit.t.T @ cross
    info[-1, -1] = bend
    step = np.linalg.solve(info, grad)
    gap = float(grad @ step)
    step *= min(1.0, LONGEST / max(abs(step[-1]), 1e-300))
    return r | {"go": (go + np.append(fit.t @ step[:-1], step[-1])).tolist(), "gap": gap, "done": bool(r["chosen"] and gap < tol)}


def additive_beta(
    df: DataFrame, y: str, smooths, by, linear=(), eps: float = 1e-5, tol: float = 1e-8, most: int = 25, choose: int = 12,
) -> DataFrame:
    """Beta regression of a share on smooths and linear terms per group, logit link, one precision ``phi``.

    Coefficients and log precision are scored together with the expected
    information of both; a step that lowers the penalised likelihood is halved.
    The restricted criterion of the working responses chooses the penalties
    anew in each pass until it repeats its choice (in the ``choose``-th pass at
    the latest); with these the group passes until ``gap``, twice the rise of
    the penalised log likelihood that a further step promises, is under ``tol``.
    Groups that need more than ``most`` passes are returned with ``settled`` false.

    Shares are moved inside [``eps``, 1 - ``eps``]; incomplete rows drop out; a
    group with no more rows than columns has its terms without statistics.  One
    row per term: ``SMOOTH_COLS`` with chi-square tests given phi (``scale`` is
    1, ``gcv`` the criterion), ``est`` of linear terms, ``phi``, ``loglik``,
    ``passes``, ``gap``, ``settled``.
    """
    by, smooths, linear = _names(by), list(smooths), list(linear)
    rows = cut(with_ranges(df, y, smooths, linear, by))
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    schema, cols = ", ".join([keys, *(f"{c} {t}" for c, t in STATE.items())]), [*by, *STATE]
    blank = dict.fromkeys(STATE) | {"chosen": False, "halved": 0, "passes": 0, "done": False}

    def first(fit: Fit):
        # a share's variance is mu (1 - mu) / (1 + phi)
        phi = max(1 / fit.s2 - 1, 0.1) if fit.s2 > 0 else 1.0
        return [tuple((blank | {"n": float(fit.n), "go": [*fit.raw_beta().tolist(), float(np.log(phi))]}).values())]

    def too_small(n):
        return [tuple((blank | {"n": float(n), "done": True}).values())]

    def forward(batches):
        for pdf in batches:
            out = [r if r["done"] else _advance(r, smooths, linear, tol, choose) for r in pdf.to_dict("records")]
            yield pd.DataFrame([[r[c] for c in cols] for r in out], columns=cols)

    sums = blocks(rows.withColumn(y, F.col(y).cast("double")), y, smooths, linear, by, weigh=True)
    states = cut(_map_fits(sums, by, smooths, linear, ", ".join(f"{c} {t}" for c, t in STATE.items()), list(STATE), first, too_small))
    for _ in range(most):
        found = score_blocks(merge(rows, states.where("not done").select(*by, "go"), by=by), y, smooths, linear, by, eps)
        states = cut(merge(states, found, by=by, how="left").mapInPandas(forward, schema))
        if states.where("not done").isEmpty():
            break

    def finish(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                key = tuple(r[c] for c in by)
                if r["at"] is None:
                    out += [(*key, *v, None, None, None, 0, None, None) for v in _no_fit(smooths, linear, r["n"])]
                    continue
                at = np.asarray(r["at"], float)
                fit = _working(r["sums"], at, r["n"], smooths, linear, lam=dict(zip(smooths, r["lam"])), norm=dict(zip(smooths, r["norm"])))
                tail = (float(np.exp(at[-1])), r["ll"], r["passes"], r["gap"], bool(r["gap"] < tol and r["chosen"]))
                out += [(*key, *v, float(at[fit.linear[v[0]]]) if v[0] in fit.linear else None, *tail) for v in _rows_of(fit, "beta")]
            yield pd.DataFrame(out, columns=[*by, *BETA_COLS])

    return states.mapInPandas(finish, f"{keys}, {BETA_SCHEMA}")
