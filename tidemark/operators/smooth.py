"""Additive models as penalised spline regression.

Each smooth is a cubic B-spline on equal knots with a second-difference
penalty.  Tasks turn their rows into basis columns and add up cross products
with numpy; Spark sums those blocks; the penalty weights are then chosen by
generalised cross validation on the small summed matrix.  An approximation of
the modelling packages' smoothers, not a copy of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import chi2_upper, f_upper
from ..session import cut
from .regress import full
from .relational import _names, merge, merge_few

BASIS = 10
LAMBDAS = 10.0 ** np.linspace(-4, 7, 23)
FLUSH = 256  # groups a task keeps before handing its blocks on


def basis(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int = BASIS) -> np.ndarray:
    """``k`` cubic B-splines on equal knots over [lo, hi]."""
    span = np.where(hi > lo, hi - lo, 1.0)
    u = np.clip((x - lo) / span, 0.0, 1.0) * (k - 3)
    d = np.abs(u[:, None] - (np.arange(k)[None, :] - 1.0))
    near = 2.0 / 3.0 - d**2 + d**3 / 2.0
    far = (2.0 - d) ** 3 / 6.0
    return np.where(d < 1, near, np.where(d < 2, far, 0.0))


def design(pdf: pd.DataFrame, smooths, linear) -> np.ndarray:
    cols = [np.ones((len(pdf), 1))]
    cols += [pdf[c].to_numpy(float)[:, None] for c in linear]
    for s in smooths:
        cols.append(basis(*(pdf[c].to_numpy(float) for c in (s, f"__lo_{s}", f"__hi_{s}"))))
    return np.hstack(cols)


def with_ranges(df: DataFrame, y: str, smooths, linear, by, carry=()) -> DataFrame:
    """Complete rows with the group's range of each smooth variable; ``carry`` names further columns to keep."""
    by, carry = _names(by), _names(carry)
    d = df.dropna(subset=[y, *smooths, *linear, *by, *carry])
    d = d.select(*by, *dict.fromkeys([*carry, y, *smooths, *linear]))
    aggs = [f(c).cast("double").alias(f"__{n}_{c}") for c in smooths for n, f in (("lo", F.min), ("hi", F.max))]
    return merge(d, d.groupBy(*by).agg(*aggs), by=by) if aggs else d


def blocks(rows: DataFrame, y: str, smooths, linear, by, weigh: bool = False) -> DataFrame:
    """Summed cross products of (design, y) per group: ``n`` and ``sums``.

    With ``weigh`` rows carry coefficients (``beta``) of a logit fit and enter
    with its working weight and response; without coefficients yet, from the
    data themselves.
    """
    by = _names(by)
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    k = 2 + len(linear) + BASIS * len(smooths)
    iu = np.triu_indices(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}

        def emit():
            out = [key + (float(v[0]), v[1][iu].tolist()) for key, v in acc.items()]
            acc.clear()
            return pd.DataFrame(out, columns=[*by, "n", "sums"])

        for pdf in batches:
            for key, g in pdf.groupby(list(by), dropna=False, sort=False):
                key = key if isinstance(key, tuple) else (key,)
                x, t = design(g, smooths, linear), g[y].to_numpy(float)
                w = None
                if weigh:
                    if "beta" in g.columns and g["beta"].iloc[0] is not None:
                        eta = np.clip(x @ np.asarray(g["beta"].iloc[0], float), -12, 12)
                        mu = 1 / (1 + np.exp(-eta))
                    else:
                        mu = (t + 0.5) / 2.0
                        eta = np.log(mu / (1 - mu))
                    w = mu * (1 - mu)
                    t = eta + (t - mu) / w
                z = np.hstack([x, t[:, None]])
                zz = z.T @ (z if w is None else z * w[:, None])
                old = acc.get(key)
                acc[key] = (len(g), zz) if old is None else (old[0] + len(g), old[1] + zz)
                if len(acc) >= FLUSH:
                    yield emit()
        yield emit()

    parts = rows.mapInPandas(run, f"{keys}, n double, sums array<double>")
    cells = parts.select(*by, "n", F.posexplode("sums").alias("i", "v"))
    summed = cells.groupBy(*by, "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    # exactly k(k+1)/2 entries a group
    return summed.groupBy(*by).agg(
        F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums")
    )


def unit_sums(rows: DataFrame, y: str, smooths, linear, by, unit) -> DataFrame:
    """Column sums of (design, y) per ``unit`` of a group, the first of them its row count: ``sums``."""
    by, unit = _names(by), _names(unit)
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, *unit])
    k = 2 + len(linear) + BASIS * len(smooths)

    def run(batches):
        for pdf in batches:
            z = np.hstack([design(pdf, smooths, linear), pdf[y].to_numpy(float)[:, None]])
            own = pdf[[*by, *unit]].reset_index(drop=True)
            at = own.groupby([*by, *unit], dropna=False, sort=False)
            out = own.drop_duplicates().reset_index(drop=True)
            add = np.zeros((len(out), k))
            np.add.at(add, at.ngroup().to_numpy(), z)
            yield out.assign(sums=list(add))

    each = rows.mapInPandas(run, f"{keys}, sums array<double>")
    return each.groupBy(*by, *unit).agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(k)]).alias("sums"))


class Fit:
    """Penalised fit on summed cross products.

    ``lam`` fixes the penalty weights and ``norm`` what they are multiples of
    (by default the data's own size); ``start`` only begins their search.
    ``centre`` are the columns' sums if not the first row, ``lost`` the degrees
    of freedom spent outside the columns.  With ``known`` the residual variance
    is 1 and the restricted criterion chooses the weights, else generalised
    cross validation.
    """

    def __init__(self, m: np.ndarray, n: float, smooths, linear, lam=None, norm=None, start=None, centre=None, lost=0, known=False):
        k = len(m) - 1
        g, self.n, self.lost, self.known = m[:k, :k], n, lost, known
        centre = g[0] if centre is None else centre
        head = 1 + len(linear)
        # each smooth is centred: its coefficients are kept orthogonal to its column sums
        t = np.zeros((k, k - len(smooths)))
        t[:head, :head] = np.eye(head)
        self.blocks, self.pen, self.norm, self.spread = {}, {}, {}, {}
        d2 = np.diff(np.eye(BASIS), n=2, axis=0)
        for i, s in enumerate(smooths):
            r0, c0 = head + i * BASIS, head + i * (BASIS - 1)
            sums = centre[r0 : r0 + BASIS]
            q = np.linalg.qr(np.column_stack([sums, np.eye(BASIS)[:, : BASIS - 1]]))[0][:, 1:]
            t[r0 : r0 + BASIS, c0 : c0 + BASIS - 1] = q
            self.blocks[s] = slice(c0, c0 + BASIS - 1)
            p = q.T @ d2.T @ d2 @ q
            inner = q.T @ g[r0 : r0 + BASIS, r0 : r0 + BASIS] @ q
            self.norm[s] = norm[s] if norm else np.trace(inner) / max(np.trace(p), 1e-300)
            self.pen[s] = p * self.norm[s]
            ev = np.linalg.eigvalsh(self.pen[s])
            self.spread[s] = ev[ev > 1e-10 * ev.max()]
        self.t, self.g, self.xy, self.yy = t, t.T @ g @ t, t.T @ m[:k, k], m[k, k]
        self.linear = {c: 1 + i for i, c in enumerate(linear)}
        self.smooths = list(smooths)
        self.choose(given=lam, start=start)

    def penalised(self, lam):
        a = self.g.copy()
        for s, v in lam.items():
            b = self.blocks[s]
            a[b, b] += v * self.pen[s]
        # a whisper of ridge keeps empty basis cells solvable
        a[np.diag_indices_from(a)] += 1e-9 * (np.trace(self.g) / len(a))
        return a

    def _solve(self, lam):
        inv = np.linalg.inv(self.penalised(lam))
        beta = inv @ self.xy
        edf = np.einsum("ij,ji->i", inv, self.g)
        rss = max(self.yy - 2 * beta @ self.xy + beta @ self.g @ beta, 0.0)
        return inv, beta, edf, rss

    def restricted(self) -> tuple[float, float]:
        """Restricted criterion (-2 log likelihood but for constants) at the chosen weights, and its residual variance.

        A penalised smooth is a random effect whose precision is its penalty.
        """
        room = self.n - len(self.g) + sum(len(ev) for ev in self.spread.values())
        left = max(self.yy - self.beta @ self.xy, 1e-300)
        return room * np.log(left / room) + np.linalg.slogdet(self.penalised(self.lam))[1] - self._logs(self.lam), left / room

    def _logs(self, lam):
        """Log determinant of the penalties where they are not zero."""
        return sum(len(self.spread[s]) * np.log(v) + np.log(self.spread[s]).sum() for s, v in lam.items())

    def choose(self, sweeps: int = 2, given=None, start=None):
        lam = dict(given or start or dict.fromkeys(self.smooths, 1.0))

        def score(trial):
            if self.known:
                a = self.penalised(trial)
                return self.yy - self.xy @ np.linalg.solve(a, self.xy) + np.linalg.slogdet(a)[1] - self._logs(trial)
            _, _, edf, rss = self._solve(trial)
            room = self.n - self.lost - edf.sum()
            return self.n * rss / room**2 if room > 0 else np.inf

        for _ in range(0 if given else sweeps):
            for s in self.smooths:
                lam[s] = min(LAMBDAS, key=lambda v: score(lam | {s: float(v)}))
        self.lam = lam
        self.gcv = score(lam)
        self.inv, self.beta, self.edf, self.rss = self._solve(lam)
        self.dof = self.n - self.lost - self.edf.sum()
        self.s2 = 1.0 if self.known else self.rss / self.dof if self.dof > 0 else np.nan

    def raw_beta(self) -> np.ndarray:
        return self.t @ self.beta

    def term(self, s: str):
        """Wald statistic, its rank and effective dof of one smooth."""
        b = self.blocks[s]
        edf = float(self.edf[b].sum())
        rank = int(np.clip(round(edf), 1, BASIS - 1))
        w, v = np.linalg.eigh(self.g[b, b])
        r = np.sqrt(np.clip(w, 0, None))[:, None] * v.T
        ev, evec = np.linalg.eigh(r @ self.inv[b, b] @ r.T * self.s2)
        f = evec.T @ (r @ self.beta[b])
        top = np.argsort(ev)[::-1][:rank]
        ok = ev[top] > 1e-14 * max(ev.max(), 1e-300)
        return float((f[top][ok] ** 2 / ev[top][ok]).sum()), rank, edf


def _rows_of(fit: Fit, family: str):
    out = []
    for s in fit.smooths:
        chi, rank, edf = fit.term(s)
        f = chi / rank
        p = chi2_upper(chi, rank) if family == "beta" else f_upper(f, rank, fit.dof)
        out.append((f"s({s})", edf, chi, f, float(p), float(np.log10(fit.lam[s])), fit.n, fit.s2, fit.gcv))
    for c, i in fit.linear.items():
        chi = fit.beta[i] ** 2 / (fit.inv[i, i] * fit.s2)
        p = chi2_upper(chi, 1) if fit.known else f_upper(chi, 1, fit.dof)
        out.append((c, 1.0, chi, chi, float(p), None, fit.n, fit.s2, fit.gcv))
    return out


SMOOTH_SCHEMA = "var string, edf double, chi double, fval double, pval double, log10_lambda double, n double, scale double, gcv double"
SMOOTH_COLS = [p.split()[0] for p in SMOOTH_SCHEMA.split(", ")]


def _no_fit(smooths, linear, n):
    """The rows of a group with no more rows than columns: every term, without statistics."""
    return [(name, None, None, None, None, None, float(n), None, None) for name in [*(f"s({s})" for s in smooths), *linear]]


def _map_fits(sums: DataFrame, by, smooths, linear, schema, cols, make, none=None) -> DataFrame:
    """``make``'s rows for each group; ``none``'s (by default one row per term) for a group too small for a fit."""
    by = _names(by)
    none = none or (lambda n: _no_fit(smooths, linear, n))
    keys = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by)
    k = 2 + len(linear) + BASIS * len(smooths)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                found = none(r["n"]) if r["n"] <= k else make(Fit(full(r["sums"], k), r["n"], smooths, linear))
                rows += [tuple(r[c] for c in by) + tuple(v) for v in found]
            yield pd.DataFrame(rows, columns=[*by, *cols])

    return sums.mapInPandas(run, f"{keys}, {schema}")


def additive(df: DataFrame, y: str, smooths, by, linear=()) -> DataFrame:
    """Gaussian additive model per group: effective dof, F and p of each smooth."""
    rows = with_ranges(df, y, smooths, linear, by)
    sums = blocks(rows, y, smooths, linear, by)
    return _map_fits(sums, by, smooths, linear, SMOOTH_SCHEMA, SMOOTH_COLS, lambda f: _rows_of(f, "gaussian"))


def additive_absorbed(df: DataFrame, y: str, smooths, by, unit, linear=()) -> DataFrame:
    """Gaussian additive model per group next to a dummy of each ``unit``: its smooths and linear terms.

    The dummies are never columns.  Eliminating them takes the outer product of
    each unit's column sums over its row count from the group's cross products;
    those sums are all that is shuffled per unit, and a unit costs the fit one
    degree of freedom.  y and the linear columns are first taken from their
    group's means, which the dummies swallow anyway.  A group with no more rows
    than columns and units has its rows without statistics.
    """
    by, unit, linear = _names(by), _names(unit), list(linear)
    rows = with_ranges(df, y, smooths, linear, by, unit)
    plain = [c for c in dict.fromkeys([y, *linear]) if c not in smooths]
    means = rows.groupBy(*by).agg(*[F.avg(c).alias(f"__mean_{c}") for c in plain])
    rows = merge(rows, means, by=by).withColumns({c: F.col(c) - F.col(f"__mean_{c}") for c in plain})
    rows = cut(rows.drop(*[f"__mean_{c}" for c in plain]))
    k = 2 + len(linear) + BASIS * len(smooths)
    iu = np.triu_indices(k)

    def outer(batches):
        for pdf in batches:
            out = []
            for key, g in pdf.groupby(by, dropna=False, sort=False):
                s = np.stack(g["sums"].to_numpy())
                m = (s / s[:, :1]).T @ s
                out.append((*key, float(len(g)), s.sum(0).tolist(), m[iu].tolist()))
            yield pd.DataFrame(out, columns=[*by, "units", "centre", "taken"])

    def columns(name, width):
        return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(width)]).alias(name)

    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    parts = unit_sums(rows, y, smooths, linear, by, unit).mapInPandas(outer, f"{keys}, units double, centre array<double>, taken array<double>")
    cells = parts.select(*by, "units", "centre", F.posexplode("taken").alias("i", "v"))
    taken = cells.groupBy(*by, "i").agg(F.sum("v").alias("v"))
    # exactly k(k+1)/2 entries a group
    taken = taken.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("taken"))
    units = parts.groupBy(*by).agg(F.sum("units").alias("units"), columns("centre", k))
    every = merge(merge(blocks(rows, y, smooths, linear, by), taken, by=by), units, by=by)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if r["n"] <= k + r["units"]:
                    found = _no_fit(smooths, linear, r["n"])
                else:
                    m = full(r["sums"], k) - full(r["taken"], k)
                    # what is left of the intercept: a column of its own that explains nothing
                    m[0], m[:, 0] = 0.0, 0.0
                    m[0, 0] = 1.0
                    found = _rows_of(Fit(m, r["n"], smooths, linear, centre=np.asarray(r["centre"]), lost=r["units"] - 1), "gaussian")
                out += [tuple(r[c] for c in by) + tuple(v) for v in found]
            yield pd.DataFrame(out, columns=[*by, *SMOOTH_COLS])

    return every.mapInPandas(run, f"{keys}, {SMOOTH_SCHEMA}")


def additive_logit(df: DataFrame, y: str, smooths, by, linear=(), passes: int = 5) -> DataFrame:
    """Additive model of a proportion with a logit link, by a fixed number of
    reweighted passes; rows and coefficients are stored between passes."""
    by = _names(by)
    rows = cut(with_ranges(df, y, smooths, linear, by))
    sums = blocks(rows, y, smooths, linear, by, weigh=True)
    for _ in range(passes - 1):
        beta = cut(_map_fits(sums, by, smooths, linear, "beta array<double>", ["beta"], lambda f: [(f.raw_beta().tolist(),)], lambda n: [(None,)]))
        sums = blocks(merge(rows, beta, by=by), y, smooths, linear, by, weigh=True)
    return _map_fits(sums, by, smooths, linear, SMOOTH_SCHEMA, SMOOTH_COLS, lambda f: _rows_of(f, "beta"))


def additive_random(df: DataFrame, y: str, smooths, by, group: str, linear=()) -> DataFrame:
    """Gaussian additive model with a random intercept per ``group``: its
    smooths and the variance components.

    Groups enter through their column sums only: at a variance ratio t a group
    of n rows takes t / (1 + n t) times the outer product of its sums from the
    model's cross products.  Tasks add these up for each candidate; the ratios
    are sent to them where the models are few (counted first).  The ratio
    minimises the restricted criterion: first on a coarse grid from 0 to 1e4,
    where each ratio chooses its penalties, then on ever finer grids around the
    best one with that one's penalties.  A grid whose last ratio is best is
    followed by one that reaches further.
    """
    by = _names(by)
    # one knot range per model, so the blocks of all groups add up
    d = df.dropna(subset=[y, *smooths, *linear, *by, group])
    d = cut(d.select(*by, group, *dict.fromkeys([y, *smooths, *linear])))
    ends = [f(c).cast("double").alias(f"__{n}_{c}") for c in smooths for n, f in (("lo", F.min), ("hi", F.max))]
    rows = merge_few(d, cut(d.groupBy(*by).agg(*ends)), by)
    whole = cut(blocks(rows, y, smooths, linear, by))
    sums = cut(unit_sums(rows, y, smooths, linear, by, group))
    k = 2 + len(linear) + BASIS * len(smooths)
    coarse = [0.0, *(float(v) for v in 10.0 ** np.linspace(-4, 4, 17))]
    keys = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by)
    iu = np.triu_indices(k)

    def weigh(batches):
        for pdf in batches:
            out = []
            for key, g in pdf.groupby(by, dropna=False, sort=False):
                at, ratios = np.stack(g["sums"].to_numpy()), np.asarray(g["ratios"].iloc[0], float)
                n = at[:, 0]
                for t in ratios:
                    taken = (at * (t / (1 + n * t))[:, None]).T @ at
                    out.append((*key, float(t), taken[iu].tolist(), float(np.log1p(n * t).sum())))
            yield pd.DataFrame(out, columns=[*by, "ratio", "taken", "logdet"])

    width = k * (k + 1) // 2

    def weighted(grids):
        parts = merge_few(sums, grids.select(*by, "ratios"), by).mapInPandas(weigh, f"{keys}, ratio double, taken array<double>, logdet double")
        per = parts.groupBy(*by, "ratio").agg(
            F.sum("logdet").alias("logdet"), F.array(*[F.sum(F.get("taken", F.lit(i))) for i in range(width)]).alias("taken"))
        per = merge(merge(per, whole, by=by), grids.select(*by, "lams"), by=by)
        return per.withColumn("sums", F.zip_with("sums", "taken", lambda a, b: a - b)).drop("taken")

    def best_of(pdf: pd.DataFrame):
        best = None
        for r in pdf.sort_values("ratio").itertuples(index=False):
            lam = None if r.lams is None else dict(zip(smooths, r.lams))
            fit = Fit(full(r.sums, k), r.n, smooths, linear, lam)
            crit, s2 = fit.restricted()
            if best is None or crit + r.logdet < best[0]:
                best = (crit + r.logdet, float(r.ratio), fit, s2)
        return best

    def first_cols(pdf, out):
        for i, c in enumerate(by):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    def finer(pdf: pd.DataFrame) -> pd.DataFrame:
        _, ratio, fit, _ = best_of(pdf)
        ts = sorted(pdf["ratio"])
        i = ts.index(ratio)
        lo, hi = ts[i - 1] if i else 0.0, ts[i + 1] if i + 1 < len(ts) else 100 * ratio
        grid = sorted({float(ratio), *np.linspace(lo, hi, 13)}) if lo == 0 else sorted({float(ratio), *np.geomspace(lo, hi, 13)})
        return first_cols(pdf, pd.DataFrame({"ratios": [grid], "lams": [[float(fit.lam[c]) for c in smooths]]}))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        _, ratio, fit, s2 = best_of(pdf)
        rows = _rows_of(fit, "gaussian")
        rows.append((f"variance({group})", None, None, None, None, None, fit.n, ratio * s2, fit.gcv))
        rows.append(("variance(residual)", None, None, None, None, None, fit.n, s2, fit.gcv))
        return first_cols(pdf, pd.DataFrame(rows, columns=SMOOTH_COLS))

    # one row per candidate ratio reaches a model's group: a bounded list
    none = F.lit(None).cast("array<double>")
    grids = sums.select(*by).distinct().select(*by, F.array(*[F.lit(v) for v in coarse]).alias("ratios"), none.alias("lams"))
    for _ in range(3):
        grids = cut(weighted(grids).groupBy(*by).applyInPandas(finer, f"{keys}, ratios array<double>, lams array<double>"))
    return weighted(grids).groupBy(*by).applyInPandas(pick, f"{keys}, {SMOOTH_SCHEMA}")
