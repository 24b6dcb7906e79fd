"""Random-intercept models from group sums.

A random intercept only needs each group's size, means and centred cross
products.  A second, crossed factor adds the counts and means of its levels in
each group.  For every candidate variance ratio tasks sum these into the
mixed-model equations with the first factor eliminated, one row per entry; the
restricted likelihood is then evaluated on the summed equations, where the
second factor's variance is searched too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import t_two_sided
from ..session import cut
from .regress import cell_moments, full, independent
from .relational import _names, merge, merge_few

COARSE = [0.0, *(float(v) for v in 10.0 ** np.linspace(-4, 3, 22))]
FINE = 9  # further ratios tried in a later round
DIRECT = 512  # levels up to which the second factor's equations are solved densely
STEP = 0.02  # of the logarithms in numerical derivatives
CHUNK = 2000  # groups put into one matrix
HELD = 4_000_000  # numbers a task holds before it passes its sums on
TIE = 1e-14  # rounding of a criterion, relative to itself and to the rows


def _levels(cells: DataFrame, by, factor: str) -> tuple[DataFrame, int]:
    """(by, factor) of each level and the largest number of levels in a model."""
    levels = cut(cells.select(*by, factor).distinct())
    return levels, levels.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def _group_rows(cells: DataFrame, by, group: str, k: int) -> DataFrame:
    """Per group its cells' codes, counts and means as flat lists, and the sum of their cross products."""
    one = F.struct("code", F.col("n").cast("double").alias("n"), "mean")
    m = k * (k + 1) // 2
    rows = cells.groupBy(*by, group).agg(
        F.collect_list(one).alias("c"), F.array(*[F.sum(F.get("cross", F.lit(i))) for i in range(m)]).alias("cross"))
    return rows.select(*by, F.col("c.code").alias("code"), F.col("c.n").alias("n"), F.flatten("c.mean").alias("mean"), "cross")


def _chunk_sums(part: pd.DataFrame, ratios: np.ndarray, k: int, q: int):
    """Equations over (1, columns, levels) at each ratio, log determinants and rows of some groups of one model."""
    at = np.repeat(np.arange(len(part)), [len(v) for v in part["n"]])
    n, code = np.concatenate(part["n"].to_numpy()), np.concatenate(part["code"].to_numpy()).astype(int)
    mean = np.concatenate(part["mean"].to_numpy()).reshape(-1, k)
    size = np.bincount(at, n)
    middle = np.zeros((len(part), k))
    np.add.at(middle, at, n[:, None] * mean)
    middle /= size[:, None]
    off = mean - middle[at]
    share = np.zeros((len(part), q))
    inside = np.zeros((1 + k + q, 1 + k + q))  # within groups: the same at every ratio
    x, z = slice(1, 1 + k), slice(1 + k, None)
    inside[x, x] = full(np.sum(part["cross"].to_list(), axis=0), k) + (off * n[:, None]).T @ off
    if q:
        share[at, code] = n / size[at]
        cross = np.zeros((q, k))
        np.add.at(cross, code, n[:, None] * off)
        inside[z, x], inside[x, z] = cross, cross.T
        inside[z, z] = np.diag(np.bincount(code, n, q)) - (share * size[:, None]).T @ share
    rows = np.hstack([np.ones((len(part), 1)), middle, share])
    sums = np.stack([inside + (rows * (size / (1 + size * t))[:, None]).T @ rows for t in ratios])
    return sums, np.array([np.log1p(size * t).sum() for t in ratios]), size.sum()


def _equations(groups: DataFrame, by, k: int, tried: int) -> DataFrame:
    """Entries (i, j <= i, one value per ratio) of each model's equations; i = -1 holds log determinants (j = 0) and row counts (j = 1)."""
    keys = ", ".join(f"`{c}` {groups.schema[c].dataType.simpleString()}" for c in by)

    def told(acc):
        for key, (sums, logdet, n) in acc.items():
            i, j = np.nonzero(np.tril(np.any(sums != 0, axis=0)))
            out = pd.DataFrame({"i": [-1, -1, *i], "j": [0, 1, *j]})
            out["v"] = [logdet.tolist(), [float(n)] * tried, *sums[:, i, j].T.tolist()]
            for c, v in zip(by, key, strict=True):
                out[c] = v
            yield out[[*by, "i", "j", "v"]]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(by, sort=False):
                ratios, q = np.asarray(part["ratios"].iloc[0], float), int(part["q"].iloc[0])
                for a in range(0, len(part), CHUNK):
                    new = _chunk_sums(part.iloc[a: a + CHUNK], ratios, k, q)
                    acc[key] = tuple(o + s for o, s in zip(acc[key], new)) if key in acc else new
                if sum(s.size for s, _, _ in acc.values()) > HELD:
                    yield from told(acc)
                    acc = {}
        yield from told(acc)

    parts = groups.mapInPandas(partial, f"{keys}, i int, j int, v array<double>")
    return parts.groupBy(*by, "i", "j").agg(F.array(*[F.sum(F.get("v", F.lit(r))) for r in range(tried)]).alias("v"))


def _unpacked(pdf: pd.DataFrame, tried: int):
    """Matrices per ratio, log determinants and row count of one model."""
    own = pdf["i"].to_numpy() >= 0
    i, j, v = pdf["i"].to_numpy()[own], pdf["j"].to_numpy()[own], np.stack(pdf["v"].to_numpy()[own])
    m = np.zeros((tried, max(i) + 1, max(i) + 1))
    m[:, i, j], m[:, j, i] = v.T, v.T
    rest = {int(a): np.asarray(b) for a, b in zip(pdf["j"][~own], pdf["v"][~own])}
    return m, rest[0], float(rest[1][0])


class _AtRatio:
    """Restricted fits at one ratio of the first factor; columns are 1, regressors (``p`` in all), y, levels."""

    def __init__(self, m: np.ndarray, logdet: float, n: float, p: int):
        self.m, self.logdet, self.n, self.p = m[: p + 1, : p + 1], logdet, n, p
        self.w, self.v = np.linalg.eigh(m[p + 1:, p + 1:])
        self.w = np.maximum(self.w, 0.0)
        self.b = self.v.T @ m[p + 1:, : p + 1]

    def fit(self, ratio2: float):
        """Estimates, unscaled covariance, residual sum and log determinant of everything but the scale."""
        a = self.m - self.b.T @ (self.b * (ratio2 / (1 + ratio2 * self.w))[:, None])
        p = self.p
        inv = np.linalg.inv(a[:p, :p])
        beta = inv @ a[:p, p]
        rss = max(a[p, p] - beta @ a[:p, p], 1e-300)
        return beta, inv, rss, self.logdet + np.log1p(ratio2 * self.w).sum() + np.linalg.slogdet(a[:p, :p])[1]

    def criterion(self, ratio2: float) -> float:
        _, _, rss, logdet = self.fit(ratio2)
        return (self.n - self.p) * np.log(rss / (self.n - self.p)) + logdet

    def best(self) -> tuple[float, float]:
        """(criterion, ratio) of the second factor's best ratio."""
        if not len(self.w):
            return self.criterion(0.0), 0.0
        grid = np.asarray(COARSE)
        for _ in range(40):
            values = [self.criterion(t) for t in grid]
            at, flat = _lowest(grid, values, self.n)
            if flat or _settled(grid, at):
                break
            grid = _next(grid, at)
        return values[at], float(grid[at])

    def effects(self, ratio2: float) -> np.ndarray:
        """Predicted intercepts of the second factor's levels."""
        beta = self.fit(ratio2)[0]
        return self.v @ ((self.b[:, self.p] - self.b[:, : self.p] @ beta) * ratio2 / (1 + ratio2 * self.w))


def _lowest(grid, values, n: float) -> tuple[int, bool]:
    """Place of the least criterion, and whether its neighbours differ from it by no more than rounding.

    Of values that rounding cannot tell apart a ratio of zero comes first, else the middle one.
    """
    values = np.asarray(values)
    low = values.min()
    ties = np.flatnonzero(values <= low + TIE * (n + abs(low)))
    if grid[0] == 0 and ties[0] == 0:
        return 0, False
    at = int(ties[len(ties) // 2])
    return at, at - 1 in ties and at + 1 in ties


def _settled(grid, at: int, tol: float = 1e-3) -> bool:
    if at + 1 == len(grid):
        return grid[at] >= 1e12  # a perfect fit within the groups
    return grid[at + 1] < 1e-8 if grid[at] == 0 else at > 0 and grid[at + 1] <= grid[at - 1] * (1 + tol)


def _next(grid, at: int) -> np.ndarray:
    """Ratios round the best one; beyond the end where that is the last, towards zero where that is the first."""
    if grid[at] == 0:
        return np.concatenate([[0.0], np.geomspace(grid[1] / 1e4, grid[1], FINE)])
    if at + 1 == len(grid):
        return np.geomspace(grid[at - 1] or grid[at] / 10, grid[at] * 1e3, FINE + 1)
    if at == 0 or grid[at - 1] == 0:
        return np.concatenate([[0.0], np.geomspace(grid[at] / 1e2, grid[at + 1], FINE)])
    return np.geomspace(grid[at - 1], grid[at + 1], FINE + 1)


def _freedom(fits: list[_AtRatio], ratio: float, ratio2: float, s2: float) -> np.ndarray:
    """Satterthwaite degrees of freedom of the fixed terms.

    ``fits`` are at exp(-STEP), 1 and exp(STEP) times ``ratio``.  Derivatives go by the logarithms of the
    two ratios and the residual variance; a ratio of zero is taken as known.
    """
    n, p = fits[1].n, fits[1].p

    def at(first=0, second=0, scale=0):
        _, inv, rss, logdet = fits[1 + first].fit(ratio2 * np.exp(STEP * second))
        var = s2 * np.exp(STEP * scale)
        return (n - p) * np.log(var) + rss / var + logdet, np.diag(inv) * var

    names = [*(["first"] if ratio > 0 else []), *(["second"] if ratio2 > 0 else []), "scale"]
    middle, var = at()
    hess, slope = np.zeros((len(names), len(names))), np.zeros((len(names), p))
    for a, x in enumerate(names):
        (up, vu), (down, vd) = at(**{x: 1}), at(**{x: -1})
        hess[a, a] = (up - 2 * middle + down) / STEP**2
        slope[a] = (vu - vd) / (2 * STEP)
        for b, y in enumerate(names[:a]):
            hess[a, b] = hess[b, a] = sum(i * j * at(**{x: i, y: j})[0] for i in (1, -1) for j in (1, -1)) / (4 * STEP**2)
    if np.linalg.eigvalsh(hess)[0] <= 0:
        return np.full(p, np.nan)
    return 2 * var**2 / np.einsum("ai,ab,bi->i", slope, 2 * np.linalg.inv(hess), slope)


def random_intercepts(df: DataFrame, y: str, xs, by, group: str, second: str | None = None, rounds: int = 20, direct: int = DIRECT) -> DataFrame:
    """Restricted-likelihood fit of y on ``xs`` with a random intercept per
    ``group`` and, if given, per ``second``, crossed with it, for each ``by``.

    Levels come from the data (rows with a null in any column drop out).  Of two
    factors one may have any number of levels; the other, whichever has fewer,
    at most ``direct`` in a model (counted first, more are an error).

    Rows by ``kind``: ``fixed`` terms with estimate, error, t, Satterthwaite's
    degrees of freedom and p; ``variance`` components; with ``second`` also the
    predicted ``effect`` of each level of the factor with fewer levels.  Ratios
    are searched until they are known to a thousandth or as far as rounding lets
    their criteria differ; not getting there in ``rounds`` is an error.  A model without more rows than terms, or with
    collinear terms, has null estimates and no effects.
    """
    xs, by = list(xs), _names(by)
    cols = [*xs, y]
    p, k = 1 + len(xs), len(cols)
    cells = cut(cell_moments(df, cols, [*by, group, *([second] if second else [])]))
    names = None
    if second:
        names, most = _levels(cells, by, second)
        if most > direct:
            other, most = _levels(cells, by, group)
            if most > direct:
                raise ValueError(f"both {group} and {second} have more than {direct} levels in a model")
            names, group, second = other, second, group
        names = cut(names.withColumn("code", F.row_number().over(Window.partitionBy(*by).orderBy(second)) - 1))
        counts = names.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("q"))
        cells = merge(merge(cells, names, by=[*by, second]), counts, by=by)
    else:
        cells = cells.withColumns({"code": F.lit(0), "q": F.lit(0)})
    groups = cut(_group_rows(cells, [*by, "q"], group, k))
    keys = ", ".join(f"`{c}` {groups.schema[c].dataType.simpleString()}" for c in by)

    def summed(state, tried):
        entries = _equations(merge_few(groups, state.select(*by, "ratios"), by), by, k, tried)
        return merge(entries, state.select(*by, "ratios"), by=by)

    def fitted(pdf, tried):
        m, logdet, n = _unpacked(pdf, tried)
        if n <= p or len(independent(m[0][:p, :p])) < p:
            return None
        return [_AtRatio(a, b, n, p) for a, b in zip(m, logdet)]

    def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
        ratios = np.asarray(pdf["ratios"].iloc[0])
        out = pdf[by].iloc[:1].copy()
        fits = fitted(pdf, len(ratios))
        at, flat = _lowest(ratios, [f.best()[0] for f in fits], fits[0].n) if fits else (None, True)
        done = flat or _settled(ratios, at)
        new = np.full(FINE + 1, 0.0 if at is None else ratios[at]) if done else _next(ratios, at)
        out["ratios"], out["done"] = [new.tolist()], done
        return out

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ratios = pdf["ratios"].iloc[0]
        fits = fitted(pdf, 3)
        if fits:
            ratio2 = fits[1].best()[1]
            beta, inv, rss, _ = fits[1].fit(ratio2)
            s2 = rss / (fits[1].n - p)
            dof = _freedom(fits, ratios[1], ratio2, s2)
        else:
            beta, inv, s2, ratio2, dof = np.full(p, np.nan), np.full((p, p), np.nan), np.nan, np.nan, np.full(p, np.nan)
        se = np.sqrt(np.diag(inv) * s2)
        t = beta / se
        rows = [("fixed", term, None, beta[i], se[i], t[i], dof[i], t_two_sided(t[i], dof[i])) for i, term in enumerate(["(Intercept)", *xs])]
        rows.append(("variance", group, None, ratios[1] * s2, None, None, None, None))
        if second:
            rows.append(("variance", second, None, ratio2 * s2, None, None, None, None))
        rows.append(("variance", "residual", None, s2, None, None, None, None))
        if second and fits:
            rows += [("effect", None, i, e, None, None, None, None) for i, e in enumerate(fits[1].effects(ratio2))]
        out = pd.DataFrame(rows, columns=["kind", "term", "code", "est", "se", "t", "dof", "p"])
        out["code"] = out["code"].astype("Int32")
        numbers = ["est", "se", "t", "dof", "p"]
        out[numbers] = out[numbers].astype(float)
        return pdf[by].iloc[[0] * len(out)].reset_index(drop=True).join(out)

    state, tried, settled = groups.select(*by).distinct().withColumn("ratios", F.array(*[F.lit(v) for v in COARSE])), len(COARSE), None
    for _ in range(rounds):
        # a model's equations reach one task: at most direct + terms rows and columns
        state = cut(summed(state, tried).groupBy(*by).applyInPandas(narrow, f"{keys}, ratios array<double>, done boolean"))
        tried = FINE + 1
        # a settled model keeps its ratio while others go on
        done, state = state.where("done"), state.where("not done")
        settled = done if settled is None else settled.unionByName(done)
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"variance ratios have not settled after {rounds} rounds")
    last = F.get("ratios", F.lit(0))
    state = settled.withColumn("ratios", F.array(*[last * F.lit(float(np.exp(STEP * s))) for s in (-1, 0, 1)]))
    found = summed(state, 3).groupBy(*by).applyInPandas(
        solve, f"{keys}, kind string, term string, code int, est double, se double, t double, dof double, p double")
    found = found.withColumns({c: F.nullif(c, F.lit(float("nan"))) for c in ("est", "se", "t", "dof", "p")})
    if second:
        found = merge(found, names.select(*by, "code", F.col(second).cast("string").alias("__level")), by=[*by, "code"], how="left")
        found = found.withColumn("term", F.coalesce("term", "__level"))
    return found.select(*by, "kind", "term", "est", "se", "t", "dof", "p")
