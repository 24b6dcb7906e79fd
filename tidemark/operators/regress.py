"""Linear models from distributed cross-product sums.

One aggregation per model gives, per group, the row count, the means and the
centred cross products of all columns (``covar_pop`` merges partial results in
a numerically stable way).  Groups of any size thus become one short row, and
numpy solves k-by-k systems on those rows inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import fill
from ..functions.tails import chi2_upper, f_upper, t_two_sided
from ..session import cut
from .panel import row_shift, with_stats
from .relational import _names, merge

TERM_SCHEMA = "term string, est double, se double, t double, p double, n long, dof long, r2 double"


# -- sums ----------------------------------------------------------------------

def moments(df: DataFrame, cols, by, within=()) -> DataFrame:
    """Per ``by`` group over complete rows: ``n``, ``n_units`` (groups of ``within``),
    overall ``mean``, ``cross`` centred on the ``within`` groups and ``raw``
    uncentred cross products (flattened upper triangles)."""
    cols, by, within = list(cols), _names(by), _names(within)
    cells = cell_moments(df, cols, [*by, *within])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    nn = F.col("n").cast("double")
    m = [F.get("mean", F.lit(i)) for i in range(len(cols))]
    aggs = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_units")]
    aggs.append(F.array(*[F.sum(nn * x) / F.sum(nn) for x in m]).alias("mean"))
    aggs.append(F.array(*[F.sum(F.get("cross", F.lit(q))) for q in range(len(pairs))]).alias("cross"))
    aggs.append(
        F.array(*[F.sum(F.get("cross", F.lit(q)) + nn * m[i] * m[j]) for q, (i, j) in enumerate(pairs)]).alias("raw")
    )
    return cells.groupBy(*by).agg(*aggs)


def cell_moments(df: DataFrame, cols, by) -> DataFrame:
    """``n``, ``mean`` array and centred ``cross`` array per group."""
    cols, by = list(cols), _names(by)
    d = df.dropna(subset=list(dict.fromkeys([*cols, *by])))
    x = [F.col(c).cast("double") for c in cols]
    n = F.count(F.lit(1))
    return d.groupBy(*by).agg(
        n.alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"),
        F.array(*[F.covar_pop(x[i], x[j]) * n for i in range(len(x)) for j in range(i, len(x))]).alias("cross"),
    )


def full(flat, k: int) -> np.ndarray:
    """Symmetric matrix from its flattened upper triangle."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    return out + np.triu(out, 1).T


# -- numpy on one group ----------------------------------------------------------

def independent(gram: np.ndarray, tol=1e-9) -> list[int]:
    """Columns kept in order, leaving out those the earlier ones determine."""
    kept: list[int] = []
    for j in range(len(gram)):
        if not gram[j, j] > 0:
            continue
        rest = gram[j, j]
        if kept:
            s = gram[np.ix_(kept, kept)]
            v = gram[kept, j]
            d = np.sqrt(np.diag(s))
            rest -= v / d @ np.linalg.lstsq(s / np.outer(d, d), v / d, rcond=None)[0]
        if rest > tol * gram[j, j]:
            kept.append(j)
    return kept


def solve(gram, xty, yty, n, lost: int):
    """Coefficients, their covariance, residual sum, dof and kept columns.
    ``lost`` counts parameters already swept out (intercept or unit effects)."""
    kept = independent(gram)
    dof = int(n - lost - len(kept))
    if not kept:
        return np.zeros(0), np.zeros((0, 0)), yty, dof, kept
    a = gram[np.ix_(kept, kept)]
    d = np.sqrt(np.diag(a))
    inv = np.linalg.inv(a / np.outer(d, d)) / np.outer(d, d)
    beta = inv @ xty[kept]
    rss = max(yty - beta @ xty[kept], 0.0)
    s2 = rss / dof if dof > 0 else np.nan
    return beta, inv * s2, rss, dof, kept


def _row(term, est, se, n, dof, r2):
    with np.errstate(all="ignore"):
        t = est / se if se and se > 0 else np.nan
    return term, est, se, t, float(t_two_sided(t, dof)), n, dof, r2


def _per_group(stats: DataFrame, by, schema: str, one) -> DataFrame:
    """Run ``one(row) -> list of tuples`` on every moments row, in its task."""
    by = _names(by)
    keys = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in by)
    cols = by + [p.strip().split()[0].strip("`") for p in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                out += [tuple(r[c] for c in by) + tuple(v) for v in one(r)]
            res = pd.DataFrame(out, columns=cols)
            yield res.astype(object).where(res.notna(), None)

    return stats.mapInPandas(run, f"{keys}, {schema}" if keys else schema)


def ols(df: DataFrame, y: str, xs, by, intercept=True) -> DataFrame:
    """Least squares per group, one row per estimable term."""
    xs = list(xs)
    k = len(xs) + 1
    stats = moments(df, [y, *xs], by)

    def one(r):
        n = int(r["n"])
        s = full(r["cross"] if intercept else r["raw"], k)
        beta, cov, rss, dof, kept = solve(s[1:, 1:], s[1:, 0], s[0, 0], n, 1 if intercept else 0)
        r2 = 1 - rss / s[0, 0] if s[0, 0] > 0 else np.nan
        rows = []
        if intercept:
            m = np.asarray(r["mean"])
            mk = m[1:][kept]
            s2 = rss / dof if dof > 0 else np.nan
            se0 = np.sqrt(s2 / n + mk @ cov @ mk) if dof > 0 else np.nan
            rows.append(_row("(Intercept)", m[0] - mk @ beta, se0, n, dof, r2))
        for i, j in enumerate(kept):
            rows.append(_row(xs[j], beta[i], np.sqrt(cov[i, i]), n, dof, r2))
        return rows

    return _per_group(stats, by, TERM_SCHEMA, one)


def fixed_effects(df: DataFrame, y: str, xs, by, unit) -> DataFrame:
    """Within estimator with unit effects; the effects cost one dof each."""
    xs = list(xs)
    stats = moments(df, [y, *xs], by, within=unit)

    def one(r):
        s = full(r["cross"], len(xs) + 1)
        n = int(r["n"])
        beta, cov, rss, dof, kept = solve(s[1:, 1:], s[1:, 0], s[0, 0], n, int(r["n_units"]))
        r2 = 1 - rss / s[0, 0] if s[0, 0] > 0 else np.nan
        return [_row(xs[j], beta[i], np.sqrt(cov[i, i]), n, dof, r2) for i, j in enumerate(kept)]

    return _per_group(stats, by, TERM_SCHEMA, one)


FIT_SCHEMA = "beta array<double>, cov array<double>, s2 double, dof long"


def within_fit(df: DataFrame, y: str, xs, by, unit) -> DataFrame:
    """The within fit as one row per group: full-length coefficients (0 where
    not estimable), their covariance, residual variance and dof."""
    xs = list(xs)
    q = len(xs)
    stats = moments(df, [y, *xs], by, within=unit)

    def one(r):
        s = full(r["cross"], q + 1)
        beta, cov, rss, dof, kept = solve(s[1:, 1:], s[1:, 0], s[0, 0], int(r["n"]), int(r["n_units"]))
        b, v = np.zeros(q), np.zeros((q, q))
        b[kept] = beta
        v[np.ix_(kept, kept)] = cov
        return [(b.tolist(), v.ravel().tolist(), rss / dof if dof > 0 else None, dof)]

    return _per_group(stats, by, FIT_SCHEMA, one)


def unit_effects(df: DataFrame, y: str, xs, by, unit) -> DataFrame:
    """Each unit's effect: its mean of y less the fitted part, with its error."""
    xs, by, unit = list(xs), _names(by), _names(unit)
    cells = cell_moments(df, [y, *xs], [*by, *unit])
    j = merge(cells, within_fit(df, y, xs, by, unit), by=by).drop("cross")

    def one(r):
        m = np.asarray(r["mean"])
        b = np.asarray(r["beta"])
        v = np.asarray(r["cov"]).reshape(len(b), len(b))
        s2 = r["s2"]
        se = np.sqrt(s2 / r["n"] + m[1:] @ v @ m[1:]) if s2 is not None and s2 == s2 else np.nan
        est = m[0] - m[1:] @ b
        dof = int(r["dof"])
        t = est / se if se and se > 0 else np.nan
        return [(est, se, t, float(t_two_sided(t, dof)))]

    return _per_group(j, [*by, *unit], "est double, se double, t double, p double", one)


def dummy_regression(df: DataFrame, y: str, xs, by, unit: str, carry: dict | None = None) -> DataFrame:
    """Regression with a dummy per unit and no intercept: slopes and unit
    effects in one table (var, est, pval); ``carry`` adds group aggregates."""
    by = _names(by)
    slopes = fixed_effects(df, y, xs, by, unit).select(*by, F.col("term").alias("var"), "est", F.col("p").alias("pval"))
    effects = unit_effects(df, y, xs, by, unit).select(
        *by, F.concat(F.lit(unit), F.col(unit).cast("string")).alias("var"), "est", F.col("p").alias("pval")
    )
    out = slopes.unionByName(effects)
    if carry:
        out = merge(out, df.groupBy(*by).agg(*[v.alias(k) for k, v in carry.items()]), by=by, how="left")
    return out


def significant(table: DataFrame, var: str, sign: int, alpha: float) -> DataFrame:
    """Rows of one term with the wanted sign, significant at ``alpha``."""
    side = F.col("est") > 0 if sign > 0 else F.col("est") < 0
    return table.where((F.col("var") == var) & side & (F.col("pval") < alpha))


# -- two-way effects ---------------------------------------------------------------

DIRECT = 512  # times of a group up to which their equations are solved as one dense system


def two_way_demean(df: DataFrame, cols, unit: str, time: str, by=(), tol: float = 1e-9, most: int = 100, direct: int = DIRECT) -> DataFrame:
    """Remove unit and time effects (``tw_*``), in any panel; incomplete rows drop out first.

    Units are eliminated, which leaves one equation per time of a group.  Where
    every group has at most ``direct`` times (counted first), the equations are
    summed from the units' counts in one pass and solved densely.  Beyond that they
    are solved by conjugate gradients, scaled by the times' row counts, for all
    groups and columns at once: a step reads the counted (unit, time) cells, never
    the rows, and stores one row per time; a group of T times takes T steps at most
    but for rounding.  They end when no time's mean is off by more than ``tol`` of
    its column's largest value; not getting there in ``most`` steps is an error.
    """
    return _two_way(df, cols, unit, time, by, tol, most, direct)[0]


def _solved_times(cells: DataFrame, start: DataFrame, unit: str, time: str, by, k: int) -> DataFrame:
    """Time effects ``__x*`` by dense systems, one per group, and the number of connected parts of the group's panel."""
    units = cells.groupBy(*by, unit).agg(F.collect_list(F.struct(F.col(time).alias("t"), F.col("__n").alias("n"))).alias("__c"))
    nu = F.aggregate("__c", F.lit(0.0), lambda acc, c: acc + c["n"])
    pairs = units.select(*by, "__c", nu.alias("__nu"), F.explode("__c").alias("__p")).select(*by, "__nu", "__p", F.explode("__c").alias("__q"))
    pairs = pairs.groupBy(*by, F.col("__p.t").alias(time), F.col("__q.t").alias("__o")).agg(F.sum(F.col("__p.n") * F.col("__q.n") / F.col("__nu")).alias("__v"))
    right = start.select(*by, time, "__nt", *[(F.col(f"__b{i}") - F.col(f"__q{i}")).alias(f"__r{i}") for i in range(k)])
    rows = merge(pairs, right, by=[*by, time])
    found = [f"__x{i}" for i in range(k)]

    def solve_group(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = pd.factorize(pd.concat([pdf[time], pdf["__o"]]), use_na_sentinel=False)[0]
        at, other = codes[: len(pdf)], codes[len(pdf):]
        one = np.unique(at, return_index=True)[1]  # a row of each time, in the order of the codes
        root = np.sqrt(pdf["__nt"].to_numpy()[one])
        m = np.eye(len(one))
        m[at, other] -= pdf["__v"].to_numpy() / (root[at] * root[other])
        w, v = np.linalg.eigh(m)  # one zero eigenvalue for each connected part
        keep = w > 1e-10
        r = pdf[[f"__r{i}" for i in range(k)]].to_numpy()[one] / root[:, None]
        x = (v[:, keep] / w[keep]) @ (v[:, keep].T @ r) / root[:, None]
        return pdf[[*by, time]].iloc[one].assign(**{c: x[:, i] for i, c in enumerate(found)}, parts=int((~keep).sum()))

    keys = T.StructType([start.schema[c] for c in [*by, time]])
    schema = T.StructType([*keys.fields, *(T.StructField(c, T.DoubleType()) for c in found), T.StructField("parts", T.LongType())])
    return rows.groupBy(*by).applyInPandas(solve_group, schema)


def _two_way(df: DataFrame, cols, unit: str, time: str, by, tol: float = 1e-9, most: int = 100, direct: int = DIRECT):
    """``two_way_demean``'s rows, and (``by``, units, times, parts) of each group."""
    cols, given = list(cols), _names(by)
    by = given or ["__all"]
    d = df.dropna(subset=cols).withColumns({f"tw_{c}": F.col(c).cast("double") for c in cols})
    d = cut(d if given else d.withColumn("__all", F.lit(0)))
    at_unit, at_time = [*by, unit], [*by, time]
    ix = range(len(cols))
    cells = cut(d.groupBy(*by, unit, time).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), *[F.sum(f"tw_{c}").alias(f"__s{i}") for i, c in enumerate(cols)]))
    size = [float(x or 0.0) for x in d.agg(*[F.max(F.abs(f"tw_{c}")) for c in cols]).first()]
    if not any(size):
        size = [1.0 for _ in size]

    def unit_means(rows, values):
        return rows.groupBy(*at_unit).agg(*[(F.sum(v) / F.sum("__n")).alias(f"__m{i}") for i, v in enumerate(values)])

    def spread(means):  # the units' means, summed over the rows of each time
        j = merge(cells.select(*at_unit, time, "__n", *[F.col(f"__s{i}") for i in ix]), means, by=at_unit)
        return j.groupBy(*at_time).agg(
            F.sum("__n").alias("__nt"), *[F.sum(F.col("__n") * F.col(f"__m{i}")).alias(f"__q{i}") for i in ix],
            *[F.sum(f"__s{i}").alias(f"__b{i}") for i in ix])

    start = spread(unit_means(cells, [F.col(f"__s{i}") for i in ix]))
    if (start.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= direct:
        times = cut(_solved_times(cells, start, unit, time, by, len(cols)))
        parts = times.groupBy(*by).agg(F.count(F.lit(1)).alias("times"), F.max("parts").alias("parts"))
        counts = cells.select(*by, F.struct(unit).alias("__u")).groupBy(*by).agg(F.count_distinct("__u").alias("units"))
        return _without_effects(d, cells, times, cols, at_unit, at_time, unit_means), merge(counts, parts, by=by)
    state = cut(start.select(
        *at_time, "__nt", *[F.lit(0.0).alias(f"__x{i}") for i in ix], *[(F.col(f"__b{i}") - F.col(f"__q{i}")).alias(f"__r{i}") for i in ix],
        *[((F.col(f"__b{i}") - F.col(f"__q{i}")) / F.col("__nt")).alias(f"__p{i}") for i in ix]))
    for step in range(most + 1):
        off = state.agg(*[F.max(F.abs(F.col(f"__r{i}")) / F.col("__nt")) for i in ix]).first()
        if all((m or 0.0) <= tol * z for m, z in zip(off, size)):
            break
        if step == most:
            raise RuntimeError(f"two-way effects have not settled after {most} steps")
        j = merge(cells.select(*at_unit, time, "__n"), state.select(*at_time, *[f"__p{i}" for i in ix]), by=at_time)
        q = spread(unit_means(j, [F.col("__n") * F.col(f"__p{i}") for i in ix])).drop("__nt", *[f"__b{i}" for i in ix])
        q = merge(state, q, by=at_time).withColumns({f"__q{i}": F.col("__nt") * F.col(f"__p{i}") - F.col(f"__q{i}") for i in ix})
        sums = q.groupBy(*by).agg(
            *[F.sum(F.col(f"__p{i}") * F.col(f"__q{i}")).alias(f"__pq{i}") for i in ix],
            *[F.sum(F.col(f"__r{i}") ** 2 / F.col("__nt")).alias(f"__rr{i}") for i in ix])
        q = merge(q, sums, by=by)
        for i in ix:  # a group that is done stays as it is
            going = (F.col(f"__pq{i}") > 0) & (F.col(f"__rr{i}") > (0.01 * tol * size[i]) ** 2)
            length = F.when(going, F.col(f"__rr{i}") / F.col(f"__pq{i}")).otherwise(0.0)
            q = q.withColumns({f"__x{i}": F.col(f"__x{i}") + length * F.col(f"__p{i}"), f"__r{i}": F.col(f"__r{i}") - length * F.col(f"__q{i}")})
        q = cut(q.select(*at_time, "__nt", *[f"__{v}{i}" for v in ("x", "r", "p", "rr") for i in ix]))
        again = q.groupBy(*by).agg(*[F.sum(F.col(f"__r{i}") ** 2 / F.col("__nt")).alias(f"__new{i}") for i in ix])
        state = merge(q, again, by=by).withColumns({
            f"__p{i}": F.col(f"__r{i}") / F.col("__nt") + F.when(F.col(f"__rr{i}") > 0, F.col(f"__new{i}") / F.col(f"__rr{i}")).otherwise(0.0) * F.col(f"__p{i}")
            for i in ix}).select(*state.columns)
    times = state.select(*at_time, *[f"__x{i}" for i in ix])
    return _without_effects(d, cells, times, cols, at_unit, at_time, unit_means), panel_parts(d, unit, time, by)


def _without_effects(d, cells, times, cols, at_unit, at_time, unit_means) -> DataFrame:
    ix = range(len(cols))
    times = times.select(*at_time, *[f"__x{i}" for i in ix])
    units = unit_means(merge(cells, times, by=at_time), [F.col(f"__s{i}") - F.col("__n") * F.col(f"__x{i}") for i in ix])
    out = merge(merge(d, units, by=at_unit), times, by=at_time)
    out = out.withColumns({f"tw_{c}": F.col(f"tw_{c}") - F.col(f"__m{i}") - F.col(f"__x{i}") for i, c in enumerate(cols)})
    return out.select(*[c for c in d.columns if c != "__all"])


def panel_parts(d: DataFrame, unit: str, time: str, by) -> DataFrame:
    """(``by``, units, times, parts) of each group: parts are the connected pieces of the panel, units and times joined by rows.

    Units tie their times to the first of them, which leaves at most one edge per
    pair of times; labels then pass along edges, and from label to label, until
    none changes.  Null units and times count as one.
    """
    by = _names(by)
    cells = cut(d.select(*by, F.struct(unit).alias("__u"), F.struct(time).alias("__t")).distinct())
    first = cells.groupBy(*by, "__u").agg(F.min("__t").alias("__l"))
    edges = merge(cells, first, by=[*by, "__u"]).select(*by, "__t", "__l").distinct()
    edges = cut(edges.unionByName(edges.select(*by, F.col("__l").alias("__t"), F.col("__t").alias("__l"))).distinct())
    labels = edges.groupBy(*by, "__t").agg(F.min("__l").alias("__l"))
    while True:
        labels = cut(labels)
        near = merge(edges.withColumnRenamed("__l", "__o"), labels.withColumnRenamed("__t", "__o"), by=[*by, "__o"])
        least = merge(labels, near.groupBy(*by, "__t").agg(F.min("__l").alias("__m")), by=[*by, "__t"])
        least = least.select(*by, "__t", F.least("__l", "__m").alias("__l"))
        jumped = merge(least, least.select(*by, F.col("__t").alias("__l"), F.col("__l").alias("__far")), by=[*by, "__l"])
        jumped = jumped.select(*by, "__t", F.col("__far").alias("__l"))
        moved = merge(labels.withColumnRenamed("__l", "__was"), jumped, by=[*by, "__t"]).where("__l <> __was")
        if moved.isEmpty():
            break
        labels = jumped
    parts = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("times"), F.count_distinct("__l").alias("parts"))
    return merge(cells.groupBy(*by).agg(F.count_distinct("__u").alias("units")), parts, by=by)


def two_way_fixed_effects(df: DataFrame, y: str, xs, unit: str, time: str, by) -> DataFrame:
    """Within estimator with unit and time effects; each connected part of a panel loses units + times - 1 degrees."""
    xs, by = list(xs), _names(by)
    d, parts = _two_way(df, [y, *xs], unit, time, by)
    cols = [f"tw_{c}" for c in [y, *xs]]
    stats = merge(moments(d, cols, by), parts, by=by)

    def one(r):
        s = full(r["raw"], len(cols))
        n = int(r["n"])
        beta, cov, rss, dof, kept = solve(s[1:, 1:], s[1:, 0], s[0, 0], n, int(r["units"] + r["times"] - r["parts"]))
        r2 = 1 - rss / s[0, 0] if s[0, 0] > 0 else np.nan
        return [_row(xs[j], beta[i], np.sqrt(cov[i, i]), n, dof, r2) for i, j in enumerate(kept)]

    return _per_group(stats, by, TERM_SCHEMA, one)


# -- instruments --------------------------------------------------------------------

def two_stage(df: DataFrame, y: str, exog, endog, instruments, by, unit: str, time: str | None = None) -> DataFrame:
    """Two-stage least squares within units, or within units and times."""
    exog, endog, instruments, by = list(exog), list(endog), list(instruments), _names(by)
    xs = [*exog, *endog]
    cols = [y, *xs, *instruments]
    if time is None:
        stats = moments(df, cols, by, within=unit).withColumn("lost", F.col("n_units"))
        field = "cross"
    else:
        d, parts = _two_way(df, cols, unit, time, by)
        stats = merge(moments(d, [f"tw_{c}" for c in cols], by), parts, by=by)
        stats = stats.withColumn("lost", F.col("units") + F.col("times") - F.col("parts"))
        field = "raw"

    def one(r):
        s = full(r[field], len(cols))
        ix = list(range(1, 1 + len(xs)))
        iz = list(range(1, 1 + len(exog))) + list(range(1 + len(xs), len(cols)))
        zz, zx, zy = s[np.ix_(iz, iz)], s[np.ix_(iz, ix)], s[iz, 0]
        kz = independent(zz)
        zz, zx, zy = zz[np.ix_(kz, kz)], zx[kz], zy[kz]
        p = np.linalg.solve(zz, zx)
        a = zx.T @ p
        kx = independent(a)
        inv = np.linalg.inv(a[np.ix_(kx, kx)])
        beta = inv @ (p.T @ zy)[kx]
        xx, xy = s[np.ix_(ix, ix)][np.ix_(kx, kx)], s[ix, 0][kx]
        rss = s[0, 0] - 2 * beta @ xy + beta @ xx @ beta
        n = int(r["n"])
        dof = int(n - r["lost"] - len(kx))
        cov = inv * (rss / dof if dof > 0 else np.nan)
        r2 = 1 - rss / s[0, 0] if s[0, 0] > 0 else np.nan
        return [_row(xs[j], beta[i], np.sqrt(cov[i, i]), n, dof, r2) for i, j in enumerate(kx)]

    return _per_group(stats, by, TERM_SCHEMA, one)


# -- diagnostics --------------------------------------------------------------------

def within_residuals(df: DataFrame, y: str, xs, by, unit) -> DataFrame:
    """Complete rows with unit-demeaned columns (``w_*``) and the residual ``resid``."""
    xs, by, unit = list(xs), _names(by), _names(unit)
    df = cut(df.dropna(subset=[y, *xs, *by, *unit]))  # read by every step below
    d = with_stats(df, [*by, *unit], **{f"__m_{c}": F.avg(c) for c in [y, *xs]})
    d = d.withColumns({f"w_{c}": F.col(c) - F.col(f"__m_{c}") for c in [y, *xs]}).drop(*[f"__m_{c}" for c in [y, *xs]])
    d = merge(d, within_fit(df, y, xs, by, unit).select(*by, "beta"), by=by)
    fit = sum((F.get("beta", F.lit(i)) * F.col(f"w_{c}") for i, c in enumerate(xs)), F.lit(0.0))
    return d.withColumn("resid", F.col(f"w_{y}") - fit).drop("beta")


def serial_correlation(df: DataFrame, y: str, xs, by, unit, time: str, order: int = 1, slab=None) -> DataFrame:
    """Breusch-Godfrey test on the within residuals, lagged inside each unit
    (the first ones count as 0): n times the R2 of the auxiliary regression."""
    xs, by, unit = list(xs), _names(by), _names(unit)
    d = within_residuals(df, y, xs, by, unit)
    lags = []
    for k in range(1, order + 1):
        d = row_shift(d, [*by, *unit], time, {f"__e{k}": "resid"}, k, slab)
        d = d.withColumn(f"__e{k}", fill(f"__e{k}", 0.0))
        lags.append(f"__e{k}")
    cols = ["resid", *[f"w_{c}" for c in xs], *lags]
    stats = moments(d, cols, by)

    def one(r):
        s = full(r["raw"], len(cols))
        n = int(r["n"])
        _, _, rss, _, _ = solve(s[1:, 1:], s[1:, 0], s[0, 0], n, 0)
        stat = n * (1 - rss / s[0, 0]) if s[0, 0] > 0 else np.nan
        return [(stat, order, float(chi2_upper(stat, order)), n)]

    return _per_group(stats, by, "chisq double, lags long, p double, n long", one)


def drop_one(df: DataFrame, y: str, xs, by, unit: str) -> DataFrame:
    """F test of leaving out each term of the dummy regression, the dummies
    included, all from one set of sums."""
    xs = list(xs)
    stats = moments(df, [y, *xs], by, within=unit)

    def one(r):
        k = len(xs) + 1
        s, raw, n, g = full(r["cross"], k), full(r["raw"], k), int(r["n"]), int(r["n_units"])
        _, _, rss, dof, kept = solve(s[1:, 1:], s[1:, 0], s[0, 0], n, g)
        out = []

        def add(term, rss0, df1):
            f = ((rss0 - rss) / df1) / (rss / dof) if df1 > 0 and dof > 0 and rss > 0 else np.nan
            out.append((term, df1, rss0 - rss, rss0, f, float(f_upper(f, df1, dof))))

        for i, name in enumerate(xs):
            rest = [j for j in range(len(xs)) if j != i]
            _, _, rss0, dof0, _ = solve(s[1:, 1:][np.ix_(rest, rest)], s[1:, 0][rest], s[0, 0], n, g)
            add(name, rss0, dof0 - dof)
        _, _, rss0, dof0, _ = solve(raw[1:, 1:], raw[1:, 0], raw[0, 0], n, 0)
        add(unit, rss0, dof0 - dof)
        return out

    return _per_group(stats, by, "term string, df long, sum_sq double, rss double, f double, p double", one)


def effect_curve(df: DataFrame, y: str, xs, by, unit: str, pred: str, points: int = 100) -> DataFrame:
    """Fitted y with its 95 % interval along ``pred``: the other regressors at
    their mean, the unit at its first level."""
    xs, by = list(xs), _names(by)
    d = df.dropna(subset=[y, *xs, *by, unit])
    cells = cell_moments(d, [y, *xs], [*by, unit])
    base = cells.groupBy(*by).agg(F.min(F.struct(unit, "n", "mean")).alias("__b"))
    base = base.select(*by, F.col("__b.n").alias("__n0"), F.col("__b.mean").alias("__m0"))
    mid = d.groupBy(*by).agg(
        F.array(*[F.avg(c) for c in xs]).alias("__mid"), F.min(pred).cast("double").alias("__lo"), F.max(pred).cast("double").alias("__hi")
    )
    j = merge(merge(base, mid, by=by), within_fit(df, y, xs, by, unit), by=by)
    at = xs.index(pred)

    def one(r):
        m0, m, b = np.asarray(r["__m0"]), np.asarray(r["__mid"], float), np.asarray(r["beta"])
        v = np.asarray(r["cov"]).reshape(len(b), len(b))
        out = []
        half = t_quantile(0.975, int(r["dof"]))
        for x in np.linspace(r["__lo"], r["__hi"], points):
            p = m.copy()
            p[at] = x
            dx = p - m0[1:]
            fit = m0[0] + dx @ b
            se = np.sqrt(r["s2"] / r["__n0"] + dx @ v @ dx) if r["s2"] is not None else np.nan
            out.append((x, fit, fit - half * se, fit + half * se))
        return out

    return _per_group(j, by, "at double, fit double, lower double, upper double", one)


def t_quantile(q: float, dof: int) -> float:
    """Quantile of Student's t (q > 0.5) by bisection on the tail."""
    if dof <= 0:
        return float("nan")
    lo, hi = 0.0, 1e3 if dof > 2 else 1e7
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, dof) / 2 > 1 - q else (lo, mid)
    return (lo + hi) / 2
