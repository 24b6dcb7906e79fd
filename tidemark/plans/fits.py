"""SQL texts of least squares on any number of regressors, and of tail probabilities.

The sums of squares and products of all columns are swept one regressor at a
time, a subquery each; afterwards the y corner holds the residual sum, the y
column the coefficients and the rest minus the inverse.
"""

from __future__ import annotations


def swept(src: str, y: str, xs, by: str, unit: str | None = None, raw: bool = False) -> str:
    """Per ``by`` group over complete rows: n, g (units), m0.. (means), yy, rss, b0.., v0_0.. (the inverse).

    Columns are centred on the group, or on its units; ``raw`` leaves them as they are.
    """
    xs = list(xs)
    cols, k = [*xs, y], len(xs)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    keys = f"{by}, {unit}" if unit else by
    product = "sum({0} * {1})" if raw else "covar_pop({0}, {1}) * count(*)"
    inner = ", ".join([f"avg({c}) AS m{i}" for i, c in enumerate(cols)] + [f"{product.format(cols[i], cols[j])} AS a{i}_{j}" for i, j in pairs])
    outer = ", ".join([f"sum(n * m{i}) / sum(n) AS m{i}" for i in range(k + 1)] + [f"sum(a{i}_{j}) AS a{i}_{j}" for i, j in pairs])
    some = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    sql = f"SELECT {by}, sum(n) AS n, count(*) AS g, {outer}, sum(a{k}_{k}) AS yy FROM (SELECT {keys}, count(*) AS n, {inner} FROM ({src}) WHERE {some} GROUP BY {keys}) GROUP BY {by}"

    def at(i, j):
        return f"a{min(i, j)}_{max(i, j)}"

    for p in range(k):
        d = at(p, p)
        new = []
        for i, j in pairs:
            if i == p and j == p:
                e = f"-1 / {d}"
            elif p in (i, j):
                e = f"{at(i, j)} / {d}"
            else:
                e = f"{at(i, j)} - {at(i, p)} * {at(p, j)} / {d}"
            new.append(f"{e} AS {at(i, j)}")
        sql = f"SELECT * REPLACE ({', '.join(new)}) FROM ({sql})"
    rest = [f"a{i}_{k} AS b{i}" for i in range(k)] + [f"-a{i}_{j} AS v{i}_{j}" for i, j in pairs if j < k]
    return f"SELECT {by}, n, g, {', '.join(f'm{i}' for i in range(k + 1))}, yy, a{k}_{k} AS rss, {', '.join(rest)} FROM ({sql})"


def series(p: str, q: str, z: str) -> str:
    """Power series of I_z(p, q), for z up to 1/2."""
    term = f"exp({p} * ln({z}) + {q} * ln(1 - {z}) + lgamma({p} + {q} + j) - lgamma({q}) - lgamma({p} + 1 + j) + j * ln({z}))"
    return f"CASE WHEN {z} <= 0 THEN 0 ELSE list_sum(list_transform(range(0, CAST(200 + 3 * ({p} + {q}) AS BIGINT)), lambda j: {term})) END"


def tail(sql: str, name: str, a: str, b: str, x: str) -> str:
    """``sql`` with the regularised incomplete beta I_x(a, b) as ``name``, by its power series (of 1 - I_1-x(b, a) where x > 1/2)."""
    part = series("_p", "_q", "_z")
    return f"""
    SELECT * EXCLUDE (_a, _b, _x, _p, _q, _z), CASE WHEN _x IS NULL OR NOT (_a > 0 AND _b > 0) THEN NULL WHEN _x > 0.5 THEN 1 - {part} ELSE {part} END AS {name}
    FROM (SELECT *, CASE WHEN _x > 0.5 THEN _b ELSE _a END AS _p, CASE WHEN _x > 0.5 THEN _a ELSE _b END AS _q, CASE WHEN _x > 0.5 THEN 1 - _x ELSE _x END AS _z
      FROM (SELECT *, CAST({a} AS DOUBLE) AS _a, CAST({b} AS DOUBLE) AS _b, CAST({x} AS DOUBLE) AS _x FROM ({sql})))"""


def two_sided(sql: str, name: str, t: str = "t", dof: str = "dof") -> str:
    """``sql`` with the two-sided p value of ``t`` as ``name``."""
    return tail(sql, name, f"{dof} / 2.0", "0.5", f"CASE WHEN {dof} > 0 THEN {dof} / ({dof} + {t} * {t}) END")


def t_975(dof: str) -> str:
    """The 97.5 % point of Student's t with two or more degrees of freedom, by bisection between 0 and 64."""
    x = f"{dof} / ({dof} + t * t)"
    p = f"CASE WHEN {x} > 0.5 THEN 1 - {series('0.5', f'({dof} / 2.0)', f'(t * t / ({dof} + t * t))')} ELSE {series(f'({dof} / 2.0)', '0.5', f'({x})')} END"
    return f"list_reduce(list_transform(range(1, 56), lambda i: 32.0::DOUBLE * 0.5 ** i), lambda t, h: t + CASE WHEN {p} > 0.05 THEN h ELSE -h END, 32.0::DOUBLE)"


def f_tail(sql: str, name: str, f: str, d1: str, d2: str) -> str:
    return tail(sql, name, f"{d2} / 2.0", f"{d1} / 2.0", f"CASE WHEN {d1} > 0 AND {d2} > 0 THEN {d2} / ({d2} + {d1} * {f}) END")


def chi2_1(x: str) -> str:
    """Upper tail of chi-square with one degree of freedom."""
    z = f"(({x}) / 2.0)"
    series = f"list_sum(list_transform(range(0, 200 + CAST(4 * {z} AS BIGINT)), lambda j: exp(-{z} + (j + 0.5) * ln({z}) - lgamma(j + 1.5))))"
    return f"CASE WHEN ({x}) <= 0 THEN 1 WHEN {z} > 600 THEN 0 ELSE 1 - {series} END"


def all_terms(src: str, y: str, xs, by: str, names=None, unit: str | None = None, intercept: bool = False) -> str:
    """One row per term: term, est, se, t, p, n, dof, r2.  Without ``unit`` and ``intercept`` nothing is centred."""
    xs, k = list(xs), len(list(xs))
    lost = "g" if unit else "1" if intercept else "0"
    fit = f"SELECT *, n - {lost} - {k} AS dof, rss / nullif(n - {lost} - {k}, 0) AS s2 FROM ({swept(src, y, xs, by, unit, raw=not (unit or intercept))})"
    rows = [f"SELECT {by}, '{name}' AS term, b{i} AS est, sqrt(s2 * v{i}_{i}) AS se, n, dof, 1 - rss / yy AS r2 FROM ({fit})" for i, name in enumerate(names or xs)]
    if intercept:
        mean = f"m{k} - " + " - ".join(f"b{i} * m{i}" for i in range(k))
        rows.append(f"SELECT {by}, '(Intercept)' AS term, {mean} AS est, sqrt(s2 * (1.0 / n + {around(k)})) AS se, n, dof, 1 - rss / yy AS r2 FROM ({fit})")
    long = " UNION ALL ".join(rows)
    return f"""SELECT {by}, term, est, se, t, p, CAST(n AS BIGINT) AS n, CAST(dof AS BIGINT) AS dof, r2
    FROM ({two_sided(f"SELECT *, est / nullif(se, 0) AS t FROM ({long})", "p")})"""


def around(k: int, m: str = "m") -> str:
    """Quadratic form of the means in the inverse."""
    return " + ".join(f"{'' if i == j else '2 * '}{m}{i} * {m}{j} * v{i}_{j}" for i in range(k) for j in range(i, k))


def dummy_terms(src: str, y: str, xs, by: str, unit: str, names=None) -> str:
    """Slopes and unit effects of a dummy regression: by, var, est, pval."""
    xs, k = list(xs), len(list(xs))
    some = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, y])
    means = ", ".join(f"avg({c}) AS u{i}" for i, c in enumerate([*xs, y]))
    unit_rows = f"SELECT {by}, {unit}, count(*) AS nu, {means} FROM ({src}) WHERE {some} GROUP BY {by}, {unit}"
    effect = f"u{k} - " + " - ".join(f"b{i} * u{i}" for i in range(k))
    slopes = " UNION ALL ".join(f"SELECT {by}, '{name}' AS var, b{i} AS est, sqrt(s2 * v{i}_{i}) AS se, dof FROM f" for i, name in enumerate(names or xs))
    long = f"""{slopes} UNION ALL
      SELECT {by}, '{unit}' || CAST({unit} AS VARCHAR), {effect}, sqrt(s2 * (1.0 / nu + {around(k, 'u')})), dof FROM ({unit_rows}) JOIN f USING ({by})"""
    fit = f"SELECT *, n - g - {k} AS dof, rss / nullif(n - g - {k}, 0) AS s2 FROM ({swept(src, y, xs, by, unit)})"
    return f"""SELECT {by}, var, est, pval FROM (WITH f AS ({fit}) {two_sided(f"SELECT *, est / nullif(se, 0) AS t FROM ({long})", "pval")})"""


def dropped(src: str, y: str, xs, by: str, unit: str, names=None) -> str:
    """F tests of leaving out each term of a dummy regression, its dummies too."""
    xs, k = list(xs), len(list(xs))
    f = f"SELECT *, n - g - {k} AS dof FROM ({swept(src, y, xs, by, unit)})"
    rows = [f"SELECT {by}, '{name}' AS term, 1 AS df, b{i} * b{i} / v{i}_{i} AS sum_sq, rss, dof FROM f" for i, name in enumerate(names or xs)]
    rows.append(f"SELECT {by}, '{unit}' AS term, f.g AS df, r.rss - f.rss AS sum_sq, f.rss, f.dof FROM f JOIN ({swept(src, y, xs, by, raw=True)}) r USING ({by})")
    long = f"SELECT *, CASE WHEN dof > 0 THEN sum_sq / df / (rss / dof) END AS f FROM ({' UNION ALL '.join(rows)})"
    return f"SELECT {by}, term, CAST(df AS BIGINT) AS df, sum_sq, sum_sq + rss AS rss, f, p FROM (WITH f AS ({f}) {f_tail(long, 'p', 'f', 'df', 'dof')})"


def two_stage(src: str, y: str, exog, endog, instruments, by: str, unit: str, names=None) -> str:
    """Two-stage least squares within units, one row per term."""
    exog, endog, instruments = list(exog), list(endog), list(instruments)
    xs, zs = [*exog, *endog], [*exog, *instruments]
    every, k = [y, *xs, *instruments], len(exog) + len(endog)
    some = " AND ".join(f"{c} IS NOT NULL" for c in every)
    d = f"""SELECT {by}, {unit}, {", ".join(f"{c} - avg({c}) OVER u AS {c}" for c in every)} FROM (SELECT * FROM ({src}) WHERE {some}) WINDOW u AS (PARTITION BY {by}, {unit})"""
    first = ", ".join(f"f{i} AS ({swept('SELECT * FROM d', c, zs, by, raw=True)})" for i, c in enumerate(endog))
    fitted = ", ".join(" + ".join(f"f{i}.b{q} * d.{z}" for q, z in enumerate(zs)) + f" AS hat{i}" for i in range(len(endog)))
    joins = " ".join(f"JOIN f{i} ON d.{by} = f{i}.{by}" for i in range(len(endog)))
    second = swept("SELECT * FROM h", y, [*exog, *(f"hat{i}" for i in range(len(endog)))], by, raw=True)
    resid = f"h.{y} - " + " - ".join(f"s.b{i} * h.{c}" for i, c in enumerate(xs))
    rows = " UNION ALL ".join(f"SELECT {by}, '{name}' AS term, b{i} AS est, sqrt(rss / dof * v{i}_{i}) AS se, n, dof, 1 - rss / yy AS r2 FROM t" for i, name in enumerate(names or xs))
    tested = two_sided(f"SELECT *, est / nullif(se, 0) AS t FROM ({rows})", "p")
    return f"""
    SELECT {by}, term, est, se, t, p, CAST(n AS BIGINT) AS n, CAST(dof AS BIGINT) AS dof, r2 FROM (
      WITH d AS ({d}), {first}, h AS (SELECT d.*, {fitted} FROM d {joins}), s AS ({second}),
      r AS (SELECT h.{by}, sum(({resid}) ** 2) AS rss, count(DISTINCT h.{unit}) AS g FROM h JOIN s ON h.{by} = s.{by} GROUP BY 1),
      t AS (SELECT s.* EXCLUDE (rss, g), r.rss, nullif(s.n - r.g - {k}, 0) AS dof FROM s JOIN r ON s.{by} = r.{by})
      {tested})"""


def curve(src: str, y: str, xs, by: str, unit: str, pred: str) -> str:
    """Fitted values and 95 % interval at 100 points of ``pred``: the others at their mean, the unit at its first level."""
    xs, k = list(xs), len(list(xs))
    some = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, y])
    means = ", ".join(f"avg({c}) AS u{i}" for i, c in enumerate([*xs, y]))
    rows = f"SELECT * FROM ({src}) WHERE {some}"
    first = f"SELECT * FROM (SELECT {by}, {unit}, count(*) AS n0, {means} FROM ({rows}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {unit}) = 1"
    mid = f"SELECT {by}, {', '.join(f'avg({c}) AS c{i}' for i, c in enumerate(xs))}, min({pred}) AS lo, max({pred}) AS hi FROM ({rows}) GROUP BY 1"
    fit = f"SELECT *, n - g - {k} AS dof, rss / nullif(n - g - {k}, 0) AS s2 FROM ({swept(src, y, xs, by, unit)})"
    steps = ", ".join(f"{'"at"' if c == pred else f'c{i}'} - u{i} AS d{i}" for i, c in enumerate(xs))
    line = f"u{k} + " + " + ".join(f"d{i} * b{i}" for i in range(k))
    return f"""
    SELECT {by}, "at", fit, fit - half * se AS lower, fit + half * se AS upper FROM (
      SELECT {by}, "at", half, {line} AS fit, sqrt(s2 * (1.0 / n0 + {around(k, "d")})) AS se FROM (SELECT *, {steps} FROM (
        SELECT *, lo + i * (hi - lo) / 99.0 AS "at" FROM (SELECT *, {t_975("dof")} AS half FROM ({fit})) JOIN ({first}) USING ({by}) JOIN ({mid}) USING ({by}), range(0, 100) p(i))))"""
