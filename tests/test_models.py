"""Model operators against dense numpy computations."""

import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import gamma, tails
from tidemark.operators import mixed as X
from tidemark.operators import regress as G
from tidemark.operators import relational as R
from tidemark.operators import shares as B
from tidemark.operators import smooth as A


@pytest.fixture(scope="module")
def panel():
    rnd = np.random.default_rng(5)
    rows = []
    for m in ("a", "b"):
        for u in range(12):
            ue = rnd.normal(0, 2)
            for t in range(9):
                if rnd.random() < 0.15:
                    continue
                x1, x2, z = rnd.normal(ue * 0.3), rnd.normal(t * 0.1), rnd.normal()
                x3 = 0.8 * z + rnd.normal(0, 0.5)
                y = 1.5 * x1 - 0.7 * x2 + 0.4 * x3 + ue + 0.2 * t + rnd.normal(0, 0.5)
                rows.append((m, u, t, y, x1, x2, x3, z, 2 * x1))
    df = pd.DataFrame(rows, columns="m u t y x1 x2 x3 z dup".split())
    df.loc[3, "x1"] = None
    return df


@pytest.fixture
def table(spark, panel):
    rec = [tuple(None if v != v else v for v in r) for r in panel.astype(object).itertuples(index=False, name=None)]
    return spark.createDataFrame(rec, "m string, u int, t int, y double, x1 double, x2 double, x3 double, z double, dup double")


def lstsq(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    dof = len(y) - np.linalg.matrix_rank(x)
    cov = np.linalg.pinv(x.T @ x) * (e @ e) / dof
    return b, np.sqrt(np.diag(cov)), dof, e


def by_term(df, **where):
    p = df.toPandas()
    for k, v in where.items():
        p = p[p[k] == v]
    return p.set_index("term")


def dummies(s):
    return pd.get_dummies(s).to_numpy(float)


def test_tails():
    assert abs(tails.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(tails.t_two_sided(1.959963985, 1e7) - 0.05) < 1e-6
    assert abs(tails.f_upper(3.0, 2, 20) - 0.0725381) < 1e-6
    assert abs(tails.chi2_upper(3.841458821, 1) - 0.05) < 1e-9
    assert abs(tails.chi2_upper(18.307038, 10) - 0.05) < 1e-7
    assert abs(G.t_quantile(0.975, 10) - 2.228139) < 1e-5


def test_ols(table, panel):
    p = panel[panel.m == "a"].dropna()
    b, se, dof, _ = lstsq(np.column_stack([np.ones(len(p)), p.x1, p.x2]), p.y.to_numpy())
    got = by_term(G.ols(table, "y", ["x1", "dup", "x2"], "m"), m="a")
    assert list(got.index) == ["(Intercept)", "x1", "x2"]  # the collinear column drops out
    assert np.allclose(got["est"], b) and np.allclose(got["se"], se) and set(got["dof"]) == {dof}


def test_no_intercept(table, panel):
    p = panel[panel.m == "b"].dropna()
    b, se, _, e = lstsq(p[["x1", "x2"]].to_numpy(), p.y.to_numpy())
    got = by_term(G.ols(table, "y", ["x1", "x2"], "m", intercept=False), m="b")
    assert np.allclose(got["est"], b) and np.allclose(got["se"], se)
    assert np.allclose(got["r2"], 1 - (e @ e) / (p.y @ p.y))


def test_constant_regressor_gives_no_row(spark):
    d = spark.createDataFrame([("g", float(i), 3.0, float(i % 3)) for i in range(9)], "g string, y double, c double, x double")
    assert list(by_term(G.ols(d, "y", ["c", "x"], "g")).index) == ["(Intercept)", "x"]


def test_fixed_effects_and_dummies(table, panel):
    p = panel[panel.m == "a"].dropna()
    x = np.column_stack([p[["x1", "x2"]], dummies(p.u)])
    b, se, dof, _ = lstsq(x, p.y.to_numpy())
    got = by_term(G.fixed_effects(table, "y", ["x1", "x2"], "m", "u"), m="a")
    assert np.allclose(got["est"], b[:2]) and np.allclose(got["se"], se[:2]) and set(got["dof"]) == {dof}
    eff = G.unit_effects(table, "y", ["x1", "x2"], "m", "u").where("m = 'a'").orderBy("u").toPandas()
    assert np.allclose(eff["est"], b[2:]) and np.allclose(eff["se"], se[2:])
    both = G.dummy_regression(table, "y", ["x1", "x2"], "m", "u").where("m = 'a'").toPandas()
    assert len(both) == len(b) and abs(both.set_index("var").loc["x1", "est"] - b[0]) < 1e-9


def test_two_way_unbalanced(table, panel):
    p = panel[panel.m == "b"].dropna()
    x = np.column_stack([p[["x1", "x2"]], dummies(p.u), dummies(p.t)[:, 1:]])
    b, se, dof, _ = lstsq(x, p.y.to_numpy())
    got = by_term(G.two_way_fixed_effects(table, "y", ["x1", "x2"], "u", "t", "m"), m="b")
    assert np.allclose(got["est"], b[:2], atol=1e-7) and np.allclose(got["se"], se[:2], atol=1e-7) and set(got["dof"]) == {dof}


def test_two_way_says_when_it_has_not_settled(spark):
    d = spark.createDataFrame([(u, u + k, float(u * k + u)) for u in range(12) for k in range(2)], "u int, t int, y double")
    with pytest.raises(RuntimeError):
        G.two_way_demean(d, ["y"], "u", "t", most=2, direct=0)


def split_panel():
    """Group 'split': units seen at two times each, in two blocks of years that share none; group 'full': balanced."""
    rnd = np.random.default_rng(8)
    rows = [("split", u, 100 * (u // 13) + u + k, *rnd.normal(size=4)) for u in range(26) for k in range(3)]
    rows += [("full", u, t, *rnd.normal(size=4)) for u in range(5) for t in range(6)]
    return pd.DataFrame(rows, columns="g u t y x1 x2 z".split())


def dense_two_way(p, z):
    x = p[["x1", "x2"]].to_numpy()
    d = np.column_stack([dummies(p.u), dummies(p.t)])
    left = np.eye(len(p)) - d @ np.linalg.pinv(d)
    y, x, z = left @ p.y.to_numpy(), left @ x, left @ p[z].to_numpy()
    xh = z @ np.linalg.lstsq(z, x, rcond=None)[0]
    b = np.linalg.solve(xh.T @ x, xh.T @ y)
    dof = len(p) - np.linalg.matrix_rank(d) - 2
    e = y - x @ b
    return b, np.sqrt(np.diag(np.linalg.inv(xh.T @ xh)) * (e @ e) / dof), dof


def test_two_way_on_a_split_panel(spark):
    p = split_panel()
    d = spark.createDataFrame(p)
    fe = G.two_way_fixed_effects(d, "y", ["x1", "x2"], "u", "t", "g").toPandas()
    iv = G.two_stage(d, "y", ["x1"], ["x2"], ["z"], "g", "u", "t").toPandas()
    for g, rows in p.groupby("g"):
        for got, z in ((fe, ["x1", "x2"]), (iv, ["x1", "z"])):
            b, se, dof = dense_two_way(rows, z)
            got = got[got.g == g].set_index("term").loc[["x1", "x2"]]
            assert np.allclose(got["est"], b, atol=1e-7) and np.allclose(got["se"], se, atol=1e-7) and set(got["dof"]) == {dof}


def test_two_way_steps_agree_with_the_dense_solution(spark):
    rows = [("a", u, u + k, float(u * u + 3 * k)) for u in range(3) for k in range(2)] + [("b", u, t, float(u * t)) for u in range(3) for t in range(3)]
    d = spark.createDataFrame(rows, "g string, u int, t int, y double").coalesce(1)
    steps = G.two_way_demean(d, ["y"], "u", "t", "g", most=4, direct=0)
    dense = G.two_way_demean(d, ["y"], "u", "t", "g")
    key = ["g", "u", "t"]
    assert np.allclose(steps.orderBy(*key).toPandas()["tw_y"], dense.orderBy(*key).toPandas()["tw_y"], atol=1e-7)


def test_panel_parts(spark, rows):
    d = spark.createDataFrame(
        [("a", u, t) for u, t in [(1, 1), (1, 2), (2, 3), (2, 4), (3, 4), (3, 5), (4, None), (None, 9)]] + [("b", u, u + k) for u in range(9) for k in range(2)],
        "g string, u int, t int")
    assert rows(G.panel_parts(d, "u", "t", "g"), "g", "units", "times", "parts") == [("a", 5, 7, 4), ("b", 9, 10, 1)]


@pytest.mark.parametrize("two_way", [False, True])
def test_instruments(table, panel, two_way):
    p = panel[panel.m == "a"].dropna()
    d = np.column_stack([dummies(p.u), dummies(p.t)[:, 1:]]) if two_way else dummies(p.u)
    x, z = np.column_stack([p[["x1", "x3"]], d]), np.column_stack([p[["x1", "z", "x2"]], d])
    xh = z @ np.linalg.lstsq(z, x, rcond=None)[0]
    b = np.linalg.solve(xh.T @ x, xh.T @ p.y.to_numpy())
    e = p.y.to_numpy() - x @ b
    se = np.sqrt(np.diag(np.linalg.inv(xh.T @ xh)) * (e @ e) / (len(p) - x.shape[1]))
    got = by_term(G.two_stage(table, "y", ["x1"], ["x3"], ["z", "x2"], "m", "u", "t" if two_way else None), m="a")
    assert np.allclose(got["est"], b[:2], atol=1e-6) and np.allclose(got["se"], se[:2], atol=1e-6)


def test_serial_correlation(spark):
    rnd = np.random.default_rng(0)
    rows = []
    for m, rho in (("ar", 0.7), ("white", 0.0)):
        for u in range(20):
            e = 0.0
            for t in range(30):
                e = rho * e + rnd.normal()
                x = rnd.normal()
                rows.append((m, u, t, x + u + e, x))
    d = spark.createDataFrame([(a, b, c, float(y), float(x)) for a, b, c, y, x in rows], "m string, u int, t int, y double, x double")
    got = G.serial_correlation(d, "y", ["x"], "m", "u", "t").toPandas().set_index("m")
    assert got.loc["ar", "p"] < 1e-6 < 0.001 < got.loc["white", "p"]


def test_drop_one(table, panel):
    p = panel[panel.m == "a"].dropna()
    y = p.y.to_numpy()
    full = np.column_stack([p[["x1", "x2"]], dummies(p.u)])
    rss = lambda x: (lstsq(x, y)[3] ** 2).sum()
    got = by_term(G.drop_one(table, "y", ["x1", "x2"], "m", "u"), m="a")
    assert np.isclose(got.loc["x1", "rss"], rss(full[:, 1:])) and np.isclose(got.loc["u", "rss"], rss(full[:, :2]))
    dof = len(y) - full.shape[1]
    f = (rss(full[:, :2]) - rss(full)) / 12 / (rss(full) / dof)
    assert np.isclose(got.loc["u", "f"], f) and got.loc["u", "df"] == 12


def test_effect_curve(table, panel):
    p = panel[panel.m == "a"].dropna()
    x = np.column_stack([p[["x1", "x2"]], dummies(p.u)])
    y = p.y.to_numpy()
    b, _, dof, e = lstsq(x, y)
    at = np.zeros(x.shape[1])
    at[:3] = p.x1.min(), p.x2.mean(), 1
    se = np.sqrt(at @ np.linalg.pinv(x.T @ x) @ at * (e @ e) / dof)
    first = G.effect_curve(table, "y", ["x1", "x2"], "m", "u", "x1").where("m = 'a'").orderBy("at").first()
    assert np.isclose(first["fit"], at @ b) and np.isclose(first["upper"] - first["fit"], G.t_quantile(0.975, dof) * se)


def dense_reml(y, x, zs, ratios):
    v = np.eye(len(y)) + sum(r * z @ z.T for r, z in zip(ratios, zs))
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    b = np.linalg.solve(a, x.T @ vi @ y)
    e = y - x @ b
    k = len(y) - x.shape[1]
    s2 = e @ vi @ e / k
    return k * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], b, s2, np.linalg.inv(a) * s2


def test_random_intercept(table, panel):
    got = X.random_intercepts(table, "y", ["x1", "x2"], "m", "u").where("m = 'a'").toPandas().set_index("term")
    p = panel[panel.m == "a"].dropna()
    y, x, z = p.y.to_numpy(), np.column_stack([np.ones(len(p)), p.x1, p.x2]), dummies(p.u)
    ratio = got.loc["u", "est"] / got.loc["residual", "est"]
    best = min(dense_reml(y, x, [z], [r])[0] for r in np.geomspace(ratio / 4, ratio * 4, 161))
    crit, b, s2, cov = dense_reml(y, x, [z], [ratio])
    assert crit < best + 1e-3
    assert np.allclose(got.loc[["(Intercept)", "x1", "x2"], "est"].astype(float), b) and np.isclose(got.loc["residual", "est"], s2)
    assert np.allclose(got.loc[["(Intercept)", "x1", "x2"], "se"].astype(float), np.sqrt(np.diag(cov)))


def test_crossed_intercepts(table, panel):
    got = X.random_intercepts(table, "y", ["x1"], "m", "u", "t").where("m = 'b'").toPandas().set_index("term")
    p = panel[panel.m == "b"].dropna()
    y, x, zs = p.y.to_numpy(), np.column_stack([np.ones(len(p)), p.x1]), [dummies(p.u), dummies(p.t)]
    s2 = got.loc["residual", "est"]
    r = [got.loc["u", "est"] / s2, got.loc["t", "est"] / s2]
    crit, b, s, _ = dense_reml(y, x, zs, r)
    around = [dense_reml(y, x, zs, [r[0] * i, max(r[1], 1e-6) * j])[0] for i in (0.8, 1.25, 1) for j in (0.8, 1.25, 1)]
    assert crit < min(around) + 1e-3 and np.allclose(got.loc[["(Intercept)", "x1"], "est"].astype(float), b) and np.isclose(s, s2)


@pytest.mark.parametrize("direct", [40, 10])
def test_crossed_levels_from_the_data(spark, direct):
    # 30 x 12 levels, cells of different sizes; with room for 10 nothing can be dense, with 40 the areas are
    rnd = np.random.default_rng(11)
    ue, te = rnd.normal(0, 1.5, 30), rnd.normal(0, 0.8, 12)
    rec = [(u, f"area {t}", float(x), 5 + 0.7 * x + ue[u] + te[t] + rnd.normal(0, 0.6))
           for u in range(30) for t in range(12) for x in rnd.normal(100, 2, rnd.integers(0, 4))]
    d = spark.createDataFrame([("m", *r[:3], float(r[3])) for r in rec], "m string, u int, area string, x double, y double").repartition(4)
    if direct == 10:
        with pytest.raises(ValueError, match="more than 10 levels"):
            X.random_intercepts(d, "y", ["x"], "m", "u", "area", direct=direct)
        return
    got = X.random_intercepts(d, "y", ["x"], "m", "u", "area").toPandas()
    swapped = X.random_intercepts(d, "y", ["x"], "m", "area", "u", direct=12).toPandas()  # u has too many, so areas are dense
    pdf = pd.DataFrame(rec, columns=["u", "area", "x", "y"])
    y, x, zs = pdf.y.to_numpy(), np.column_stack([np.ones(len(pdf)), pdf.x]), [dummies(pdf.u), dummies(pdf.area)]
    for g in (got, swapped):
        fixed, var = g[g.kind == "fixed"].set_index("term"), g[g.kind == "variance"].set_index("term").est
        r = [var["u"] / var["residual"], var["area"] / var["residual"]]
        crit, b, s2, cov = dense_reml(y, x, zs, r)
        assert np.allclose(fixed.est, b) and np.allclose(fixed.se, np.sqrt(np.diag(cov))) and np.isclose(var["residual"], s2)
        assert crit < min(dense_reml(y, x, zs, [r[0] * i, r[1] * j])[0] for i in (0.98, 1, 1.02) for j in (0.98, 1, 1.02)) + 1e-5
        effect = g[g.kind == "effect"].set_index("term").est
        v = np.eye(len(y)) + sum(q * z @ z.T for q, z in zip(r, zs))
        want = r[1] * zs[1].T @ np.linalg.solve(v, y - x @ b)
        assert len(effect) == 12 and np.allclose(effect[sorted(set(pdf.area))], want)
    assert np.allclose(got[got.kind == "fixed"].dof, swapped[swapped.kind == "fixed"].dof, rtol=0.01)


def test_degrees_of_freedom_of_balanced_designs(spark):
    # known exactly: groups - 1 for the mean, n - groups - 1 for a regressor that is the same within each group
    rnd = np.random.default_rng(12)
    rec = [(m, g, float(x), float(e + 2 * x + rnd.normal(0, 1))) for m in ("a", "b") for g in range(15) for e in [rnd.normal(0, 3 if m == "a" else 2)] for x in (-1, 0, 1, 2, -2)]
    rec += [("short", 1, 1.0, 2.0), ("short", 2, 1.0, 3.0), ("flat", 1, 1.0, 2.0), ("flat", 1, 1.0, 4.0), ("flat", 2, 1.0, 3.0), ("none", None, 1.0, 2.0)]
    d = spark.createDataFrame(rec, "m string, g int, x double, y double")
    got = X.random_intercepts(d, "y", ["x"], "m", "g").toPandas().set_index(["m", "term"])
    for m in ("a", "b"):
        assert np.isclose(got.loc[(m, "(Intercept)"), "dof"], 14, rtol=0.01) and np.isclose(got.loc[(m, "x"), "dof"], 75 - 15 - 1, rtol=0.01)
        p = [r for r in rec if r[0] == m]
        y, g = np.array([r[3] for r in p]), np.array([r[1] for r in p])
        means = np.array([y[g == i].mean() for i in range(15)])
        assert np.isclose(got.loc[(m, "(Intercept)"), "se"], means.std(ddof=1) / 15**0.5, rtol=1e-3)
    assert got.loc[["short", "flat"]].est.isna().all() and "none" not in got.index
    twice = d.withColumn("z", 3 * d.x)
    assert X.random_intercepts(twice, "y", ["x", "z"], "m", "g").toPandas().est.isna().all()


def test_additive_random_moves_only_sums(spark, monkeypatch):
    """A group is stored as one row of column sums, not as cross products, and one model's groups are not gathered in a task."""
    stored = []
    monkeypatch.setattr(A, "cut", lambda df: stored.append(real(df)) or stored[-1])
    monkeypatch.setattr(A, "merge_few", lambda a, b, by: joins.append(few(a, b, by)) or joins[-1])
    real, few, joins = session.cut, R.merge_few, []
    rnd = np.random.default_rng(23)
    d = spark.createDataFrame([(u, float(x), float(x + e + rnd.normal())) for u in range(40) for e in [rnd.normal()] for x in rnd.uniform(size=9)], "u int, x double, y double")
    assert A.additive_random(d.withColumn("g", F.lit(1)), "y", ["x"], "g", "u").count() == 3
    units = [t for t in stored if "u" in t.columns and "sums" in t.columns]
    assert len(units) == 1 and units[0].count() == 40 and units[0].agg(F.max(F.size("sums"))).first()[0] == 2 + A.BASIS
    assert joins and all("SortMergeJoin" not in j._jdf.queryExecution().toString() for j in joins)


def test_ratios_that_settle_in_different_rounds(spark):
    """A settled model keeps its ratio while others are still searched."""
    rnd = np.random.default_rng(21)
    rec = [(m, u, x, float(2 * x + ue + rnd.normal())) for m, sd in enumerate((0.05, 0.4, 4.0, 400.0)) for u in range(30)
           for ue in [rnd.normal(0, sd)] for x in rnd.normal(size=8).tolist()]
    d = spark.createDataFrame(rec, "m int, u int, x double, y double")
    got = X.random_intercepts(d, "y", ["x"], "m", "u").toPandas().set_index(["m", "term"]).est
    for m in range(4):
        p = [r for r in rec if r[0] == m]
        y, x, z = np.array([r[3] for r in p]), np.column_stack([np.ones(240), [r[2] for r in p]]), np.eye(30)[[r[1] for r in p]]
        r = got[m, "u"] / got[m, "residual"]
        around = [dense_reml(y, x, [z], [r * i + j])[0] for i, j in ((0.98, 0), (1.02, 0), (1, 1e-3))]
        assert dense_reml(y, x, [z], [r])[0] < min(around) + 1e-5


def test_ratios_that_rounding_cannot_tell_apart():
    """Equal criteria end a search at zero or in their middle, not at whichever rounding favours."""
    rnd = np.random.default_rng(22)
    noise = 1e6 + 1e-10 * rnd.normal(size=10)
    assert X._lowest([0.0, *np.geomspace(1e-12, 1e-8, 9)], noise, 1e6) == (0, False)
    at, flat = X._lowest(np.geomspace(1e-3, 1.1e-3, 10), noise, 1e6)
    assert at == 5 and flat
    assert X._lowest([0.0, 0.1, 0.2, 0.3], [4.0, 2.0, 1.0, 3.0], 10.0) == (2, False)


def test_additive_finds_the_curve(spark):
    rnd = np.random.default_rng(3)
    x, z = rnd.uniform(0, 1, 600), rnd.uniform(0, 1, 600)
    y = np.sin(6 * x) + rnd.normal(0, 0.2, 600)
    d = spark.createDataFrame([("g", *map(float, r)) for r in zip(y, x, z)], "g string, y double, x double, z double").repartition(5)
    got = A.additive(d, "y", ["x", "z"], "g").toPandas().set_index("var")
    assert got.loc["s(x)", "edf"] > 3 and got.loc["s(x)", "pval"] < 1e-10
    assert got.loc["s(z)", "edf"] < 3 and got.loc["s(z)", "pval"] > 1e-3
    assert abs(got["scale"].iloc[0] - 0.04) < 0.01


def test_blocks_are_the_whole_cross_product(spark):
    rnd = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": "g", "y": rnd.normal(size=50), "x": rnd.uniform(2, 3, 50)})
    rows = A.with_ranges(spark.createDataFrame(pdf).repartition(4), "y", ["x"], [], "g")
    r = A.blocks(rows, "y", ["x"], [], "g").first()
    b = A.basis(pdf.x.to_numpy(), np.full(50, pdf.x.min()), np.full(50, pdf.x.max()))
    assert np.allclose(b.sum(1), 1)
    z = np.column_stack([np.ones(50), b, pdf.y])
    assert r.n == 50 and np.allclose(G.full(r.sums, 12), z.T @ z)


def test_logit_smooth(spark):
    rnd = np.random.default_rng(6)
    x = rnd.uniform(0, 1, 800)
    mu = 1 / (1 + np.exp(-(4 * x - 2)))
    y = np.clip(mu + rnd.normal(0, 0.05, 800), 1e-5, 1 - 1e-5)
    d = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(y, x)], "g string, y double, x double")
    got = A.additive_logit(d, "y", ["x"], "g", passes=4).first()
    assert got["pval"] < 1e-8 and got["edf"] < 4


@pytest.mark.parametrize("sd", [0.55, 0.75, 0.95])
def test_additive_random_intercept(spark, sd):
    """Within 5 % of a dense restricted-likelihood fit of the straight line behind the data."""
    rnd = np.random.default_rng(8)
    u = np.repeat(np.arange(60), 10)
    x = rnd.uniform(0, 1, len(u))
    y = 2 * x + rnd.normal(0, sd, 60)[u] + rnd.normal(0, 0.5, len(u))
    d = spark.createDataFrame(pd.DataFrame({"g": "g", "u": u, "y": y, "x": x}))
    got = A.additive_random(d, "y", ["x"], "g", "u").toPandas().set_index("var")["scale"]
    z, b = dummies(u), np.column_stack([np.ones(len(u)), x])

    def crit(ratio):
        v = np.eye(len(u)) + ratio * z @ z.T
        vb = np.linalg.solve(v, b)
        r = y - b @ np.linalg.solve(b.T @ vb, vb.T @ y)
        s2 = r @ np.linalg.solve(v, r) / (len(u) - 2)
        return (len(u) - 2) * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(b.T @ vb)[1], ratio * s2, s2

    _, group, left = min(crit(t) for t in np.geomspace(0.1, 20, 60))
    assert abs(got["variance(u)"] / group - 1) < 0.05 and abs(got["variance(residual)"] / left - 1) < 0.05


def test_group_too_small_for_a_fit_keeps_its_rows(spark):
    rows = [("big", float(i % 17), float(i % 7)) for i in range(80)] + [("small", 1.0, 2.0), ("small", 2.0, 3.0)]
    d = spark.createDataFrame(rows, "g string, x double, y double").withColumn("z", pd_lit())
    got = {(r["g"], r["var"]): r for r in A.additive(d, "y", ["x"], "g", ["z"]).collect()}
    assert set(got) == {(g, v) for g in ("big", "small") for v in ("s(x)", "z")}
    assert got["small", "s(x)"]["edf"] is None and got["small", "z"]["n"] == 2 and got["big", "s(x)"]["edf"] > 0


def pd_lit():
    from pyspark.sql import functions as F

    return F.sin(F.col("x") * 3)


def test_gamma_and_derivatives():
    x = np.geomspace(1e-6, 1e6, 200)
    assert np.allclose(gamma.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    h = 1e-4 * x
    assert np.allclose(gamma.digamma(x), (gamma.lgamma(x + h) - gamma.lgamma(x - h)) / (2 * h), rtol=1e-6, atol=1e-6)
    assert np.allclose(gamma.trigamma(x), (gamma.digamma(x + h) - gamma.digamma(x - h)) / (2 * h), rtol=1e-6, atol=1e-6)
    assert abs(gamma.digamma(1.0) + 0.5772156649015329) < 1e-13 and abs(gamma.trigamma(1.0) - math.pi**2 / 6) < 1e-13


def likelihood(x, y, v):
    phi = math.exp(v[-1])
    mu = 1 / (1 + np.exp(-(x @ v[:-1])))
    lg = np.vectorize(math.lgamma)
    return (math.lgamma(phi) - lg(mu * phi) - lg((1 - mu) * phi) + (mu * phi - 1) * np.log(y) + ((1 - mu) * phi - 1) * np.log(1 - y)).sum()


def climbed(f, v):
    """Newton's steps with numeric derivatives to the maximum of ``f``; also the Hessian there."""
    d, h = np.eye(len(v)), 1e-3
    for _ in range(40):
        g = np.array([(f(v + h * e) - f(v - h * e)) / (2 * h) for e in d])
        hess = np.array([[(f(v + h * (a + b)) - f(v + h * (a - b)) - f(v - h * (a - b)) + f(v - h * (a + b))) / (4 * h * h) for b in d] for a in d])
        step = np.linalg.solve(hess, g)
        v = v - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return v, hess


def test_beta_regression_is_the_dense_maximum(spark):
    rnd = np.random.default_rng(12)
    rec, dense = [], {}
    for g, phi in (("loose", 0.7), ("middle", 5.0), ("tight", 200.0)):
        x, z = rnd.normal(size=300), rnd.normal(size=300)
        mu = 1 / (1 + np.exp(-(0.3 + 0.8 * x - 0.4 * z)))
        y = np.clip(rnd.beta(mu * phi, (1 - mu) * phi), 1e-5, 1 - 1e-5)
        design = np.column_stack([np.ones(300), x, z])
        dense[g] = climbed(lambda v: likelihood(design, y, v), np.array([0.3, 0.8, -0.4, math.log(phi)]))[0], design, y
        rec += [(g, *map(float, r)) for r in zip(y, x, z)]
    rec += [("few", 0.5, 1.0, 2.0), ("few", 0.4, 2.0, 1.0), ("few", None, 2.0, 1.0)]
    d = spark.createDataFrame(rec, "g string, y double, x double, z double").repartition(7)
    got = B.additive_beta(d, "y", [], "g", ["x", "z"]).toPandas().set_index(["g", "var"])
    for g, (v, design, y) in dense.items():
        r = got.loc[g]
        assert r.settled.all() and (r.gap < 1e-8).all()
        assert np.allclose(r.loc[["x", "z"], "est"].astype(float), v[1:3], rtol=1e-4, atol=1e-4)
        assert np.allclose(r.phi, math.exp(v[3]), rtol=1e-4) and np.allclose(r.loglik, likelihood(design, y, v), atol=1e-4)
    few = got.loc["few"]
    assert few.est.isna().all() and few.n.eq(2).all() and few.settled.isna().all()


def test_beta_smooths(spark):
    """The curve, the precision and the maximum of the penalised likelihood; shares of 0 and 1 are moved inside."""
    rnd = np.random.default_rng(13)
    x, z = rnd.uniform(0, 1, 900), rnd.uniform(0, 1, 900)
    mu = 1 / (1 + np.exp(-2 * np.sin(6 * x)))
    y = rnd.beta(20 * mu, 20 * (1 - mu))
    rec = [("a", *map(float, r)) for r in zip(y, x, z)] + [("b", float(rnd.integers(0, 2)), float(v), float(w)) for v, w in zip(x, z)]
    d = spark.createDataFrame(rec, "g string, y double, x double, z double").repartition(5)
    got = B.additive_beta(d, "y", ["x", "z"], "g").toPandas().set_index(["g", "var"])
    assert got.settled.all()
    a = got.loc["a"]
    assert a.loc["s(x)", "edf"] > 4 and a.loc["s(x)", "pval"] < 1e-10 and a.loc["s(z)", "pval"] > 1e-3 and a.loc["s(z)", "edf"] < 3
    assert abs(a.phi.iloc[0] / 20 - 1) < 0.15
    # ends only, far from each other: as imprecise as shares can be
    assert got.loc["b"].phi.iloc[0] < 0.5


def test_beta_steps_end_at_the_penalised_maximum():
    rnd = np.random.default_rng(14)
    x = rnd.uniform(0, 1, 400)
    mu = 1 / (1 + np.exp(-np.cos(5 * x)))
    y = np.clip(rnd.beta(3 * mu, 3 * (1 - mu)), 1e-5, 1 - 1e-5)
    z = np.column_stack([np.ones(400), A.basis(x, np.full(400, x.min()), np.full(400, x.max()))])
    r = dict.fromkeys(B.STATE) | {"n": 400.0, "go": [0.0] * 11 + [0.0], "chosen": False, "halved": 0, "passes": 0, "done": False}
    while not r["done"]:
        r = B._advance(r | {"found": B.scores(z, y, np.asarray(r["go"]))}, ["x"], [], 1e-12, 12)
    assert r["passes"] < 40

    def penalised(v):
        return likelihood(z, y, v) - 0.5 * r["lam"][0] * r["norm"][0] * (np.diff(v[1:11], n=2) ** 2).sum()

    at, top = np.asarray(r["at"]), penalised(np.asarray(r["at"]))
    for _ in range(50):
        assert penalised(at + rnd.normal(0, 1e-3, len(at))) <= top + 1e-9
    slope = [(penalised(at + 1e-4 * e) - penalised(at - 1e-4 * e)) / 2e-4 for e in np.eye(len(at))]
    assert np.abs(slope).max() < 1e-3


def test_absorbed_dummies_are_the_dense_dummies(spark):
    rnd = np.random.default_rng(15)
    u = np.concatenate([rnd.integers(0, 25, 400), [25]])
    x, z, w = rnd.uniform(0, 1, 401) + u / 10, rnd.uniform(0, 1, 401), 50 + rnd.normal(size=401)
    y = 1000 + np.sin(4 * x) + 0.3 * w + rnd.normal(0, 2, 26)[u] + rnd.normal(0, 0.3, 401)
    rec = [("m", int(a), *map(float, r)) for a, *r in zip(u, y, x, z, w)] + [("small", 1, 1.0, 2.0, 3.0, 4.0), (None, 1, 1.0, None, 3.0, 4.0)]
    d = spark.createDataFrame(rec, "g string, u int, y double, x double, z double, w double").repartition(6)
    got = A.additive_absorbed(d, "y", ["x", "z"], "g", "u", ["w"]).toPandas().set_index(["g", "var"])
    assert got.loc["small"].edf.isna().all() and len(got) == 6
    got = got.loc["m"]
    dum = dummies(u)
    out = dum @ np.linalg.solve(dum.T @ dum, dum.T)
    cols, pens = [dum, w[:, None]], [np.zeros((26, 26)), np.zeros((1, 1))]
    for s, v in (("x", x), ("z", z)):
        b = A.basis(v, np.full(401, v.min()), np.full(401, v.max()))
        q = np.linalg.qr(np.column_stack([b.sum(0), np.eye(10)[:, :9]]))[0][:, 1:]
        c, d2 = b @ q, np.diff(np.eye(10), n=2, axis=0) @ q
        p = d2.T @ d2
        cols.append(c)
        pens.append(10 ** got.loc[f"s({s})", "log10_lambda"] * p * np.trace(c.T @ (c - out @ c)) / np.trace(p))
    big, pen = np.hstack(cols), np.zeros((45, 45))
    at = 0
    for p in pens:
        pen[at : at + len(p), at : at + len(p)] = p
        at += len(p)
    inv = np.linalg.inv(big.T @ big + pen)
    beta, edf = inv @ big.T @ y, np.diag(inv @ big.T @ big)
    rss, dof = ((y - big @ beta) ** 2).sum(), 401 - edf.sum()
    assert np.allclose(got["scale"], rss / dof, rtol=1e-5) and np.allclose(got["gcv"], 401 * rss / dof**2, rtol=1e-5)
    assert np.allclose(got.loc[["s(x)", "s(z)"], "edf"], [edf[27:36].sum(), edf[36:].sum()], rtol=1e-4)
    assert np.isclose(got.loc["w", "chi"], beta[26] ** 2 / (inv[26, 26] * rss / dof), rtol=1e-4)
    assert got.loc["s(x)", "edf"] > 2 and (got.n == 401).all()
