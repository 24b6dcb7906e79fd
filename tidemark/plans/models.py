"""Regression, panel, instrument, mixed and additive models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import squeeze
from ..operators import mixed as X
from ..operators import panel as P
from ..operators import regress as G
from ..operators import relational as R
from ..operators import shares as B
from ..operators import smooth as A
from ..session import cut
from . import fits as Q
from .registry import VIEWS, query
from .shift import around, bias_and_intensity, edge_and_intensity
from .survey import growth

UNIT = ["spp", "lat_bin"]

VIEWS["v_lag"] = """
    SELECT *, lag(land_mt) OVER w AS lag1_land, lag(land_mt, 2) OVER w AS lag2_land, lag(wtcpuenal) OVER w AS lag1_bio, lag(pres2) OVER w AS lag1_pres, lag("SBT") OVER w AS lag1_sbt, lag("SST") OVER w AS lag1_sst
    FROM v_bio_panel WINDOW w AS (PARTITION BY spp, lat_bin ORDER BY year)"""


def lagged(v):
    d = P.row_shift(v.bio_panel(), UNIT, "year", {
        "lag1_land": ("land_mt", 1), "lag1_bio": ("wtcpuenal", 1), "lag1_pres": ("pres2", 1), "lag1_sbt": ("SBT", 1), "lag1_sst": ("SST", 1),
        "lag2_land": ("land_mt", 2),
    })
    return cut(d)


def two(src, y, a, b, by, unit=None, raw=False):
    """SQL of a fit on two regressors by Cramer's rule: b1, b2 and totals."""
    src = f'SELECT * FROM ({src}) WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL'
    keys = f"{by}, {unit}" if unit else by
    pairs = {"yy": (y, y), "ya": (y, a), "yb": (y, b), "aa": (a, a), "ab": (a, b), "bb": (b, b)}
    one = ", ".join(f"sum({p} * {q}) AS s{k}" if raw else f"covar_pop({p}, {q}) * count(*) AS s{k}" for k, (p, q) in pairs.items())
    outer = ", ".join(f"sum(s{k}) AS s{k}" for k in pairs)
    return f"""
    SELECT *, syy - b1 * sya - b2 * syb AS rss FROM (SELECT *, (sya * sbb - syb * sab) / (saa * sbb - sab * sab) AS b1, (syb * saa - sya * sab) / (saa * sbb - sab * sab) AS b2 FROM (
      SELECT {by}, sum(n) AS n, count(*) AS g, {outer}, sum(n * my) / sum(n) AS my, sum(n * ma) / sum(n) AS ma, sum(n * mb) / sum(n) AS mb FROM (
        SELECT {keys}, count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, {one} FROM ({src}) GROUP BY {keys}) GROUP BY {by}))"""


def terms(sql, by, names, lost, intercept=False):
    """Long form of ``two``: estimate, standard error, n, dof, r2 per term."""
    dof = f"(n - {lost} - 2)"
    s2 = f"rss / {dof}"
    det = "(saa * sbb - sab * sab)"
    tail = f"CAST(n AS BIGINT) AS n, CAST({dof} AS BIGINT) AS dof, 1 - rss / syy AS r2 FROM ({sql})"
    parts = [
        f"SELECT {by}, '{names[0]}' AS term, b1 AS est, sqrt({s2} * sbb / {det}) AS se, {tail}",
        f"SELECT {by}, '{names[1]}' AS term, b2 AS est, sqrt({s2} * saa / {det}) AS se, {tail}",
    ]
    if intercept:
        var = f"{s2} * (1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / {det})"
        parts.append(f"SELECT {by}, '(Intercept)' AS term, my - b1 * ma - b2 * mb AS est, sqrt({var}) AS se, {tail}")
    return " UNION ALL ".join(parts)


def fit(df, *by):
    return df.select(*by, "term", "est", "se", "n", "dof", "r2")


_LINES = "SELECT l_returnflag AS flag, l_extendedprice / 1000 AS y, l_quantity AS q, l_discount * 100 AS d FROM lineitem"


def _lines(v):
    return v.table("lineitem").select(
        F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("q"),
        (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"),
    )


@query("k2_multiple_regression", terms(two(_LINES, "y", "q", "d", "flag"), "flag", ("q", "d"), 1, True), fl="est se r2")
def _(v):
    return fit(G.ols(_lines(v), "y", ["q", "d"], "flag"), "flag")


@query("k2_regression_full", Q.all_terms("SELECT l_returnflag AS flag, l_extendedprice / 1000 AS y, l_quantity AS q, l_discount * 100 AS d, l_tax * 100 AS t FROM lineitem",
                                         "y", ["q", "d", "t"], "flag", intercept=True), fl="est se t:4 p r2")
def _(v):
    return G.ols(_lines(v), "y", ["q", "d", "t"], "flag")


@query("k3_no_intercept", terms(two(_LINES, "y", "q", "d", "flag", raw=True), "flag", ("q", "d"), 0), fl="est se r2")
def _(v):
    return fit(G.ols(_lines(v), "y", ["q", "d"], "flag", intercept=False), "flag")


@query("k3_growth_model", Q.all_terms("SELECT * FROM v_percap WHERE season = 'fall'", "percap_log", ["sbt_diff", "bio_mt", '"logLB"'], "spp", ["sbt_diff", "bio_mt", "logLB"]),
       fl="est:5 se:5 t:4 p:5 r2")
def _(v):
    d = growth(v).where(F.col("season") == "fall")
    return G.ols(d, "percap_log", ["sbt_diff", "bio_mt", "logLB"], "spp", intercept=False)


_PANEL = 'SELECT spp, lat_bin, year, wtcpuenal AS y, "SBT" AS sbt, land_mt FROM v_bio_panel'


@query("k4_dummy_regression", f"""
    WITH f AS ({two(_PANEL, 'y', 'sbt', 'land_mt', 'spp', 'lat_bin')}),
    u AS (SELECT spp, lat_bin, avg(y) AS my, avg(sbt) AS ma, avg(land_mt) AS mb FROM ({_PANEL}) WHERE y IS NOT NULL AND sbt IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT spp, avg(land_mt) AS mean_land FROM v_bio_panel GROUP BY 1),
    t AS (SELECT spp, 'SBT' AS var, b1 AS est FROM f UNION ALL SELECT spp, 'land_mt', b2 FROM f
      UNION ALL SELECT spp, 'lat_bin' || CAST(u.lat_bin AS VARCHAR), u.my - b1 * u.ma - b2 * u.mb FROM u JOIN f USING (spp))
    SELECT spp, var, est, mean_land FROM t JOIN l USING (spp)""", fl="est mean_land")
def _(v):
    d = v.bio_panel()
    return G.dummy_regression(d, "wtcpuenal", ["SBT", "land_mt"], "spp", "lat_bin", {"mean_land": F.avg("land_mt")}).drop("pval")


_LAG = 'SELECT spp, lat_bin, wtcpuenal AS bio, "SBT" AS sbt, "SST" AS sst, depth, lag1_bio, lag1_land, lag2_land, land_mt FROM v_lag'


def _lag_terms(*more):
    return Q.dummy_terms(_LAG, "bio", ["sbt", "sst", "depth", "lag1_bio", *more], "spp", "lat_bin", ["SBT", "SST", "depth", "lag1_bio", *more])


@query("k4_dummy_regression_lagged", f"""
    SELECT t.*, mean_land FROM ({_lag_terms("lag2_land")}) t JOIN (SELECT spp, avg(land_mt) AS mean_land FROM v_lag GROUP BY 1) USING (spp)""", fl="est:5 pval mean_land")
def _(v):
    return G.dummy_regression(lagged(v), "wtcpuenal", ["SBT", "SST", "depth", "lag1_bio", "lag2_land"], "spp", "lat_bin", {"mean_land": F.avg("land_mt")})


@query("k5_significant_terms", f"""
    SELECT t.*, w.* FROM ({_lag_terms("land_mt")}) t JOIN (VALUES ('land_mt', -1, 0.05::DOUBLE), ('land_mt', 1, 0.05::DOUBLE), ('lag1_bio', -1, 0.1::DOUBLE), ('lag1_bio', 1, 0.1::DOUBLE)) w(term, sign, alpha)
    ON t.var = w.term AND sign(t.est) = w.sign AND t.pval < w.alpha""".replace("w.*", "w.sign, w.alpha"), fl="est:5 pval")
def _(v):
    t = G.dummy_regression(lagged(v), "wtcpuenal", ["SBT", "SST", "depth", "lag1_bio", "land_mt"], "spp", "lat_bin")
    t = cut(t)
    wanted = [("land_mt", -1, 0.05), ("land_mt", 1, 0.05), ("lag1_bio", -1, 0.1), ("lag1_bio", 1, 0.1)]
    return R.stack(*[G.significant(t, c, s, a).withColumns({"sign": F.lit(s), "alpha": F.lit(a)}) for c, s, a in wanted])


@query("k6_fixed_effects", terms(two(_PANEL, "y", "sbt", "land_mt", "spp", "lat_bin"), "spp", ("SBT", "land_mt"), "g"), fl="est:5 se:5 r2")
def _(v):
    return fit(G.fixed_effects(v.bio_panel(), "wtcpuenal", ["SBT", "land_mt"], "spp", "lat_bin"), "spp")


@query("k6_fixed_effects_events", terms(two("SELECT grp, user_id, y, x, clicks FROM v_panel", "y", "x", "clicks", "grp", "user_id"), "grp", ("x", "clicks"), "g"), fl="est se r2")
def _(v):
    return fit(G.fixed_effects(v.panel(), "y", ["x", "clicks"], "grp", "user_id"), "grp")


_TW = ", ".join(
    f"{c} - avg({c}) OVER (PARTITION BY spp, lat_bin) - avg({c}) OVER (PARTITION BY spp, year) + avg({c}) OVER (PARTITION BY spp) AS {c}"
    for c in ("y", "sbt", "sst")
)
_TWP = f'SELECT spp, lat_bin, year, {_TW} FROM (SELECT spp, lat_bin, year, pres2 AS y, "SBT" AS sbt, "SST" AS sst FROM v_bio_panel)'


@query("k7_two_way_effects", f"""
    WITH d AS ({_TWP}), t AS (SELECT spp, count(DISTINCT lat_bin) + count(DISTINCT year) - 1 AS lost FROM d GROUP BY 1)
    {terms("SELECT * FROM (" + two("SELECT * FROM d", "y", "sbt", "sst", "spp", raw=True) + ") JOIN t USING (spp)", "spp", ("SBT", "SST"), "lost")}""", fl="est se r2")
def _(v):
    return fit(G.two_way_fixed_effects(v.bio_panel(), "pres2", ["SBT", "SST"], "lat_bin", "year", "spp"), "spp")


@query("k7_two_way_unbalanced")
def _(v):
    d = v.panel()
    return G.two_way_fixed_effects(d, "y", ["x", "clicks"], "user_id", "day", "grp")


@query("k8_unit_effects", f"""
    SELECT spp, lat_bin, u.my - b1 * u.ma - b2 * u.mb AS est FROM (SELECT spp, lat_bin, avg(y) AS my, avg(sbt) AS ma, avg(land_mt) AS mb FROM ({_PANEL}) WHERE y IS NOT NULL AND sbt IS NOT NULL GROUP BY 1, 2) u
    JOIN ({two(_PANEL, 'y', 'sbt', 'land_mt', 'spp', 'lat_bin')}) f USING (spp)""", fl="est")
def _(v):
    return G.unit_effects(v.bio_panel(), "wtcpuenal", ["SBT", "land_mt"], "spp", "lat_bin").select("spp", "lat_bin", "est")


_FE = """
    SELECT spp, pres2 - avg(pres2) OVER u AS fy, lag1_land - avg(land_mt) OVER u AS fland, "SBT" - avg("SBT") OVER u AS fsbt FROM v_lag WINDOW u AS (PARTITION BY spp, lat_bin)"""


@query("k9_manual_fixed_effects", terms(two(_FE, "fy", "fland", "fsbt", "spp"), "spp", ("fe_lag1_land", "fe_SBT"), 1, True), fl="est se r2")
def _(v):
    d = P.demean(lagged(v), UNIT, ["pres2", "lag1_land", "SBT"], mean_of={"lag1_land": "land_mt"})
    return fit(G.ols(d, "fe_pres2", ["fe_lag1_land", "fe_SBT"], "spp"), "spp")


_FD = """SELECT spp, wtcpuenal - lag1_bio AS dy, "SBT" - lag1_sbt AS dsbt, land_mt - lag1_land AS dland FROM v_lag"""


@query("k10_first_differences", terms(two(_FD, "dy", "dsbt", "dland", "spp"), "spp", ("sbt_delta", "land_delta"), 1, True), fl="est se r2")
def _(v):
    d = lagged(v).withColumns({
        "bio_delta": F.col("wtcpuenal") - F.col("lag1_bio"), "sbt_delta": F.col("SBT") - F.col("lag1_sbt"),
        "land_delta": F.col("land_mt") - F.col("lag1_land"),
    })
    return fit(G.ols(d, "bio_delta", ["sbt_delta", "land_delta"], "spp"), "spp")


@query("k11_instruments", """
    WITH d AS (SELECT grp, y - avg(y) OVER u AS y, x - avg(x) OVER u AS x, clicks - avg(clicks) OVER u AS z FROM v_panel WINDOW u AS (PARTITION BY grp, user_id))
    SELECT grp, 'x' AS term, sum(z * y) / sum(z * x) AS est FROM d GROUP BY 1""", fl="est")
def _(v):
    return G.two_stage(v.panel(), "y", [], ["x"], ["clicks"], "grp", "user_id").select("grp", "term", "est")


def _with_neighbours(v):
    d = v.bio_panel()
    d = P.neighbour(d, "spp", "lat_bin", "year", {"north": "land_mt"}, 1)
    d = P.neighbour(d, "spp", "lat_bin", "year", {"south": "land_mt"}, -1)
    return cut(P.calendar_lag(d, UNIT, "year", {"land_lag1": "land_mt", "pres_lag1": "pres2", "nlag": "north", "slag": "south"}))


@query("k11_instruments_two_way")
def _(v):
    return G.two_stage(_with_neighbours(v), "wtcpuenal", ["SBT", "SST", "depth"], ["land_lag1"], ["nlag", "slag"], "spp", "lat_bin", "year")


_NEXT = """
    SELECT r.spp, r.lat_bin, r.year, CASE WHEN r.land_mt IS NOT NULL THEN a.land_mt END AS north, CASE WHEN r.land_mt IS NOT NULL THEN b.land_mt END AS south
    FROM r LEFT JOIN r a ON a.spp = r.spp AND a.year = r.year AND a.rk = r.rk + 1 LEFT JOIN r b ON b.spp = r.spp AND b.year = r.year AND b.rk = r.rk - 1"""
_LAG_NEXT = f"""
    WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY spp ORDER BY lat_bin) AS rk FROM v_bio_panel), y AS ({_NEXT})
    SELECT r.spp, r.lat_bin, r.wtcpuenal AS bio, r."SBT" AS sbt, r."SST" AS sst, r.depth, p.pres2 AS pres_lag1, p.land_mt AS land_lag1, y.north AS nlag, y.south AS slag
    FROM r LEFT JOIN r p ON p.spp = r.spp AND p.lat_bin = r.lat_bin AND p.year = r.year - 1 LEFT JOIN y ON y.spp = r.spp AND y.lat_bin = r.lat_bin AND y.year = r.year - 1"""


@query("k11_instruments_one_way", Q.two_stage(_LAG_NEXT, "bio", ["sbt", "sst", "depth"], ["pres_lag1", "land_lag1"], ["nlag", "slag"], "spp", "lat_bin",
                                              ["SBT", "SST", "depth", "pres_lag1", "land_lag1"]), fl="est:4 se:4 t:4 p:5 r2:5")
def _(v):
    return G.two_stage(_with_neighbours(v), "wtcpuenal", ["SBT", "SST", "depth"], ["pres_lag1", "land_lag1"], ["nlag", "slag"], "spp", "lat_bin")


_WITHIN = """
    SELECT grp, user_id, day, y - avg(y) OVER u AS y, x - avg(x) OVER u AS x, clicks - avg(clicks) OVER u AS c
    FROM (SELECT * FROM v_panel WHERE y IS NOT NULL AND x IS NOT NULL AND clicks IS NOT NULL) WINDOW u AS (PARTITION BY grp, user_id)"""
_RESID = f"""
    SELECT *, coalesce(lag(e) OVER (PARTITION BY grp, user_id ORDER BY day), 0) AS e1 FROM (
      SELECT w.*, y - b0 * x - b1 * c AS e FROM w JOIN ({Q.swept("SELECT * FROM w", "y", ["x", "c"], "grp", raw=True)}) USING (grp))"""


@query("k12_serial_correlation", f"""
    WITH w AS ({_WITHIN}), a AS ({Q.swept(_RESID, "e", ["x", "c", "e1"], "grp", raw=True)})
    SELECT grp, chisq, CAST(1 AS BIGINT) AS lags, {Q.chi2_1("chisq")} AS p, CAST(n AS BIGINT) AS n FROM (SELECT grp, n * (1 - rss / yy) AS chisq, n FROM a)""", fl="chisq:5 p")
def _(v):
    return G.serial_correlation(v.panel(), "y", ["x", "clicks"], "grp", "user_id", "day", 1, F.floor(F.col("day") / 8))


@query("k13_drop_one", Q.dropped(_LAG, "bio", ["sbt", "sst", "depth", "lag1_bio", "lag1_land"], "spp", "lat_bin", ["SBT", "SST", "depth", "lag1_bio", "lag1_land"]),
       fl="sum_sq:5 rss:5 f:5 p")
def _(v):
    return G.drop_one(lagged(v), "wtcpuenal", ["SBT", "SST", "depth", "lag1_bio", "lag1_land"], "spp", "lat_bin")


@query("k14_additive_model")
def _(v):
    return A.additive(lagged(v), "wtcpuenal", ["SBT", "SST", "lag1_land"], "spp", ["depth"])


@query("k14_additive_hauls")
def _(v):
    return A.additive(v.hauls(), "depth", ["lat", "SBT_seasonal"], "regionfact")


@query("k14_absorbed_dummies")
def _(v):
    return A.additive_absorbed(lagged(v), "wtcpuenal", ["SBT", "SST"], "spp", "lat_bin", ["depth", "lag1_bio", "lag1_land"])


def _changes(v):
    """Every measure less its value a row before."""
    pairs = {"bio": ("wtcpuenal", "lag1_bio"), "pres": ("pres2", "lag1_pres"), "sbt": ("SBT", "lag1_sbt"), "sst": ("SST", "lag1_sst"), "land": ("land_mt", "lag1_land")}
    return lagged(v).withColumns({f"{n}_change": F.col(a) - F.col(b) for n, (a, b) in pairs.items()})


@query("k14_first_differences")
def _(v):
    d = _changes(v)
    bio = A.additive(d, "bio_change", ["sbt_change", "sst_change", "land_change"], "spp").withColumn("model", F.lit("bio"))
    pres = A.additive(d, "pres_change", ["sbt_change", "sst_change", "depth", "lag1_land"], "spp").withColumn("model", F.lit("presence"))
    return bio.unionByName(pres)


@query("k14_demeaned")
def _(v):
    d = lagged(v).where(F.col("lat_bin") >= 35)
    means = d.groupBy(*UNIT).agg(*[F.avg(c).alias(f"m_{c}") for c in ("wtcpuenal", "land_mt", "SBT", "SST")])
    d = R.merge(d, means, by=UNIT)
    d = d.select("spp", "depth", (F.col("wtcpuenal") - F.col("m_wtcpuenal")).alias("fe_bio"), (F.col("lag1_land") - F.col("m_land_mt")).alias("fe_land"),
                 (F.col("SBT") - F.col("m_SBT")).alias("fe_sbt"), (F.col("SST") - F.col("m_SST")).alias("fe_sst"))
    return A.additive(d, "fe_bio", ["fe_land", "fe_sbt", "fe_sst", "depth"], "spp")


@query("k15_additive_random")
def _(v):
    return A.additive_random(v.panel(), "y", ["x", "peak"], "grp", "user_id")


def _presence(v, *more):
    """Beta regression of the share of hauls with the species, next to ``more`` smooths."""
    d = lagged(v).withColumn("p", squeeze("pres2"))
    return B.additive_beta(d, "p", ["SBT_max", "SST_max", "depth", *more], "spp")


@query("k16_presence_smooths")
def _(v):
    return _presence(v, "lag1_land")


def species_smooths(v):
    """Terms of both models for species that are fished."""
    d = lagged(v).withColumn("p", squeeze("pres2"))
    fished = R.having(d, "spp", (F.col("mean_land") >= 1) & (F.col("years") > 5), mean_land=F.avg("land_mt"),
                      years=F.sum((F.col("land_mt") > 0).cast("int")))
    d = R.keep_in(d, fished, "spp")
    bio = A.additive(d, "wtcpuenal", ["SBT", "SST"], "spp", ["depth", "lag1_land"]).withColumn("model", F.lit("bio"))
    pres = A.additive_logit(d, "p", ["SBT", "SST"], "spp", ["depth", "lag1_land"], passes=4).withColumn("model", F.lit("presence"))
    return bio.unionByName(pres)


@query("k17_species_smooths")
def _(v):
    return species_smooths(v)


VIEWS["v_tests"] = """
    SELECT spp, 's(SBT)' AS var, avg(pres2) / 10 AS pval FROM v_bio_panel GROUP BY 1 UNION ALL SELECT spp, 's(land)', avg(land_mt % 17) / 160 FROM v_bio_panel GROUP BY 1
    UNION ALL SELECT spp, 's(depth)', avg(land_mt % 13) / 160 FROM v_bio_panel GROUP BY 1"""


def _tests(v):
    d = v.bio_panel().groupBy("spp").agg(
        (F.avg("pres2") / 10).alias("a"), (F.avg(F.col("land_mt") % 17) / 160).alias("b"), (F.avg(F.col("land_mt") % 13) / 160).alias("c")
    )
    return d.select("spp", F.expr("stack(3, 's(SBT)', a, 's(land)', b, 's(depth)', c) as (var, pval)"))


def flags(table, terms_):
    """One row per species: is each term significant?"""
    sig = F.col("pval") < 0.05
    return table.groupBy("spp").agg(*[F.max(F.when(F.col("var") == t, sig)).alias(n) for n, t in terms_.items()])


@query("k18_significance_by_species", """
    SELECT spp, bool_or(pval < 0.05) FILTER (var = 's(SBT)') AS sig_sbt, bool_or(pval < 0.05) FILTER (var = 's(land)') AS sig_land, bool_or(pval < 0.05) FILTER (var = 's(depth)') AS sig_depth FROM v_tests GROUP BY 1""")
def _(v):
    return flags(_tests(v), {"sig_sbt": "s(SBT)", "sig_land": "s(land)", "sig_depth": "s(depth)"})


@query("k18_significance_totals", """
    SELECT count(*) FILTER (var = 's(SBT)' AND pval < 0.05) AS n_sbt, count(*) FILTER (var = 's(land)' AND pval < 0.05) AS n_land, count(*) FILTER (var = 's(depth)' AND pval < 0.05) AS n_depth FROM v_tests""")
def _(v):
    d = flags(_tests(v), {"sbt": "s(SBT)", "land": "s(land)", "depth": "s(depth)"})
    return d.agg(*[F.sum(F.col(c).cast("int")).alias(f"n_{c}") for c in ("sbt", "land", "depth")])


@query("k19_mixed_crossed")
def _(v):
    d = bias_and_intensity(v).withColumn("model", F.lit("bias"))
    return X.random_intercepts(d, "annual_bias", ["UdivUmsypref"], "model", "spp", "subarea")


@query("k19_mixed_edge")
def _(v):
    d = around(v).withColumn("model", F.lit("edge"))
    return X.random_intercepts(d, "annual_bias", ["log_landedge"], "model", "spp")


@query("k19_mixed_edge_intensity")
def _(v):
    d = edge_and_intensity(v).withColumn("model", F.lit("edge and intensity"))
    return X.random_intercepts(d, "annual_bias", ["UdivUmsypref", "log_landedge"], "model", "spp")


@query("k19_mixed_events")
def _(v):
    return X.random_intercepts(v.panel(), "y", ["x", "clicks"], "grp", "user_id")


@query("k23_effect_curve", Q.curve(_LAG.replace("FROM v_lag", "FROM v_lag WHERE pres2 <> 0"), "bio", ["sbt", "sst", "depth", "lag1_land"], "spp", "lat_bin", "lag1_land"),
       fl="at fit:5 lower:5 upper:5")
def _(v):
    d = lagged(v).where(F.col("pres2") != 0)
    return G.effect_curve(d, "wtcpuenal", ["SBT", "SST", "depth", "lag1_land"], "spp", "lat_bin", "lag1_land")
