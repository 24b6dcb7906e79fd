"""Scores, centroids, shifts, trends and landings around the centroid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import sentinel_to_null
from ..operators import panel as P
from ..operators import relational as R
from ..operators import shift as S
from ..operators import survey as V
from ..session import cut
from .landings import stock_series, total_landings
from .fits import two_sided
from .registry import VIEWS, query

TERMS = ("SBT_seasonal", "SST_seasonal_mean", "rugosity")
KEY = ["spp", "sppocean", "subarea"]

# Two-stage coefficients per species come from the parts table: any fitted
# coefficient table of this shape can take its place.
VIEWS["v_model"] = """
    SELECT lower(p_type) || ' marina_Atl' AS sppocean, -1.5::DOUBLE + avg(p_size) / 50 AS p_0, avg(p_retailprice) / 20000 AS "p_SBT_seasonal", 0.02::DOUBLE AS "p_SST_seasonal_mean", -0.01::DOUBLE AS p_rugosity,
    1 + avg(p_size) / 100 AS b_0, 0.03::DOUBLE AS "b_SBT_seasonal", -0.02::DOUBLE AS "b_SST_seasonal_mean", 0.05::DOUBLE AS b_rugosity FROM part GROUP BY 1"""
VIEWS["v_pred"] = """
    SELECT *, pred_pres * exp(pred_log_bio) AS pred_total FROM (
      SELECT h.*, m.sppocean, upper(substr(m.sppocean, 1, 1)) || substr(split_part(m.sppocean, '_', 1), 2) AS spp,
      CASE regionfact WHEN 'AFSC_EBS' THEN 'EBS' WHEN 'NEFSC_NEUS' THEN 'US East Coast' WHEN 'NWFSC_WCAnn' THEN 'US West Coast' WHEN 'SCDNR_SEUS' THEN 'SEUS' WHEN 'DFO_ScotianShelf' THEN 'Canada East Coast' END AS subarea,
      CASE WHEN c.haulid IS NULL THEN 0 ELSE c.wtcpue END AS wtcpue, c.haulid IS NOT NULL AS presfit,
      1 / (1 + exp(-(p_0 + "p_SBT_seasonal" * "SBT_seasonal" + "p_SST_seasonal_mean" * "SST_seasonal_mean" + p_rugosity * rugosity))) AS pred_pres,
      b_0 + "b_SBT_seasonal" * "SBT_seasonal" + "b_SST_seasonal_mean" * "SST_seasonal_mean" + b_rugosity * rugosity AS pred_log_bio
      FROM v_hauls h JOIN (SELECT DISTINCT regionfact, sppocean FROM v_catch_ok JOIN v_hauls USING (haulid)) o USING (regionfact) JOIN v_model m ON m.sppocean = o.sppocean
      LEFT JOIN v_catch_ok c ON c.haulid = h.haulid AND c.sppocean = o.sppocean WHERE o.sppocean <> 'promo marina_Atl' OR regionfact IN ('NEFSC_NEUS', 'AFSC_EBS'))"""
VIEWS["v_catch_ok"] = "SELECT * REPLACE (nullif(wtcpue, -9999) AS wtcpue) FROM v_catch"


def _strict(c, n=None):
    return f'CASE WHEN count(*) = count("{c}") THEN avg("{c}") END AS "{n or c}"'


def _w(x, w):
    return f"CASE WHEN count(*) = count({w}) THEN sum({x} * {w}) / nullif(sum({w}), 0) END"


VIEWS["v_cent"] = f"""
    SELECT spp, sppocean, subarea, year, {_w('lat', 'wtcpue')} AS obs_lat, {_w('lon', 'wtcpue')} AS obs_lon, {_w('depth', 'wtcpue')} AS obs_depth,
    {_w('lat', 'pred_pres')} AS pred_lat_pres, {_w('lon', 'pred_pres')} AS pred_lon_pres, {_w('depth', 'pred_pres')} AS pred_depth_pres,
    {_w('lat', 'pred_total')} AS pred_lat_bio, {_w('lon', 'pred_total')} AS pred_lon_bio, {_w('depth', 'pred_total')} AS pred_depth,
    {_strict('SBT_seasonal')}, {_strict('SST_seasonal_mean', 'SST_seasonal')}, {_strict('SBT_min')}, {_strict('SST_min')}, {_strict('SBT_max')}, {_strict('SST_max')},
    {_strict('wtcpue')}, avg(CAST(presfit AS INTEGER)) AS freq_occ FROM v_pred WHERE depth IS NOT NULL GROUP BY 1, 2, 3, 4"""
VIEWS["v_shift"] = """
    SELECT *, obs_d - pred_d AS annual_obsminuspred, sign(pred_d)::DOUBLE AS sign_pred, (obs_d - pred_d) * sign(pred_d) AS annual_bias, count(obs_lat) OVER (PARTITION BY spp, sppocean, subarea) AS nyrs_obs FROM
    (SELECT *, lead(obs_lat) OVER w - obs_lat AS obs_d, lead(pred_lat_bio) OVER w - pred_lat_bio AS pred_d FROM v_cent WINDOW w AS (PARTITION BY spp, sppocean, subarea ORDER BY year))"""


def catch_ok(v):
    """Catches with NULL for the missing-weight sentinel; the fish was there all the same."""
    return v.catch().withColumn("wtcpue", sentinel_to_null("wtcpue")).drop("cntcpue")


def model(v):
    p = v.table("part").groupBy(F.concat(F.lower("p_type"), F.lit(" marina_Atl")).alias("sppocean"))
    size, price = F.avg("p_size"), F.avg("p_retailprice")
    d = p.agg(
        (F.lit(-1.5) + size / 50).alias("p_0"), (price / 20000).alias("p_SBT_seasonal"), F.lit(0.02).alias("p_SST_seasonal_mean"),
        F.lit(-0.01).alias("p_rugosity"), (F.lit(1) + size / 100).alias("b_0"), F.lit(0.03).alias("b_SBT_seasonal"),
        F.lit(-0.02).alias("b_SST_seasonal_mean"), F.lit(0.05).alias("b_rugosity"),
    )
    only = F.array(F.lit("NEFSC_NEUS"), F.lit("AFSC_EBS"))
    return d.withColumn("fit_regions", F.when(F.col("sppocean") == "promo marina_Atl", only))


def predictions(v):
    rows = V.zero_fill_regional(catch_ok(v), v.hauls()).withColumn("subarea", V.region_subarea("regionfact"))
    return S.score_two_stage(rows, model(v), TERMS)


def centroids(v):
    return cut(S.distribution_summary(predictions(v)))


def shifts(v):
    return S.annual_shift(centroids(v), KEY)


@query("k22_two_stage_score", """
    SELECT haulid, sppocean, pred_pres, pred_log_bio, pred_total, presfit FROM v_pred""", fl="pred_pres pred_log_bio pred_total")
def _(v):
    return predictions(v).select("haulid", "sppocean", "pred_pres", "pred_log_bio", "pred_total", "presfit")


@query("j19_observed_centroid", f"""
    SELECT sppocean, regionfact, year, {_w('lat', 'wtcpue')} AS lat_cent, avg(lat) AS lat_cent_pres FROM v_catch_ok JOIN v_hauls USING (haulid) GROUP BY 1, 2, 3""", fl="lat_cent lat_cent_pres")
def _(v):
    return S.observed_centroid(_located(v), ["sppocean", "regionfact", "year"])


def _located(v):
    return R.merge(catch_ok(v), v.hauls().select("haulid", "lat", "lon", "regionfact", "year", "month"), by="haulid", nulls="drop")


@query("j20_predicted_centroid", f"""
    SELECT sppocean, regionfact, year, {_w('lat', 'pred_total')} AS lat_cent_cm, {_w('lat', 'pred_pres')} AS lat_cent_pres_cm, avg("SBT_seasonal") AS sbt, avg("SST_seasonal_mean") AS sst FROM v_pred GROUP BY 1, 2, 3""",
       fl="lat_cent_cm lat_cent_pres_cm sbt sst")
def _(v):
    return S.predicted_centroid(predictions(v), ["sppocean", "regionfact", "year"])


@query("k24_observed_vs_predicted", f"""
    SELECT * FROM (SELECT sppocean, regionfact, year, {_w('lat', 'wtcpue')} AS lat_cent FROM v_catch_ok JOIN v_hauls USING (haulid) GROUP BY 1, 2, 3)
    JOIN (SELECT sppocean, regionfact, year, {_w('lat', 'pred_total')} AS lat_cent_cm FROM v_pred GROUP BY 1, 2, 3) USING (sppocean, regionfact, year)""", fl="lat_cent lat_cent_cm")
def _(v):
    by = ["sppocean", "regionfact", "year"]
    a = S.observed_centroid(_located(v), by).drop("lat_cent_pres")
    return R.merge(a, S.predicted_centroid(predictions(v), by).select(*by, "lat_cent_cm"), by=by)


@query("j21_distribution_summary", "SELECT * FROM v_cent", fl="""obs_lat obs_lon obs_depth pred_lat_pres pred_lon_pres pred_depth_pres pred_lat_bio pred_lon_bio pred_depth
    SBT_seasonal SST_seasonal SBT_min SST_min SBT_max SST_max wtcpue freq_occ""")
def _(v):
    return S.distribution_summary(predictions(v))


@query("j22_binned_centroid", """
    SELECT spp, year, sum(lat_bin * wtcpue) / sum(wtcpue) AS cent_bin FROM v_bio_panel WHERE wtcpue > 0 AND lat_bin > 33.5 GROUP BY 1, 2""", fl="cent_bin")
def _(v):
    from ..functions.missing import weighted_mean

    d = v.bio_panel().where((F.col("wtcpue") > 0) & (F.col("lat_bin") > 33.5))
    return d.groupBy("spp", "year").agg(weighted_mean("lat_bin", "wtcpue").alias("cent_bin"))


@query("j23_annual_shift", """
    SELECT spp, subarea, year, obs_d AS lat_cent_diff, pred_d AS lat_cent_cm_diff, annual_obsminuspred, sign_pred, annual_bias FROM v_shift""",
       fl="lat_cent_diff lat_cent_cm_diff annual_obsminuspred annual_bias")
def _(v):
    return shifts(v).select("spp", "subarea", "year", "lat_cent_diff", "lat_cent_cm_diff", "annual_obsminuspred", "sign_pred", "annual_bias")


@query("j25_usable_years", "SELECT spp, subarea, year, nyrs_obs FROM v_shift")
def _(v):
    return shifts(v).select("spp", "subarea", "year", "nyrs_obs")


_TREND = """
    SELECT spp, sppocean, subarea, nyrs_obs, regr_slope(obs_lat, year) AS lm_obs_slope, regr_r2(obs_lat, year) AS lm_obs_r2,
    regr_slope(pred_lat_bio, year) AS lm_pred_slope, regr_r2(pred_lat_bio, year) AS lm_pred_r2,
    CASE WHEN regr_slope(pred_lat_bio, year) > 0 THEN 1 ELSE -1 END * (regr_slope(obs_lat, year) - regr_slope(pred_lat_bio, year)) AS obsminuspred
    FROM v_shift WHERE nyrs_obs > 5 GROUP BY 1, 2, 3, 4"""


@query("j24_trends", _TREND, fl="lm_obs_slope lm_obs_r2 lm_pred_slope lm_pred_r2 obsminuspred")
def _(v):
    return S.trends(shifts(v), KEY).drop("lm_obs_p", "lm_pred_p")


def _slope_t(y):
    return f"regr_slope({y}, year) / nullif(sqrt(greatest(regr_syy({y}, year) - regr_slope({y}, year) * regr_sxy({y}, year), 0) / nullif(regr_count({y}, year) - 2, 0) / nullif(regr_sxx({y}, year), 0)), 0)"


_TESTED = _TREND.replace("FROM v_shift", f""", {_slope_t("obs_lat")} AS t_obs, {_slope_t("pred_lat_bio")} AS t_pred,
    regr_count(obs_lat, year) - 2 AS dof_obs, regr_count(pred_lat_bio, year) - 2 AS dof_pred FROM v_shift""")


@query("j24_trend_p_values", f"""
    SELECT * EXCLUDE (t_obs, t_pred, dof_obs, dof_pred) FROM ({two_sided(two_sided(_TESTED, "lm_obs_p", "t_obs", "dof_obs"), "lm_pred_p", "t_pred", "dof_pred")})""",
       fl="lm_obs_slope lm_obs_r2 lm_pred_slope lm_pred_r2 obsminuspred lm_obs_p lm_pred_p")
def _(v):
    return S.trends(shifts(v), KEY)


@query("k1_simple_regression", """
    SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_r2(l_extendedprice, l_quantity) AS r2,
    regr_slope(l_extendedprice, l_quantity) / sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)) AS t
    FROM lineitem GROUP BY 1""", fl="slope:4 r2 t:4")
def _(v):
    fit = S.simple_fit("l_extendedprice", "l_quantity")
    return v.table("lineitem").groupBy("l_returnflag").agg(*[fit[k].alias(k) for k in ("slope", "r2", "t")])


# -- landings around the centroid ----------------------------------------------------

VIEWS["v_around"] = """
    SELECT *, ln(CASE WHEN "landN" = 0 THEN 1e-5::DOUBLE ELSE "landN" END / CASE WHEN "landS" = 0 THEN 1e-5::DOUBLE ELSE "landS" END) AS "log_landNS" FROM (
    SELECT l.spp, l.year, c.obs_lat, c.sign_pred, c.annual_bias, coalesce(sum(tl_mt) FILTER (lat_bin >= obs_lat), 0) AS "landN", coalesce(sum(tl_mt) FILTER (lat_bin < obs_lat), 0) AS "landS"
    FROM v_land_bin l JOIN v_shift c ON l.year = c.year AND l.spp = c.spp AND c.subarea = 'US East Coast' GROUP BY 1, 2, 3, 4, 5)"""


def around(v):
    from ..operators.landings import landings_by_bin

    land = landings_by_bin(total_landings(v))
    cent = shifts(v).where(F.col("subarea") == "US East Coast")
    return S.landings_around_centroid(land, cent, keep=("annual_bias",))


@query("j41_landings_around_centroid", 'SELECT spp, year, "landN", "landS", "log_landNS", "log_landNS" * sign_pred AS log_landedge FROM v_around', fl="landN:5 landS:5 log_landNS log_landedge")
def _(v):
    return around(v).select("spp", "year", "landN", "landS", "log_landNS", "log_landedge")


@query("j42_bias_and_intensity", """
    SELECT s.spp, s.year, s.subarea, u.stockid, s.annual_bias, u."UdivUmsypref" FROM v_shift s JOIN v_frac u ON s.spp = u.scientificname AND s.year = u.year AND s.subarea = u.subarea""", fl="annual_bias")
def _(v):
    return bias_and_intensity(v).select("spp", "year", "subarea", "stockid", "annual_bias", "UdivUmsypref")


def bias_and_intensity(v):
    u = stock_series(v).select("scientificname", "year", "subarea", "stockid", "UdivUmsypref")
    return R.merge(shifts(v), u, by_x=["spp", "year", "subarea"], by_y=["scientificname", "year", "subarea"])


@query("j42_edge_and_intensity", """
    SELECT s.spp, s.year, u.stockid, s."log_landNS" * s.sign_pred AS log_landedge, u."UdivUmsypref" FROM v_around s JOIN v_frac u ON s.spp = u.scientificname AND s.year = u.year""", fl="log_landedge")
def _(v):
    return edge_and_intensity(v).select("spp", "year", "stockid", "log_landedge", "UdivUmsypref")


def edge_and_intensity(v):
    u = stock_series(v).select("scientificname", "year", "stockid", "UdivUmsypref")
    return R.merge(around(v), u, by_x=["spp", "year"], by_y=["scientificname", "year"])


@query("f9_lead_centroid", """
    SELECT spp, subarea, year, lead(obs_lat) OVER w AS lead1_obs_lat, lead(pred_depth) OVER w AS lead1_pred_depth FROM v_cent WINDOW w AS (PARTITION BY spp, sppocean, subarea ORDER BY year)""",
       fl="lead1_obs_lat lead1_pred_depth")
def _(v):
    d = P.row_shift(centroids(v), KEY, "year", {"lead1_obs_lat": "obs_lat", "lead1_pred_depth": "pred_depth"}, -1)
    return d.select("spp", "subarea", "year", "lead1_obs_lat", "lead1_pred_depth")
