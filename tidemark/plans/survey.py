"""Zero-filling, strata, latitude and area summaries, biomass, panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import bin_mid
from ..functions.missing import n_unique, not_in
from ..functions.text import capitalize, key_year
from ..operators import panel as P
from ..operators import relational as R
from ..operators import spatial as S
from ..operators import survey as V
from ..sources.standins import View
from .registry import VIEWS, query

STRICT = ("SBT_actual", "SBT_min", "SBT_max", "SST_actual", "SST_min", "SST_max")
AREA_KEY = ["StatArea", "area", "RAM_stockid", "spp", "year"]

VIEWS["v_placed"] = """
    SELECT h.haulid, min(a."Id") AS "Id" FROM v_hauls h JOIN v_areas a
    ON h.lon BETWEEN a.lon_lo AND a.lon_hi AND h.lat BETWEEN a.lat_lo AND a.lat_hi GROUP BY 1"""
VIEWS["v_stock_zero"] = """
    SELECT z.*, m."RAM_stockid", m."StatArea", a.area FROM v_zero z JOIN v_placed p USING (haulid) JOIN v_areas a USING ("Id")
    JOIN v_stock_map m ON m."StatArea" = p."Id" AND m.spp = z.spp"""


def _strict(c, name=None):
    return f'CASE WHEN count(*) = count("{c}") THEN avg("{c}") END AS "{name or c}"'


_MEANS = (
    "avg(CAST(pres2 AS INTEGER)) AS pres2, " + _strict("wtcpue") + ", CASE WHEN count(*) = count(wtcpue) THEN avg(wtcpuenal) END AS wtcpuenal, "
    + ", ".join(_strict(c) for c in STRICT) + ", avg(depth) AS depth, count(DISTINCT haulid) AS num_hauls"
)
_FL = "pres2 wtcpue wtcpuenal depth " + " ".join(STRICT)
VIEWS["v_area_means"] = f"""
    SELECT "StatArea", area, "RAM_stockid", spp, year, {_MEANS}, avg(lat) AS lat, avg(lon) AS lon FROM v_stock_zero GROUP BY 1, 2, 3, 4, 5"""
VIEWS["v_swept"] = """
    SELECT *, CASE WHEN count(*) OVER w = count(swept_bio_mt) OVER w THEN sum(swept_bio_mt) OVER w END AS total_swept_bio_mt,
    swept_bio_mt / nullif(CASE WHEN count(*) OVER w = count(swept_bio_mt) OVER w THEN sum(swept_bio_mt) OVER w END, 0) AS frac_swept_bio
    FROM (SELECT *, wtcpue * (area / 0.0343::DOUBLE) * 0.001::DOUBLE AS swept_bio_mt FROM v_area_means)
    WINDOW w AS (PARTITION BY "RAM_stockid", spp, year)"""


def placed(v: View):
    """Hauls with their statistical area; hauls outside all areas drop out."""
    d = S.locate(v.hauls(), v.stat_areas(), "Id", carry=["area"])
    return d.where(F.col("Id").isNotNull()).withColumnRenamed("Id", "StatArea")


def latbin_means(v: View, group=("lat_bin", "year")):
    h = placed(v).withColumn("lat_bin", bin_mid("lat", 30, 46)).withColumn("season", V.season("month"))
    h = h.where(F.col("season").isNotNull()) if "season" in group else h
    d = V.stock_summary(v.catch_spp(), h, v.stock_map(), list(group), strict=STRICT, skip=("depth",))
    return d.drop("wtcpue_skip")


def area_means(v: View):
    d = V.stock_summary(v.catch_spp(), placed(v), v.stock_map(), ["StatArea", "area", "year"], strict=[*STRICT, "lat", "lon"], skip=("depth",))
    return d.drop("wtcpue_skip")


_ROWS = """
    SELECT haulid, spp, pres2, wtcpue, CASE WHEN wtcpue = 0 THEN 1e-4::DOUBLE ELSE wtcpue END AS wtcpuena, wtcpuenal FROM v_zero"""


@query("j1_zero_fill", _ROWS, fl="wtcpuena wtcpuenal")
def _(v):
    catch = v.catch_spp().select("haulid", "spp", "wtcpue")
    return V.zero_fill(catch, v.hauls()).select("haulid", "spp", "pres2", "wtcpue", "wtcpuena", "wtcpuenal")


@query("j2_zero_fill_full", """
    WITH z AS (SELECT z.haulid, z.spp, z.year, CASE WHEN month IN (9, 10, 11) THEN 'fall' WHEN month IN (3, 4, 5) THEN 'spring' END AS season, lat, lon, z.wtcpue,
      nullif(coalesce(c.cntcpue, 0), -9999) AS cntcpue FROM v_zero z LEFT JOIN v_catch_spp c ON z.haulid = c.haulid AND z.spp = c.spp),
    m AS (SELECT spp, year, season, avg(wtcpue) AS mean_wtcpue FROM z GROUP BY 1, 2, 3)
    SELECT z.haulid, z.spp, z.wtcpue, z.cntcpue, ln(CASE WHEN cntcpue = 0 THEN 1e-4::DOUBLE ELSE cntcpue END) AS cntcpuenal, m.mean_wtcpue,
    round_even(lat / 0.1::DOUBLE, 0) * 0.1::DOUBLE AS lat_1, round_even(lon / 0.1::DOUBLE, 0) * 0.1::DOUBLE AS lon_1
    FROM z JOIN m ON z.spp = m.spp AND z.year = m.year AND z.season IS NOT DISTINCT FROM m.season""", fl="cntcpuenal mean_wtcpue lat_1 lon_1")
def _(v):
    h = v.hauls().select("haulid", "year", "lat", "lon", V.season("month").alias("season"))
    return V.zero_fill_full(v.catch_spp(), h).select("haulid", "spp", "wtcpue", "cntcpue", "cntcpuenal", "mean_wtcpue", "lat_1", "lon_1")


@query("j3_zero_fill_regional", """
    WITH w AS (SELECT c.*, h.regionfact FROM v_catch c JOIN v_hauls h USING (haulid)),
    m AS (SELECT h.haulid, h.regionfact, s.sppocean, h.year, h.lat FROM v_hauls h JOIN (SELECT DISTINCT regionfact, sppocean FROM w) s USING (regionfact))
    SELECT m.haulid, m.regionfact, m.sppocean, upper(substr(m.sppocean, 1, 1)) || substr(split_part(m.sppocean, '_', 1), 2) AS spp, m.year, m.lat,
    CASE WHEN w.haulid IS NULL THEN 0 ELSE nullif(w.wtcpue, -9999) END AS wtcpue, CASE WHEN w.haulid IS NULL THEN -10 ELSE w.logwtcpue END AS logwtcpue, coalesce(w.presfit, FALSE) AS presfit
    FROM m LEFT JOIN w ON m.haulid = w.haulid AND m.sppocean = w.sppocean""", fl="logwtcpue")
def _(v):
    h = v.hauls()
    d = V.zero_fill_regional(v.catch().drop("cntcpue"), h.select("haulid", "regionfact", "year", "lat"))
    return d.select("haulid", "regionfact", "sppocean", "spp", "year", "lat", "wtcpue", "logwtcpue", "presfit")


@query("j4_consistent_strata", """
    WITH o AS (SELECT stratum, regionfact, ocean, surveyfact, count(DISTINCT year) AS n FROM v_hauls GROUP BY 1, 2, 3, 4),
    t AS (SELECT regionfact, ocean, surveyfact, count(DISTINCT year) AS m FROM v_hauls GROUP BY 1, 2, 3)
    SELECT haulid, stratum, year FROM v_hauls WHERE stratum IN (SELECT stratum FROM o JOIN t USING (regionfact, ocean, surveyfact) WHERE CAST(n AS DOUBLE) / m >= 0.9::DOUBLE) AND year >= 1996""")
def _(v):
    return V.consistent_strata(v.hauls(), 0.9, 1996).select("haulid", "stratum", "year")


@query("j5_persistent_species", """
    SELECT spp, count(DISTINCT substr(haulid, 1, 4)) AS num_yrs FROM v_catch_spp GROUP BY 1 HAVING count(DISTINCT substr(haulid, 1, 4)) >= 5""")
def _(v):
    return V.persistent_species(v.catch_spp().withColumn("year", key_year("haulid")), 5)


@query("j7_region_subarea", """
    SELECT subarea, count(*) AS n FROM (SELECT CASE regionfact WHEN 'AFSC_EBS' THEN 'EBS' WHEN 'NEFSC_NEUS' THEN 'US East Coast' WHEN 'NWFSC_WCAnn' THEN 'US West Coast'
    WHEN 'SCDNR_SEUS' THEN 'SEUS' WHEN 'DFO_ScotianShelf' THEN 'Canada East Coast' END AS subarea FROM v_hauls) GROUP BY 1""")
def _(v):
    return v.hauls().groupBy(V.region_subarea("regionfact").alias("subarea")).agg(F.count(F.lit(1)).alias("n"))


@query("j9_season", """
    SELECT month, CASE WHEN month IN (9, 10, 11) THEN 'fall' WHEN month IN (3, 4, 5) THEN 'spring' END AS season, count(*) AS n FROM v_hauls GROUP BY 1""")
def _(v):
    return v.hauls().groupBy("month", V.season("month").alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("j10_latbin_summary", f'SELECT lat_bin, "RAM_stockid", spp, year, {_MEANS} FROM v_stock_zero GROUP BY 1, 2, 3, 4', fl=_FL)
def _(v):
    return latbin_means(v)


@query("j11_latbin_by_season", f"""
    SELECT lat_bin, "RAM_stockid", spp, year, CASE WHEN month IN (9, 10, 11) THEN 'fall' ELSE 'spring' END AS season, {_MEANS}
    FROM v_stock_zero WHERE month IN (9, 10, 11, 3, 4, 5) GROUP BY 1, 2, 3, 4, 5""", fl=_FL)
def _(v):
    return latbin_means(v, ("lat_bin", "year", "season"))


@query("j12_well_sampled_bins", f'SELECT lat_bin, "RAM_stockid", spp, year, {_MEANS} FROM v_stock_zero GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT haulid) > 15', fl=_FL)
def _(v):
    return latbin_means(v).where(F.col("num_hauls") > 15)


@query("j13_area_summary", "SELECT * FROM v_area_means", fl=_FL + " lat lon")
def _(v):
    return area_means(v)


@query("j18_surveyed_areas", """
    SELECT *, "StatArea" IN (3, 8, 13) AND present AS offshore, "StatArea" IN (4, 9, 14) AND present AS far_offshore FROM (
    SELECT "StatArea", count(DISTINCT "RAM_stockid") AS num_stocks, bool_or(coalesce(pres2 > 0, false)) AS present FROM v_area_means GROUP BY 1)""")
def _(v):
    from ..operators.stocks import stocks_per_area

    return stocks_per_area(area_means(v), offshore=(3, 8, 13), far_offshore=(4, 9, 14))


@query("j14_swept_area", 'SELECT "StatArea", "RAM_stockid", spp, year, swept_bio_mt, total_swept_bio_mt, frac_swept_bio FROM v_swept',
       fl="swept_bio_mt total_swept_bio_mt frac_swept_bio")
def _(v):
    d = V.swept_area_biomass(area_means(v))
    return d.select("StatArea", "RAM_stockid", "spp", "year", "swept_bio_mt", "total_swept_bio_mt", "frac_swept_bio")


@query("j15_density_biomass", """
    SELECT "StatArea", "RAM_stockid", spp, year, wtcpue / 0.0384::DOUBLE AS kg_km2, area * (wtcpue / 0.0384::DOUBLE) / 1000 AS bio_mt FROM v_area_means""", fl="kg_km2 bio_mt")
def _(v):
    d = area_means(v)
    return d.withColumns(V.density_biomass("wtcpue", "area")).select("StatArea", "RAM_stockid", "spp", "year", "kg_km2", "bio_mt")


@query("j16_absolute_biomass", """
    SELECT s."StatArea", s."RAM_stockid", s.year, CASE WHEN a."TB" IS NOT NULL THEN a."TB" * frac_swept_bio ELSE a."SSB" * frac_swept_bio END AS abs_bio
    FROM v_swept s JOIN v_assess a ON s."RAM_stockid" = a.stockid AND s.year = a.year""", fl="abs_bio")
def _(v):
    d = V.absolute_biomass(V.swept_area_biomass(area_means(v)), v.assess())
    return d.select("StatArea", "RAM_stockid", "year", "abs_bio")


@query("j46_survey_landings_panel", """
    SELECT spp, lat_bin, year, pres2, land_mt, num_hauls FROM v_bio_panel WHERE year < 2015 AND lat_bin NOT IN (30.5, 31.5, 32.5, 33.5, 34.5)""", fl="pres2")
def _(v):
    d = v.bio_panel().where(F.col("lat_bin").isNotNull() & (F.col("year") < 2015) & not_in("lat_bin", (30.5, 31.5, 32.5, 33.5, 34.5)))
    return d.select("spp", "lat_bin", "year", "pres2", "land_mt", "num_hauls")


@query("j47_niche", """
    WITH n AS (SELECT spp, sum("SBT" * pres2) / sum(pres2) AS mb, sqrt((sum("SBT" * "SBT" * pres2) - sum("SBT" * pres2) * sum("SBT" * pres2) / sum(pres2)) / (sum(pres2) - 1)) AS sb,
      sum("SST" * pres2) / sum(pres2) AS ms, sqrt((sum("SST" * "SST" * pres2) - sum("SST" * pres2) * sum("SST" * pres2) / sum(pres2)) / (sum(pres2) - 1)) AS ss FROM v_bio_panel GROUP BY 1)
    SELECT spp, lat_bin, year, ("SBT" - mb) / sb AS scaled_sbt, ("SST" - ms) / ss AS scaled_sst FROM v_bio_panel JOIN n USING (spp)""", fl="scaled_sbt scaled_sst")
def _(v):
    d = P.niche(v.bio_panel(), "spp", {"sbt": "SBT", "sst": "SST"}, {"p": "pres2"})
    z = {f"scaled_{t}": F.try_divide(F.col(c) - F.col(f"mean_{t}p"), F.col(f"sd_{t}p")) for t, c in (("sbt", "SBT"), ("sst", "SST"))}
    return d.withColumns(z).select("spp", "lat_bin", "year", *z)


VIEWS["v_growth"] = """
    SELECT s.*, coalesce(l.land_mt, 0) AS land_mt, area * (wtcpue / 0.0384::DOUBLE) / 1000 AS bio_mt FROM (
      SELECT p."Id" AS statarea, a.area, spp, year, CASE WHEN month IN (9, 10, 11) THEN 'fall' WHEN month IN (3, 4, 5) THEN 'spring' END AS season,
      avg(wtcpue) AS wtcpue, avg("SBT_seasonal") AS sbt, avg("SST_seasonal_mean") AS sst FROM v_zero JOIN v_placed p USING (haulid) JOIN v_areas a USING ("Id") GROUP BY 1, 2, 3, 4, 5) s
    LEFT JOIN (SELECT "YEAR" AS year, "AREA" AS statarea, spp, coalesce(sum("SPPLIVMT"), 0) AS land_mt FROM v_land_area JOIN v_ak_species ON "NESPP3" = "ADFG_I_SPECIES_CODE" GROUP BY 1, 2, 3) l
    USING (year, statarea, spp)"""


VIEWS["v_percap"] = """
    SELECT statarea, spp, season, year, bio_mt, land_mt, (nb - bio_mt) / bio_mt AS percap_diff, CASE WHEN (nb - bio_mt) / bio_mt + 1.0001 > 0 THEN ln((nb - bio_mt) / bio_mt + 1.0001) END AS percap_log,
    ns - sbt AS sbt_diff, nt - sst AS sst_diff, ln(CASE WHEN land_mt = 0 THEN 0.0001 ELSE land_mt END / bio_mt) AS "logLB"
    FROM (SELECT *, lead(bio_mt) OVER w AS nb, lead(sbt) OVER w AS ns, lead(sst) OVER w AS nt FROM v_growth WINDOW w AS (PARTITION BY statarea, spp, season ORDER BY year)) WHERE bio_mt > 0"""


@query("j48_per_capita_growth", "SELECT statarea, spp, season, year, bio_mt, land_mt, percap_diff, percap_log, sbt_diff, sst_diff, \"logLB\" FROM v_percap",
       fl="bio_mt percap_diff percap_log:5 sbt_diff sst_diff logLB")
def _(v):
    return growth(v).select("statarea", "spp", "season", "year", "bio_mt", "land_mt", "percap_diff", "percap_log", "sbt_diff", "sst_diff", "logLB")


def growth(v):
    h = placed(v).select(
        "haulid", F.col("StatArea").alias("statarea"), "area", "year", V.season("month").alias("season"),
        F.col("SBT_seasonal").alias("sbt"), F.col("SST_seasonal_mean").alias("sst"),
    )
    s = V.zero_fill_summary(v.catch_spp(), h, ["statarea", "area", "season", "year"], strict=("sbt", "sst"))
    s = s.drop("wtcpue").withColumnRenamed("wtcpue_skip", "wtcpue")
    s = s.withColumns(V.density_biomass("wtcpue", "area"))
    land = species_landings(v).withColumnsRenamed({"YEAR": "year", "AREA": "statarea"})
    j = V.survey_landings_panel(s, land.withColumnRenamed("land_mt", "qty"), ["year", "statarea", "spp"], "qty")
    return V.percap_growth(j, ["statarea", "spp", "season"], "year", temps=("sbt", "sst"))


def species_landings(v):
    from ..functions.missing import skip_sum

    look = v.ak_species().select(F.col("ADFG_I_SPECIES_CODE").alias("NESPP3"), "spp")
    return R.merge(v.land_area(), look, by="NESPP3").groupBy("YEAR", "AREA", "spp").agg(skip_sum("SPPLIVMT").alias("land_mt"))


@query("j49_annual_temperature", 'SELECT year, avg("SBT") AS sbt, avg("SST") AS sst FROM v_bio_panel WHERE lat_bin > 34.5 AND year <> 2015 GROUP BY 1', fl="sbt sst")
def _(v):
    d = v.bio_panel().where((F.col("lat_bin") > 34.5) & (F.col("year") != 2015))
    return d.groupBy("year").agg(F.avg("SBT").alias("sbt"), F.avg("SST").alias("sst"))


@query("j50_latitude_profile", """
    SELECT lat_bin, avg(land_mt) FILTER (year = 1999) AS "1999", avg(land_mt) FILTER (year = 2000) AS "2000" FROM v_bio_panel WHERE spp = 'Small marina' GROUP BY 1""")
def _(v):
    from ..operators.describe import profile

    shown = (F.col("spp") == "Small marina") & F.col("year").isin(1999, 2000)
    panel = v.bio_panel().where(F.col("spp") == "Small marina")
    every = panel.select("lat_bin").distinct()
    return R.merge(every, profile(panel, shown, "lat_bin", F.avg("land_mt"), "year", [1999, 2000]), by="lat_bin", how="left")


@query("j51_species_lookup", """
    SELECT "YEAR", "AREA", spp, coalesce(sum("SPPLIVMT"), 0) AS land_mt FROM v_land_area JOIN v_ak_species ON "NESPP3" = "ADFG_I_SPECIES_CODE"
    WHERE spp IN ('Small marina', 'Large marina', 'Promo marina') GROUP BY 1, 2, 3""")
def _(v):
    from ..functions.missing import skip_sum
    from ..sources.tables import literal

    names = literal(v.spark, "spp string", [("Small marina",), ("Large marina",), ("Promo marina",)])
    look = R.merge(names, v.ak_species().select("spp", F.col("ADFG_I_SPECIES_CODE").alias("NESPP3")), by="spp")
    j = R.merge(v.land_area(), look.withColumn("SCINAME", F.upper("spp")), by="NESPP3")
    return j.groupBy("YEAR", "AREA", "spp").agg(skip_sum("SPPLIVMT").alias("land_mt"))


@query("j3_haul_counts_check", """
    SELECT regionfact, sppocean, count(*) AS n FROM v_hauls JOIN (SELECT DISTINCT regionfact, sppocean FROM v_catch JOIN v_hauls USING (haulid)) USING (regionfact) GROUP BY 1, 2""")
def _(v):
    d = V.zero_fill_regional(v.catch().drop("cntcpue"), v.hauls().select("haulid", "regionfact"))
    return d.groupBy("regionfact", "sppocean").agg(F.count(F.lit(1)).alias("n"))


@query("j4_stratum_coverage", """
    WITH o AS (SELECT stratum, regionfact, ocean, surveyfact, count(DISTINCT year) AS num_yrs_obs FROM v_hauls GROUP BY 1, 2, 3, 4),
    t AS (SELECT regionfact, ocean, surveyfact, count(DISTINCT year) AS num_yrs_surv FROM v_hauls GROUP BY 1, 2, 3)
    SELECT stratum, regionfact, num_yrs_obs, num_yrs_surv, CAST(num_yrs_obs AS DOUBLE) / num_yrs_surv AS frac_yrs FROM o JOIN t USING (regionfact, ocean, surveyfact)""", fl="frac_yrs")
def _(v):
    return V.stratum_coverage(v.hauls()).select("stratum", "regionfact", "num_yrs_obs", "num_yrs_surv", "frac_yrs")


@query("j5_species_years", """
    SELECT upper(substr(sppocean, 1, 1)) || substr(split_part(sppocean, '_', 1), 2) AS spp, count(DISTINCT substr(haulid, 1, 4)) AS n FROM v_catch GROUP BY 1""")
def _(v):
    d = v.catch().select(capitalize(F.substring_index("sppocean", "_", 1)).alias("spp"), key_year("haulid").alias("y"))
    return d.groupBy("spp").agg(n_unique("y").alias("n"))
