"""Landings: stocks and states, reconstruction along latitude, ticket checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import strict_mean
from ..operators import density as K
from ..operators import landings as L
from ..operators import relational as R
from ..operators import stocks as T
from ..session import cut
from .registry import VIEWS, query

BY = ["state", "spp", "sppcode", "RAM_stockid"]
SHIFT = 18  # the stand-in years lie later than the states' first reports

VIEWS["v_vtr"] = """
    SELECT t.*, m."RAM_stockid", m.spp, CASE WHEN regexp_replace(portlnd1, '.*_', '') = 'NA' THEN regexp_replace(dec_port, '.*_', '') ELSE regexp_replace(portlnd1, '.*_', '') END AS state
    FROM v_trips t JOIN v_stock_map m ON t.sppcode = m."VTR_sppcode" AND t.cnemarea = m."StatArea" """
VIEWS["v_main"] = """
    SELECT *, stock_qtykept / nullif(sum(stock_qtykept) OVER w, 0) AS frac_stock FROM
    (SELECT spp, sppcode, "RAM_stockid", state, coalesce(sum(qtykept), 0) AS stock_qtykept, count(DISTINCT year) AS stock_yrs FROM v_vtr GROUP BY 1, 2, 3, 4)
    WINDOW w AS (PARTITION BY sppcode, state)"""
VIEWS["v_vtr_main"] = """
    SELECT v.* FROM v_vtr v JOIN (SELECT sppcode, "RAM_stockid", state, spp FROM v_main WHERE frac_stock > 0.15) m USING (sppcode, "RAM_stockid", state, spp)"""


def _density(x, lo, hi, out, at):
    """SQL of the binned density, cell by cell."""
    step = f"({hi - lo + 4.0}::DOUBLE / 511)"
    return f"""
    SELECT g.state, g.spp, g.sppcode, g."RAM_stockid", i, {lo}::DOUBLE + i * ({hi - lo}::DOUBLE / 511) AS {at},
      sum(mass / total * exp(-0.5 * (({lo}::DOUBLE + i * ({hi - lo}::DOUBLE / 511) - ({lo - 2.0}::DOUBLE + cell * {step})) / 0.5) ** 2) / (0.5 * sqrt(2 * pi()))) AS {out}
    FROM (SELECT state, spp, sppcode, "RAM_stockid", cell, sum(mass) AS mass FROM (
        SELECT state, spp, sppcode, "RAM_stockid", floor(pos) AS cell, qtykept * (1 - (pos - floor(pos))) AS mass FROM (SELECT *, ({x} - {lo - 2.0}::DOUBLE) / {step} AS pos FROM v_vtr_main WHERE qtykept IS NOT NULL)
        UNION ALL SELECT state, spp, sppcode, "RAM_stockid", floor(pos) + 1, qtykept * (pos - floor(pos)) FROM (SELECT *, ({x} - {lo - 2.0}::DOUBLE) / {step} AS pos FROM v_vtr_main WHERE qtykept IS NOT NULL))
        WHERE cell >= 0 AND cell < 512 GROUP BY 1, 2, 3, 4, 5) c
    JOIN (SELECT state, spp, sppcode, "RAM_stockid", sum(qtykept) AS total FROM v_vtr_main GROUP BY 1, 2, 3, 4) g USING (state, spp, sppcode, "RAM_stockid")
    CROSS JOIN (SELECT unnest(generate_series(0, 511)) AS i) GROUP BY 1, 2, 3, 4, 5, 6"""


VIEWS["v_density"] = _density("declat", 30.5, 47.5, "dens_qty", "lat")
VIEWS["v_density_lon"] = _density("declon", -76.0, -65.0, "lon_dens_qty", "lon")
VIEWS["v_state_rolled"] = """
    SELECT state, taxa_format, year, CASE WHEN count(DISTINCT tl_lb) = 1 THEN avg(tl_lb) ELSE sum(tl_lb) END AS tl_lb,
    CASE WHEN count(DISTINCT tl_mt) = 1 THEN avg(tl_mt) ELSE sum(tl_mt) END AS tl_mt, count(*) AS num_rec FROM v_state_land GROUP BY 1, 2, 3"""
VIEWS["v_state_stock"] = """
    SELECT s.*, n.spp, r.state_abb, r.year_catch, m.sppcode, m."RAM_stockid", m.frac_stock, s.tl_lb * m.frac_stock AS tl_lb_stock FROM v_state_rolled s
    JOIN (SELECT taxa_format, spp, avg(mean_land_lb) AS mean_land_lb FROM v_taxa_names WHERE spp IS NOT NULL GROUP BY 1, 2) n USING (taxa_format)
    JOIN (VALUES (1978, 'Massachusetts', 'ma'), (1978, 'Maine', 'me'), (1978, 'Rhode Island', 'ri'), (1996, 'New Jersey', 'nj'), (1998, 'Virginia', 'va')) r(year_catch, state, state_abb) USING (state)
    JOIN (SELECT * FROM v_main WHERE frac_stock > 0.15) m ON n.spp = m.spp AND r.state_abb = m.state"""
VIEWS["v_est"] = """
    SELECT s.state, s.year, s.spp, s.sppcode, s."RAM_stockid", d.lat, d.dens_qty / sum(d.dens_qty) OVER (PARTITION BY s.state, s.year, s.spp, s.sppcode, s."RAM_stockid") * s.tl_lb_stock * 0.000453592::DOUBLE AS tl_mt_est
    FROM v_state_stock s JOIN v_density d ON d.state = s.state_abb AND d.spp = s.spp AND d.sppcode = s.sppcode AND d."RAM_stockid" = s."RAM_stockid" WHERE s.year >= 1960 AND s.year < s.year_catch"""
VIEWS["v_first_key"] = """
    SELECT "NESPP3", upper(substr("SCINAME", 1, 1)) || rtrim(lower(substr("SCINAME", 2))) AS spp FROM
    (SELECT *, row_number() OVER (PARTITION BY "NESPP3" ORDER BY ord) AS rn FROM v_species_key) WHERE rn = 1"""
VIEWS["v_area_lat"] = """
    SELECT k.spp, m."RAM_stockid", l."YEAR" AS year, l.lat, coalesce(sum("SPPLIVMT"), 0) AS tl_mt FROM (SELECT l.*, a.lat FROM v_land_area l JOIN v_areas a ON l."AREA" = a."Id") l
    LEFT JOIN v_first_key k USING ("NESPP3") JOIN v_stock_map m ON m.spp = k.spp AND m."StatArea" = l."AREA" GROUP BY 1, 2, 3, 4"""
VIEWS["v_total_land"] = """
    SELECT spp, "RAM_stockid", year, lat, tl_mt, 'catch_dat' AS source FROM v_area_lat
    UNION ALL SELECT spp, "RAM_stockid", year, lat, sum(tl_mt_est), 'noaa_ann' FROM v_est GROUP BY 1, 2, 3, 4"""
VIEWS["v_land_bin"] = """
    SELECT "RAM_stockid", spp, year, CASE WHEN lat > 30 AND lat <= 46 THEN ceil(lat) - 0.5::DOUBLE END AS lat_bin, sum(tl_mt) AS tl_mt FROM v_total_land GROUP BY 1, 2, 3, 4"""


def vtr(v):
    t = v.trips().withColumn("state", L.state_of_landing("portlnd1", "dec_port"))
    m = v.stock_map().select("VTR_sppcode", "StatArea", "RAM_stockid", "spp")
    return R.merge(t, m, by_x=["sppcode", "cnemarea"], by_y=["VTR_sppcode", "StatArea"], nulls="drop")


def vtr_main(v, main=None):
    keep = (L.main_stocks(vtr(v)) if main is None else main).select("sppcode", "RAM_stockid", "state", "spp")
    return R.merge(vtr(v), keep, by=["sppcode", "RAM_stockid", "state", "spp"])


def lat_density(v, main=None):
    d = K.kernel_density(vtr_main(v, main), BY, "declat", "qtykept", 30.5, 47.5, 0.5)
    return d.withColumnsRenamed({"at": "lat", "dens": "dens_qty"})


def state_stock(v, main):
    return L.state_landings_by_stock(v.state_land(), v.taxa_names(), L.reporting_years(v.spark, SHIFT), main)


def estimates(v):
    """State landings along latitude; the few main stocks are stored, as the
    density and the state totals both start from them."""
    main = cut(L.main_stocks(vtr(v)))
    return L.estimated_landings(state_stock(v, main), lat_density(v, main))


def area_geo(v):
    a = v.stat_areas()
    return a.select(F.col("Id").alias("stat_area"), "lat", "lon", F.col("area").alias("area_km2"))


def area_by_lat(v):
    land = L.landings_per_km2(v.land_area(), area_geo(v))
    return L.area_landings_by_lat(land, L.clean_species_key(v.species_key(), "ord"), v.stock_map())


def total_landings(v):
    return cut(L.combine_landings(estimates(v), area_by_lat(v)))


@query("j29_trips_by_latitude", """
    WITH a AS (SELECT sppcode, year, cnemarea, coalesce(sum(qtykept), 0) AS land, count(DISTINCT anon_id) AS t, count(DISTINCT "VP_anon") + max(CASE WHEN "VP_anon" IS NULL THEN 1 ELSE 0 END) AS vs FROM v_trips GROUP BY 1, 2, 3),
    m AS (SELECT cnemarea, avg(declat) AS declat FROM v_trips GROUP BY 1)
    SELECT sppcode, year, CASE WHEN declat > 34 AND declat <= 45 THEN ceil(declat) - 0.5::DOUBLE END AS lat_bin, sum(land) AS land, CAST(sum(t) AS BIGINT) AS num_trips, CAST(sum(vs) AS BIGINT) AS num_vessels
    FROM a JOIN m USING (cnemarea) GROUP BY 1, 2, 3""")
def _(v):
    t = v.trips()
    meta = t.groupBy("cnemarea").agg(strict_mean("declat").alias("declat"), strict_mean("declon").alias("declon"))
    return L.trips_by_area(t, meta)


@query("j30_state_of_landing", "SELECT state, sppcode, count(*) AS n, coalesce(sum(qtykept), 0) AS qty FROM v_vtr GROUP BY 1, 2")
def _(v):
    from ..functions.missing import skip_sum

    return vtr(v).groupBy("state", "sppcode").agg(F.count(F.lit(1)).alias("n"), skip_sum("qtykept").alias("qty"))


@query("j31_stock_state_landings", """
    WITH b AS (SELECT sppcode, "RAM_stockid", state, year, coalesce(sum(qtykept), 0) AS qtykept FROM v_vtr GROUP BY 1, 2, 3, 4),
    s AS (SELECT "RAM_stockid", sppcode, state, count(DISTINCT year) AS num_yrs_stock FROM b GROUP BY 1, 2, 3), p AS (SELECT sppcode, state, count(DISTINCT year) AS num_yrs_spp FROM b GROUP BY 1, 2)
    SELECT b.*, sum(qtykept) OVER w AS total_qtykept, qtykept / nullif(sum(qtykept) OVER w, 0) AS frac_stock, num_yrs_stock, num_yrs_spp FROM b JOIN s USING ("RAM_stockid", sppcode, state)
    JOIN p USING (sppcode, state) WINDOW w AS (PARTITION BY sppcode, state, year)""", fl="frac_stock")
def _(v):
    return L.stock_state_landings(vtr(v))


@query("j32_main_stocks", """
    SELECT spp, sppcode, "RAM_stockid", state, stock_qtykept, stock_yrs, frac_stock FROM v_main WHERE frac_stock > 0.15""", fl="frac_stock")
def _(v):
    return L.main_stocks(vtr(v)).drop("total_qtykept")


@query("j33_landings_density", """
    SELECT a.state, a.spp, a.sppcode, a."RAM_stockid", CAST(a.i AS INTEGER) AS i, lat, dens_qty, lon, lon_dens_qty FROM v_density a JOIN v_density_lon b USING (state, spp, sppcode, "RAM_stockid", i)""",
       fl="lat dens_qty:8 lon lon_dens_qty:8")
def _(v):
    return K.landings_density(vtr_main(v), BY)


@query("k20_kernel_density", 'SELECT state, spp, sppcode, "RAM_stockid", CAST(i AS INTEGER) AS i, lat, dens_qty FROM v_density', fl="lat dens_qty:8")
def _(v):
    return lat_density(v)


@query("k21_normalised_density", """
    SELECT state, spp, sppcode, "RAM_stockid", CAST(i AS INTEGER) AS i, dens_qty / sum(dens_qty) OVER (PARTITION BY state, spp, sppcode, "RAM_stockid") AS norm_dens FROM v_density""", fl="norm_dens:8")
def _(v):
    return K.normalise(lat_density(v), BY).drop("lat", "dens_qty", "total_dens")


@query("j34_species_key", 'SELECT ord, "NESPP3", "SCINAME", "COMNAME", upper(substr("SCINAME", 1, 1)) || rtrim(lower(substr("SCINAME", 2))) AS spp FROM (SELECT *, row_number() OVER (PARTITION BY "NESPP3" ORDER BY ord) AS rn FROM v_species_key) WHERE rn = 1')
def _(v):
    return L.clean_species_key(v.species_key(), "ord")


@query("j35_landings_per_km2", """
    SELECT l."AREA", l."YEAR", l."NESPP3", 1000 * "SPPLIVMT" / a.area AS kg_km2, t.total FROM v_land_area l JOIN v_areas a ON l."AREA" = a."Id"
    JOIN (SELECT "NESPP3", CASE WHEN count(*) = count("SPPLIVMT") THEN sum("SPPLIVMT") END AS total FROM v_land_area x JOIN v_areas y ON x."AREA" = y."Id" GROUP BY 1) t ON t."NESPP3" = l."NESPP3" """, fl="kg_km2")
def _(v):
    from ..functions.missing import strict_sum

    d = L.landings_per_km2(v.land_area(), area_geo(v))
    t = d.groupBy("NESPP3").agg(strict_sum("SPPLIVMT").alias("total"))
    return R.merge(d, t, by="NESPP3").select("AREA", "YEAR", "NESPP3", "kg_km2", "total")


@query("j36_state_records", """
    SELECT t.taxa_format, t.spp, r.state, r.year, r.tl_lb, r.tl_mt, r.num_rec, t.mean_land_lb FROM v_state_rolled r
    JOIN (SELECT taxa_format, spp, avg(mean_land_lb) AS mean_land_lb FROM v_taxa_names WHERE spp IS NOT NULL GROUP BY 1, 2) t USING (taxa_format)""", fl="tl_mt")
def _(v):
    n = v.taxa_names().where(F.col("spp").isNotNull()).groupBy("taxa_format", "spp").agg(strict_mean("mean_land_lb").alias("mean_land_lb"))
    return R.merge(L.roll_up_state_records(v.state_land()), n, by="taxa_format")


@query("j37_state_landings_by_latitude", 'SELECT state, year, spp, sppcode, "RAM_stockid", lat, tl_mt_est FROM v_est', fl="lat tl_mt_est:9")
def _(v):
    return estimates(v).select("state", "year", "spp", "sppcode", "RAM_stockid", "lat", "tl_mt_est")


@query("j38_landings_by_bin", "SELECT * FROM v_land_bin", fl="tl_mt")
def _(v):
    return L.landings_by_bin(total_landings(v))


@query("j39_landings_centroid", """
    SELECT spp, "RAM_stockid", year, sum(lat * tl_mt) / nullif(sum(tl_mt), 0) AS cent_lat, sum(lat * tl_mt) FILTER (source = 'catch_dat') / nullif(sum(tl_mt) FILTER (source = 'catch_dat'), 0) AS cent_lat_cd,
    sum(tl_mt) AS total_land_mt FROM v_total_land WHERE year >= 1968 GROUP BY 1, 2, 3""", fl="cent_lat cent_lat_cd total_land_mt")
def _(v):
    return L.landings_centroid(total_landings(v))


@query("j40_long_series", 'SELECT * FROM v_land_bin WHERE "RAM_stockid" IN (SELECT "RAM_stockid" FROM v_land_bin GROUP BY spp, "RAM_stockid" HAVING min(year) <= 1995)', fl="tl_mt")
def _(v):
    return L.long_series(cut(L.landings_by_bin(total_landings(v))), 1995)


VIEWS["v_ft"] = """
    SELECT * FROM v_tickets JOIN v_ak_species USING ("ADFG_I_SPECIES_CODE", "AKFIN_SPECIES_CODE")"""
VIEWS["v_mapped"] = """
    SELECT * FROM v_areas_new UNION ALL SELECT * FROM v_areas_old WHERE "STAT_AREA" NOT IN (SELECT "STAT_AREA" FROM v_areas_new)"""
VIEWS["v_unmapped"] = """
    SELECT spp, "AKFIN_YEAR", coalesce(sum("WHOLE_LBS"), 0) AS land_all, CASE WHEN count(*) FILTER (miss AND "WHOLE_LBS" IS NULL) = 0 THEN coalesce(sum("WHOLE_LBS") FILTER (miss), 0) END AS land_nonstat
    FROM (SELECT *, "ADFG_I_STAT_AREA" NOT IN (SELECT "STAT_AREA" FROM v_mapped) AS miss FROM v_ft) GROUP BY 1, 2"""


def tickets(v):
    return R.merge(v.tickets(), v.ak_species(), by=["ADFG_I_SPECIES_CODE", "AKFIN_SPECIES_CODE"])


def mapped(v):
    return R.append_missing(v.areas_new(), v.areas_old(), "STAT_AREA")


@query("j43_unmapped_share", 'SELECT *, land_nonstat / nullif(land_all, 0) AS frac_nonstat FROM v_unmapped', fl="frac_nonstat")
def _(v):
    return L.unmapped_share(tickets(v), mapped(v))


@query("j43_unmapped_areas", """
    SELECT "ADFG_I_STAT_AREA", coalesce(sum("WHOLE_LBS"), 0) AS lbs FROM v_ft WHERE "ADFG_I_STAT_AREA" NOT IN (SELECT "STAT_AREA" FROM v_mapped) GROUP BY 1""")
def _(v):
    from ..functions.missing import skip_sum

    d = R.drop_in(tickets(v), mapped(v), "ADFG_I_STAT_AREA", "STAT_AREA")
    return d.groupBy("ADFG_I_STAT_AREA").agg(skip_sum("WHOLE_LBS").alias("lbs"))


@query("j43_mostly_unmapped", """
    SELECT spp, count(DISTINCT "AKFIN_YEAR") AS num_years FROM v_unmapped WHERE land_nonstat / nullif(land_all, 0) > 0.1 GROUP BY 1 HAVING count(DISTINCT "AKFIN_YEAR") > 1""")
def _(v):
    return L.mostly_unmapped_species(L.unmapped_share(tickets(v), mapped(v)), 0.1, 1)


@query("j44_ticket_counts", """
    SELECT "ADFG_I_STAT_AREA", "FMP_AREA", "FMP_SUBAREA", CAST(sum("N_FT") AS BIGINT) AS n_ft FROM v_ft WHERE spp = 'Promo marina' GROUP BY 1, 2, 3""")
def _(v):
    from ..functions.missing import strict_sum

    d = tickets(v).where(F.col("spp") == "Promo marina")
    return d.groupBy("ADFG_I_STAT_AREA", "FMP_AREA", "FMP_SUBAREA").agg(strict_sum("N_FT").alias("n_ft"))


@query("j45_code_matching", """
    SELECT 'obs' AS source, spp, count(*) AS n FROM v_observer JOIN v_ak_species ON "OBS_SPECIE_CODE" = "OBS_SPECIES_NO" GROUP BY 2
    UNION ALL SELECT 'ft', spp, count(*) FROM v_ft GROUP BY 2""")
def _(v):
    o = R.merge(v.observer(), v.ak_species(), by_x="OBS_SPECIE_CODE", by_y="OBS_SPECIES_NO")
    parts = [d.groupBy(F.lit(s).alias("source"), "spp").agg(F.count(F.lit(1)).alias("n")) for s, d in (("obs", o), ("ft", tickets(v)))]
    return R.stack(*parts)


# -- stocks ---------------------------------------------------------------------------

VIEWS["v_us"] = """
    SELECT a.*, s.scientificname, s.region, s.subarea, y.min_survyr FROM v_assess a JOIN (
      SELECT *, CASE WHEN region IN ('US Alaska', 'US Southeast and Gulf') THEN CASE replace(areaid, 'USA-NMFS-', '') WHEN 'EBS' THEN 'EBS' WHEN 'BSAI' THEN 'EBS' WHEN 'SATL' THEN 'SEUS' WHEN 'GM' THEN 'GMex' END ELSE region END AS subarea
      FROM v_stock WHERE split_part(areaid, '-', 1) IN ('USA', 'Canada')) s ON a.stockid = s.stockid AND s.subarea IS NOT NULL
    JOIN (VALUES ('US East Coast', 1968), ('US Alaska', 1981), ('US West Coast', 1981), ('US Southeast and Gulf', 1981), ('Canada East Coast', 1971)) y(region, min_survyr) ON y.region = s.region"""
VIEWS["v_frac"] = """
    WITH n AS (SELECT scientificname, subarea, region, count(DISTINCT stockid) AS num_stocks FROM v_us GROUP BY 1, 2, 3),
    b AS (SELECT u.*, num_stocks, CASE WHEN num_stocks > 1 THEN coalesce(sum("TB") OVER w, 0) ELSE "TB" END AS tbs, CASE WHEN num_stocks > 1 THEN coalesce(sum("SSB") OVER w, 0) ELSE "SSB" END AS ssbs,
      max(CASE WHEN "UdivUmsypref" IS NOT NULL THEN 1 ELSE 0 END) OVER s AS "U_any", max(CASE WHEN "ER" IS NOT NULL THEN 1 ELSE 0 END) OVER s AS "ER_any", max(CASE WHEN "F" IS NOT NULL THEN 1 ELSE 0 END) OVER s AS "F_any"
      FROM v_us u JOIN n USING (scientificname, subarea, region) WINDOW w AS (PARTITION BY scientificname, region, year), s AS (PARTITION BY scientificname, subarea, year))
    SELECT *, coalesce("TB", "SSB") / nullif(CASE WHEN (tbs = 0 AND ssbs = 0) THEN NULL WHEN NOT (tbs = 0 AND ssbs = 0) THEN CASE WHEN (tbs = 0 AND ssbs > 0) THEN ssbs WHEN NOT (tbs = 0 AND ssbs > 0) THEN tbs END END, 0) AS frac_stock FROM b"""


def _pick(m, c):
    return f'CASE WHEN num_stocks > 1 AND "{m}_any" = 1 THEN coalesce(sum("{c}" * frac_stock), 0) WHEN num_stocks > 1 THEN NULL ELSE max("{c}") END AS "{m}_spp"'


VIEWS["v_intensity"] = f"""
    SELECT *, CASE WHEN "U_spp" > 1 THEN 1::DOUBLE WHEN "U_spp" <= 1 THEN 0::DOUBLE END AS overage FROM (
    SELECT scientificname, subarea, region, year, min_survyr, num_stocks, "U_any", "F_any", "ER_any", {_pick('U', 'UdivUmsypref')}, {_pick('ER', 'ER')}, {_pick('F', 'F')}
    FROM v_frac WHERE year >= min_survyr AND frac_stock IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9)"""


def stock_series(v):
    s = T.with_survey_window(v.assess(), T.north_american_stocks(v.stock()), T.survey_years(v.spark))
    return T.stock_fractions(s)


@query("j26_fishing_intensity", 'SELECT scientificname, subarea, region, year, num_stocks, "U_spp", "ER_spp", "F_spp", overage FROM v_intensity', fl="U_spp ER_spp F_spp")
def _(v):
    return T.species_intensity(stock_series(v)).drop("min_survyr", "U_any", "F_any", "ER_any")


@query("j27_overfishing", """
    SELECT *, num_yrs_overage / nullif(num_yrs, 0) AS frac_yrs_overage FROM (SELECT subarea, region, scientificname, num_stocks, num_yrs, "meanU", "meanER", "meanF", CASE WHEN o = 0 AND num_yrs = 0 THEN NULL ELSE o END AS num_yrs_overage FROM (
    SELECT subarea, region, scientificname, num_stocks, count(DISTINCT year) FILTER ("U_spp" IS NOT NULL) AS num_yrs, avg("U_spp") AS "meanU", avg("ER_spp") AS "meanER", avg("F_spp") AS "meanF",
    CASE WHEN count(*) FILTER ("U_any" = 1 AND overage IS NULL) = 0 THEN coalesce(sum(overage) FILTER ("U_any" = 1), 0) END AS o FROM v_intensity GROUP BY 1, 2, 3, 4))""", fl="meanU meanER meanF frac_yrs_overage")
def _(v):
    return T.species_overage(T.species_intensity(stock_series(v)))


@query("j28_assessment_coverage", """
    SELECT s.stockid, s.scientificname, s.region, count(DISTINCT year) FILTER ("TB" IS NOT NULL) AS "yrs_TB", count(DISTINCT year) FILTER ("SSB" IS NOT NULL) AS "yrs_SSB", min(year) AS min_yr, max(year) AS max_yr
    FROM v_assess a JOIN v_stock s ON a.stockid = s.stockid WHERE s.region = 'US East Coast' GROUP BY 1, 2, 3""")
def _(v):
    j = R.merge(v.assess(), v.stock(), by="stockid")
    p = T.coverage_profile(j, ["stockid", "scientificname", "region"]).where(F.col("region") == "US East Coast")
    return p.select("stockid", "scientificname", "region", "yrs_TB", "yrs_SSB", "min_yr", "max_yr")


@query("j28_series_with_biomass", """
    SELECT stockid, year, "TB", "SSB" FROM v_assess WHERE stockid NOT IN (SELECT stockid FROM (SELECT stockid, CASE WHEN stockid LIKE 'SMALL%' THEN NULL ELSE "TB" END AS t, CASE WHEN stockid LIKE 'SMALL%' THEN NULL ELSE "SSB" END AS s FROM v_assess)
    GROUP BY 1 HAVING count(t) = 0 AND count(s) = 0)""")
def _(v):
    a = v.assess()
    blank = F.col("stockid").startswith("SMALL")
    d = a.withColumns({c: F.when(~blank, F.col(c)) for c in ("TB", "SSB")}).withColumn("region", F.lit("x"))
    none = T.without_biomass(T.coverage_profile(d, ["stockid", "region"]), ["x"])
    return R.drop_in(a, none, "stockid").select("stockid", "year", "TB", "SSB")
