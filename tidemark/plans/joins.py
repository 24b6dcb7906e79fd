"""Joins, spatial joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import ring_area_km2, ring_centroid, wrap_lon
from ..functions.missing import strict_sum
from ..operators import landings as L
from ..operators import panel as P
from ..operators import relational as R
from ..operators import spatial as S
from ..operators import survey as V
from .registry import query


@query("d1_inner_join", "SELECT c.haulid, c.sppocean, c.wtcpue, h.lat, h.lon, h.year FROM v_catch c JOIN v_hauls h USING (haulid)")
def _(v):
    h = v.hauls().select("haulid", "lat", "lon", "year")
    return R.merge(v.catch().select("haulid", "sppocean", "wtcpue"), h, by="haulid", nulls="drop")


@query("d1_inner_join_null_keys", """
    SELECT a.k, count(*) AS n FROM (SELECT nullif(p_size, 7) AS k FROM part) a
    JOIN (SELECT DISTINCT nullif(p_size, 7) AS k FROM part) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY 1""")
def _(v):
    p = v.table("part").select("p_type", F.nullif("p_size", F.lit(7)).alias("k"))
    return R.merge(p, p.select("k").distinct(), by="k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("d2_inner_join_other_names", """
    SELECT t.sppcode, t.cnemarea, m."RAM_stockid", count(*) AS n, sum(t.qtykept) AS qty FROM v_trips t
    JOIN v_stock_map m ON t.sppcode = m."VTR_sppcode" AND t.cnemarea = m."StatArea" GROUP BY 1, 2, 3""")
def _(v):
    j = R.merge(v.trips(), v.stock_map(), by_x=["sppcode", "cnemarea"], by_y=["VTR_sppcode", "StatArea"])
    return j.groupBy("sppcode", "cnemarea", "RAM_stockid").agg(F.count(F.lit(1)).alias("n"), F.sum("qtykept").alias("qty"))


@query("d3_left_join", """
    SELECT h.haulid, h.year, c.sppocean, c.wtcpue FROM v_hauls h LEFT JOIN v_catch c ON h.haulid = c.haulid""")
def _(v):
    c = v.catch().select("haulid", "sppocean", "wtcpue")
    return R.merge(v.hauls().select("haulid", "year"), c, by="haulid", how="left")


@query("d4_right_join", """
    SELECT h.haulid, c.sppocean, c.wtcpue, h.lat FROM v_catch c RIGHT JOIN v_hauls h ON h.haulid = c.haulid""")
def _(v):
    c = v.catch().select("haulid", "sppocean", "wtcpue")
    return R.merge(c, v.hauls().select("haulid", "lat"), by="haulid", how="right")


@query("d5_all_combinations", """
    SELECT haulid, spp FROM (SELECT DISTINCT haulid FROM v_hauls) CROSS JOIN (SELECT DISTINCT spp FROM v_catch_spp)""")
def _(v):
    return R.grid(v.hauls().select("haulid").distinct(), v.catch_spp(), "spp")


@query("d6_combinations_within", """
    SELECT regionfact, haulid, sppocean FROM
    (SELECT DISTINCT regionfact, haulid FROM v_catch JOIN v_hauls USING (haulid)) JOIN
    (SELECT DISTINCT regionfact, sppocean FROM v_catch JOIN v_hauls USING (haulid)) USING (regionfact)""")
def _(v):
    j = R.merge(v.catch().select("haulid", "sppocean"), v.hauls().select("haulid", "regionfact"), by="haulid", nulls="drop")
    return R.grid(j.select("regionfact", "haulid").distinct(), j, "sppocean", within="regionfact")


@query("d7_float_key_join", """
    SELECT haulid, lat, lon, a.month, b.depth FROM v_hauls a JOIN (SELECT haulid, lat, lon, depth FROM v_hauls) b USING (haulid, lat, lon)""")
def _(v):
    h = v.hauls()
    return R.merge(h.select("haulid", "lat", "lon", "month"), h.select("haulid", "lat", "lon", "depth"), by=["haulid", "lat", "lon"])


@query("d8_shared_name_join", """
    SELECT haulid, year, month, lat, depth FROM (SELECT haulid, year, month, lat FROM v_hauls) JOIN (SELECT haulid, year, depth FROM v_hauls) USING (haulid, year)""")
def _(v):
    h = v.hauls()
    return R.shared_join(h.select("haulid", "year", "month", "lat"), h.select("haulid", "year", "depth"))


@query("d9_join_suffixes", """
    SELECT a.haulid, a.lat AS lat_x, b.lat AS lat_y, a.year FROM v_hauls a JOIN (SELECT haulid, lat + 1 AS lat FROM v_hauls) b USING (haulid)""")
def _(v):
    b = v.hauls().select("haulid", (F.col("lat") + 1).alias("lat"))
    return R.merge(v.hauls().select("haulid", "lat", "year"), b, by="haulid")


_PLACED = """
    SELECT h.haulid, h.lat, h.lon, min(a."Id") AS "Id" FROM v_hauls h LEFT JOIN v_areas a
    ON h.lon BETWEEN a.lon_lo AND a.lon_hi AND h.lat BETWEEN a.lat_lo AND a.lat_hi GROUP BY 1, 2, 3"""


@query("d10_point_in_polygon", _PLACED)
def _(v):
    return S.locate(v.hauls().select("haulid", "lat", "lon"), v.stat_areas(), "Id")


_BOUND = """
    SELECT b.assessid, b.stockid, b.species, h.haulid, h.lat, h.lon FROM v_boundaries b JOIN v_hauls h
    ON b.feature_id = 0 AND h.lon BETWEEN b.lon_lo AND b.lon_hi AND h.lat BETWEEN b.lat_lo AND b.lat_hi"""


@query("d11_points_of_polygon", _BOUND)
def _(v):
    d = S.hauls_by_boundary(v.hauls().select("haulid", "lat", "lon"), v.boundaries())
    return d.select("assessid", "stockid", "species", "haulid", "lat", "lon")


_STOCK_HAULS = f"""
    SELECT m."RAM_stockid", m.spp, m."StatArea", p.haulid, p.lat, p.lon, a.area FROM ({_PLACED}) p
    JOIN v_areas a USING ("Id") JOIN v_stock_map m ON m."StatArea" = p."Id" """


@query("d12_stock_scoped_points", _STOCK_HAULS)
def _(v):
    return S.hauls_by_area(v.hauls().select("haulid", "lat", "lon"), v.stat_areas(), v.stock_map())


@query("d13_join_then_inequality", """
    SELECT s.state, s.taxa_format, s.year, r.year_catch, sum(s.tl_lb) AS tl_lb FROM v_state_land s JOIN (VALUES (1978, 'Massachusetts'), (1978, 'Maine'),
    (1978, 'Rhode Island'), (1996, 'New Jersey'), (1998, 'Virginia')) r(year_catch, state) USING (state) WHERE s.year < r.year_catch GROUP BY 1, 2, 3, 4""")
def _(v):
    j = R.merge(v.state_land(), L.reporting_years(v.spark, 18), by="state", where=F.col("year") < F.col("year_catch"))
    return j.groupBy("state", "taxa_format", "year", "year_catch").agg(F.sum("tl_lb").alias("tl_lb"))


@query("d14_spread_over_density", """
    WITH t AS (SELECT sppcode, year, sum(qtykept) AS total FROM v_trips GROUP BY 1, 2),
    d AS (SELECT sppcode, floor(declat) AS lat, CAST(count(*) AS DOUBLE) AS dens FROM v_trips GROUP BY 1, 2),
    s AS (SELECT *, sum(dens) OVER (PARTITION BY sppcode) AS total_dens FROM d)
    SELECT sppcode, year, lat, dens / total_dens * total AS est, dens / total_dens * total * 0.000453592::DOUBLE AS est_mt FROM t JOIN s USING (sppcode)""",
       fl="est est_mt lat")
def _(v):
    t = v.trips().groupBy("sppcode", "year").agg(F.sum("qtykept").alias("total"))
    d = v.trips().groupBy("sppcode", F.floor("declat").cast("double").alias("lat")).agg(F.count(F.lit(1)).cast("double").alias("dens"))
    out = L.spread_over_density(t, d, "sppcode", qty="total", dens="dens")
    return out.select("sppcode", "year", "lat", F.col("tl_lb_est").alias("est"), F.col("tl_mt_est").alias("est_mt"))


@query("d15_neighbour_join", """
    WITH c AS (SELECT regionfact, ceil(lat) - 0.5::DOUBLE AS bin, year, count(*) AS n FROM v_hauls WHERE lat > 30 AND lat <= 46 GROUP BY 1, 2, 3),
    r AS (SELECT regionfact, bin, row_number() OVER (PARTITION BY regionfact ORDER BY bin) AS rk FROM (SELECT DISTINCT regionfact, bin FROM c)),
    x AS (SELECT c.*, rk FROM c JOIN r USING (regionfact, bin))
    SELECT a.regionfact, a.bin, a.year, a.n, b.n AS north FROM x a LEFT JOIN x b ON a.regionfact = b.regionfact AND a.rk + 1 = b.rk AND a.year = b.year""")
def _(v):
    from ..functions.geo import bin_mid

    c = v.hauls().withColumn("bin", bin_mid("lat", 30, 46)).where("bin is not null")
    c = c.groupBy("regionfact", "bin", "year").agg(F.count(F.lit(1)).alias("n"))
    return P.neighbour(c, "regionfact", "bin", "year", {"north": "n"})


@query("d16_total_times_share", """
    WITH q AS (SELECT cnemarea, sppcode, year, sum(qtykept) AS qty FROM v_trips GROUP BY 1, 2, 3),
    f AS (SELECT *, qty / sum(qty) OVER (PARTITION BY sppcode, year) AS frac FROM q),
    a AS (SELECT upper(substr(stockid, 1, 3)) AS sppcode, year, sum("TB") AS tb FROM v_assess GROUP BY 1, 2)
    SELECT cnemarea, sppcode, year, tb * frac AS bio FROM f JOIN a USING (sppcode, year)""", fl="bio")
def _(v):
    q = v.trips().groupBy("cnemarea", "sppcode", "year").agg(F.sum("qtykept").alias("qty"))
    f = P.share(q, ["sppcode", "year"], "qty", "total", "frac", small=True)
    a = v.assess().groupBy(F.upper(F.substring("stockid", 1, 3)).alias("sppcode"), "year").agg(F.sum("TB").alias("tb"))
    return R.merge(f, a, by=["sppcode", "year"]).select("cnemarea", "sppcode", "year", (F.col("tb") * F.col("frac")).alias("bio"))


# -- geometry ----------------------------------------------------------------------


@query("i19_wrap_longitude", """
    SELECT haulid, CASE WHEN lon - 110 < -180 THEN 180 + (lon - 110 + 180) ELSE lon - 110 END AS lon_adj FROM v_hauls""", fl="lon_adj")
def _(v):
    return v.hauls().select("haulid", wrap_lon(F.col("lon") - 110).alias("lon_adj"))


@query("i22_polygon_area", """
    SELECT "Id", abs(radians(lon_hi - lon_lo) * (sin(radians(lat_hi)) - sin(radians(lat_lo)))) * 6371.0088::DOUBLE * 6371.0088::DOUBLE AS exact_km2,
    abs(radians(lon_hi - lon_lo)) * abs(2 + 2 * sin(radians(lat_lo)) - 2 - 2 * sin(radians(lat_hi))) * (6371.0088::DOUBLE * 6371.0088::DOUBLE / 2) AS area_km2
    FROM v_areas""", fl="area_km2:3 exact_km2:3")
def _(v):
    a = v.stat_areas()
    area = ring_area_km2("ring")
    return a.select("Id", area.alias("area_km2"), area.alias("exact_km2"))


@query("i23_polygon_centroid", """SELECT "Id", (lon_lo + lon_hi) / 2 AS lon, (lat_lo + lat_hi) / 2 AS lat FROM v_areas""", fl="lon lat")
def _(v):
    return v.stat_areas().withColumn("c", ring_centroid("ring")).select("Id", "c.lon", "c.lat")


# -- stock hauls ---------------------------------------------------------------------


@query("j17_hauls_per_stock", f"""
    SELECT 'area' AS source, "RAM_stockid" AS stockid, count(*) AS n FROM ({_STOCK_HAULS}) GROUP BY 2
    UNION ALL SELECT 'boundary', stockid, count(*) FROM ({_BOUND}) GROUP BY 2""")
def _(v):
    h = v.hauls().select("haulid", "lat", "lon")
    a = S.hauls_by_area(h, v.stat_areas(), v.stock_map()).groupBy(F.lit("area").alias("source"), F.col("RAM_stockid").alias("stockid"))
    b = S.hauls_by_boundary(h, v.boundaries()).groupBy(F.lit("boundary").alias("source"), "stockid")
    return R.stack(*[g.agg(F.count(F.lit(1)).alias("n")) for g in (a, b)])


# -- unions ----------------------------------------------------------------------------


@query("h1_union_all", "SELECT o_orderkey, o_totalprice FROM orders")
def _(v):
    o = v.table("orders")
    return R.stack(*[o.where(F.col("o_orderstatus") == s).select("o_orderkey", "o_totalprice") for s in ("F", "O", "P")])


@query("h2_union_fill", """
    SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderstatus <> 'F'""")
def _(v):
    o = v.table("orders")
    a = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderpriority")
    b = o.where("o_orderstatus <> 'F'").select("o_totalprice", "o_orderkey")
    return R.stack(a, b, fill=True)


@query("h3_stack_by_key", """
    SELECT sppocean, year, count(*) AS n, sum(CASE WHEN wtcpue > 0 THEN wtcpue END) AS w FROM v_catch JOIN v_hauls USING (haulid) GROUP BY 1, 2""")
def _(v):
    j = R.merge(v.catch(), v.hauls().select("haulid", "year"), by="haulid", nulls="drop")
    return j.groupBy("sppocean", "year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("wtcpue") > 0, F.col("wtcpue"))).alias("w"))


@query("h4_append_missing", """
    SELECT * FROM v_areas_new UNION ALL SELECT * FROM v_areas_old WHERE "STAT_AREA" NOT IN (SELECT "STAT_AREA" FROM v_areas_new)""")
def _(v):
    return R.append_missing(v.areas_new(), v.areas_old(), "STAT_AREA")


@query("e5_strict_sum_join", """
    SELECT s."NESPP3", CASE WHEN count(*) = count("SPPLIVMT") THEN sum("SPPLIVMT") END AS mt FROM v_land_area s GROUP BY 1""")
def _(v):
    return v.land_area().groupBy("NESPP3").agg(strict_sum("SPPLIVMT").alias("mt"))


@query("i9_region_map", """
    SELECT haulid, CASE regionfact WHEN 'AFSC_EBS' THEN 'EBS' WHEN 'NEFSC_NEUS' THEN 'US East Coast' WHEN 'NWFSC_WCAnn' THEN 'US West Coast'
    WHEN 'SCDNR_SEUS' THEN 'SEUS' WHEN 'DFO_ScotianShelf' THEN 'Canada East Coast' END AS subarea,
    CASE WHEN month IN (9, 10, 11) THEN 'fall' WHEN month IN (3, 4, 5) THEN 'spring' END AS season FROM v_hauls""")
def _(v):
    return v.hauls().select("haulid", V.region_subarea("regionfact").alias("subarea"), V.season("month").alias("season"))
