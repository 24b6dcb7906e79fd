"""Group statistics on rows, lags, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import any_present, skip_sum
from ..operators import panel as P
from ..operators import relational as R
from .registry import query

UNIT = ["spp", "lat_bin"]


def _decade(year="year", width=4):
    """Slab of a lag: groups longer than a slab are cut at its borders."""
    return F.floor(F.col(year) / width)


@query("f1_group_total", """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total FROM lineitem""")
def _(v):
    d = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return P.with_stats(d, "l_suppkey", total=F.sum("l_quantity"))


@query("f2_share", """
    SELECT sppcode, state, q, q / nullif(sum(q) OVER (PARTITION BY sppcode), 0) AS frac FROM
    (SELECT sppcode, substr(dec_port, 6) AS state, coalesce(sum(qtykept), 0) AS q FROM v_trips GROUP BY 1, 2)""", fl="frac")
def _(v):
    d = v.trips().groupBy("sppcode", F.substr("dec_port", F.lit(6)).alias("state")).agg(skip_sum("qtykept").alias("q"))
    return P.share(d, "sppcode", "q", "t", "frac", small=True).drop("t")


@query("f3_group_distinct", """
    SELECT a.stockid, a.year, b.n FROM v_assess a JOIN (SELECT stockid, count(DISTINCT "UdivUmsypref") + max(CASE WHEN "UdivUmsypref" IS NULL THEN 1 ELSE 0 END) AS n FROM v_assess GROUP BY 1) b USING (stockid)""")
def _(v):
    return P.with_n_unique(v.assess().select("stockid", "year", "UdivUmsypref"), "stockid", "UdivUmsypref", "n").drop("UdivUmsypref")


@query("f4_group_any", """
    SELECT stockid, year, max(CASE WHEN "ER" IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY year, substr(stockid, 1, 3)) AS any_er FROM v_assess""")
def _(v):
    d = v.assess().withColumn("s", F.substring("stockid", 1, 3))
    return P.with_stats(d, ["year", "s"], any_er=any_present("ER")).select("stockid", "year", "any_er")


@query("f5_sum_if_many", """
    SELECT stockid, year, CASE WHEN count(*) OVER w > 1 THEN coalesce(sum("TB") OVER w, 0) ELSE "TB" END AS tb FROM v_assess
    WINDOW w AS (PARTITION BY year, split_part(stockid, 'b', 1))""")
def _(v):
    d = v.assess().withColumn("s", F.substring_index("stockid", "b", 1))
    d = P.with_stats(d, ["year", "s"], n=F.count(F.lit(1)), t=skip_sum("TB"))
    return d.select("stockid", "year", F.when(F.col("n") > 1, F.col("t")).otherwise(F.col("TB")).alias("tb"))


@query("f6_group_weighted_stats", """
    SELECT p.spp, lat_bin, year, a.mean_sbtpres, a.sd_sbtpres, a.mean_sbtbio FROM v_bio_panel p JOIN (
    SELECT spp, sum("SBT" * pres2) / sum(pres2) AS mean_sbtpres,
      sqrt((sum("SBT" * "SBT" * pres2) - sum("SBT" * pres2) * sum("SBT" * pres2) / sum(pres2)) / (sum(pres2) - 1)) AS sd_sbtpres,
      CASE WHEN count(*) = count(wtcpuenal) THEN sum("SBT" * wtcpuenal) / sum(wtcpuenal) END AS mean_sbtbio FROM v_bio_panel GROUP BY 1) a USING (spp)""",
       fl="mean_sbtpres sd_sbtpres mean_sbtbio")
def _(v):
    d = P.niche(v.bio_panel(), "spp", {"sbt": "SBT"}, {"pres": "pres2", "bio": "wtcpuenal"})
    return d.select("spp", "lat_bin", "year", "mean_sbtpres", "sd_sbtpres", "mean_sbtbio")


@query("f7_standardise", """
    SELECT spp, lat_bin, year, CASE WHEN avg(land_mt) OVER w = 0 THEN 0 ELSE (land_mt - avg(land_mt) OVER w) / nullif(stddev_samp(land_mt) OVER w, 0) END AS land_scaled
    FROM v_bio_panel WINDOW w AS (PARTITION BY spp)""", fl="land_scaled")
def _(v):
    return P.standardise(v.bio_panel(), "spp", "land_mt", "land_scaled").select("spp", "lat_bin", "year", "land_scaled")


@query("f8_row_lag", """
    SELECT spp, lat_bin, year, lag(land_mt, 1) OVER w AS lag1_land_mt, lag(num_hauls, 1) OVER w AS lag1_num_hauls,
    lag(land_mt, 2) OVER w AS lag2_land_mt, lag(num_hauls, 2) OVER w AS lag2_num_hauls,
    lag(land_mt, 3) OVER w AS lag3_land_mt, lag(num_hauls, 3) OVER w AS lag3_num_hauls
    FROM v_bio_panel WINDOW w AS (PARTITION BY spp, lat_bin ORDER BY year)""")
def _(v):
    d = v.bio_panel().select(*UNIT, "year", "land_mt", "num_hauls")
    return P.spread_lags(d, UNIT, "year", ["land_mt", "num_hauls"]).drop("land_mt", "num_hauls")


@query("f8_row_lag_users", """
    SELECT user_id, event_id, lag(value, 2) OVER w AS back2, lag(value, 1) OVER w AS back1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def _(v):
    d = v.table("events").select("user_id", "event_id", "value")
    back = {"back2": ("value", 2), "back1": ("value", 1)}
    return P.row_shift(d, "user_id", "event_id", back, slab=F.floor(F.col("event_id") / 1000)).drop("value")


@query("f9_row_lead", """
    SELECT spp, lat_bin, year, lead(land_mt) OVER (PARTITION BY spp, lat_bin ORDER BY year) AS land_next FROM v_bio_panel""")
def _(v):
    d = v.bio_panel().select(*UNIT, "year", "land_mt")
    return P.row_shift(d, UNIT, "year", {"land_next": "land_mt"}, -1).drop("land_mt")


@query("f10_difference", """
    SELECT spp, lat_bin, year, wtcpuenal - lag(wtcpuenal) OVER w AS bio_delta, lead("SBT") OVER w - "SBT" AS sbt_next_diff
    FROM v_bio_panel WINDOW w AS (PARTITION BY spp, lat_bin ORDER BY year)""", fl="bio_delta sbt_next_diff")
def _(v):
    d = v.bio_panel().select(*UNIT, "year", "wtcpuenal", "SBT")
    d = P.row_shift(d, UNIT, "year", {"b": "wtcpuenal"}, 1)
    d = P.row_shift(d, UNIT, "year", {"n": "SBT"}, -1)
    return d.select(*UNIT, "year", (F.col("wtcpuenal") - F.col("b")).alias("bio_delta"), (F.col("n") - F.col("SBT")).alias("sbt_next_diff"))


@query("f11_calendar_lag", """
    SELECT a.user_id, a.day, b.x AS lag1, c.x AS lag2 FROM v_panel a LEFT JOIN v_panel b ON a.user_id = b.user_id AND b.day = a.day - 1
    LEFT JOIN v_panel c ON a.user_id = c.user_id AND c.day = a.day - 2""")
def _(v):
    d = v.panel().select("user_id", "day", "x")
    d = P.calendar_lag(P.calendar_lag(d, "user_id", "day", {"lag1": "x"}), "user_id", "day", {"lag2": "x"}, 2)
    return d.drop("x")


_NEIGH = """
    WITH r AS (SELECT spp, lat_bin, row_number() OVER (PARTITION BY spp ORDER BY lat_bin) AS rk FROM (SELECT DISTINCT spp, lat_bin FROM v_bio_panel)),
    x AS (SELECT p.spp, p.lat_bin, p.year, p.land_mt, rk FROM v_bio_panel p JOIN r USING (spp, lat_bin)),
    y AS (SELECT a.spp, a.lat_bin, a.year, a.land_mt, CASE WHEN a.year >= 1996 THEN n.land_mt END AS north, s.land_mt AS south FROM x a
    LEFT JOIN x n ON a.spp = n.spp AND a.year = n.year AND n.rk = a.rk + 1 LEFT JOIN x s ON a.spp = s.spp AND a.year = s.year AND s.rk = a.rk - 1)"""


def _neighbours(v):
    d = v.bio_panel().select(*UNIT, "year", "land_mt")
    d = P.neighbour(d, "spp", "lat_bin", "year", {"north": "land_mt"}, 1, (1996, 2014))
    return P.neighbour(d, "spp", "lat_bin", "year", {"south": "land_mt"}, -1, (1963, 2014))


@query("f12_spatial_lag", _NEIGH + " SELECT spp, lat_bin, year, north, south FROM y")
def _(v):
    return _neighbours(v).drop("land_mt")


@query("f13_spatial_calendar_lag", _NEIGH + """
    SELECT a.spp, a.lat_bin, a.year, b.north AS nlag_ylag1, b.south AS slag_ylag1, c.north AS nlag_ylag2, c.south AS slag_ylag2 FROM y a
    LEFT JOIN y b ON a.spp = b.spp AND a.lat_bin = b.lat_bin AND b.year = a.year - 1
    LEFT JOIN y c ON a.spp = c.spp AND a.lat_bin = c.lat_bin AND c.year = a.year - 2""")
def _(v):
    d = _neighbours(v)
    for k in (1, 2):
        d = P.calendar_lag(d, UNIT, "year", {f"nlag_ylag{k}": "north", f"slag_ylag{k}": "south"}, k)
    return d.drop("land_mt", "north", "south")


@query("f14_demean", """
    SELECT spp, lat_bin, year, "SBT" - avg("SBT") OVER u AS fe_sbt, lag(land_mt) OVER w - avg(land_mt) OVER u AS fe_lag_land FROM v_bio_panel
    WINDOW u AS (PARTITION BY spp, lat_bin), w AS (PARTITION BY spp, lat_bin ORDER BY year)""", fl="fe_sbt fe_lag_land")
def _(v):
    d = v.bio_panel().select(*UNIT, "year", F.col("SBT").alias("sbt"), "land_mt")
    d = P.row_shift(d, UNIT, "year", {"lag_land": "land_mt"}, 1)
    d = P.demean(d, UNIT, ["sbt", "lag_land"], mean_of={"lag_land": "land_mt"})
    return d.select(*UNIT, "year", "fe_sbt", "fe_lag_land")


@query("f15_lag_audit", """
    SELECT * FROM (SELECT a.user_id, a.day, lag(a.x) OVER (PARTITION BY a.user_id ORDER BY a.day) AS by_row, b.x AS by_day
    FROM v_panel a LEFT JOIN v_panel b ON a.user_id = b.user_id AND b.day = a.day - 1) WHERE by_row IS DISTINCT FROM by_day""")
def _(v):
    d = v.panel().select("user_id", "day", "x")
    d = P.row_shift(d, "user_id", "day", {"by_row": "x"}, 1, _decade("day", 8))
    d = P.calendar_lag(d, "user_id", "day", {"by_day": "x"}).drop("x")
    return d.where(~F.col("by_row").eqNullSafe(F.col("by_day")))


@query("g1_sort", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders ORDER BY p ASC NULLS FIRST, o_orderkey")
def _(v):
    d = v.table("orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return d.orderBy("p", "o_orderkey")


@query("g2_head", "SELECT haulid, year, lat FROM v_hauls ORDER BY lat, haulid LIMIT 6")
def _(v):
    return v.hauls().select("haulid", "year", "lat").orderBy("lat", "haulid").limit(6)


@query("k25_autocorrelation", """
    SELECT spp, corr(land_mt, l) AS r, count(*) FILTER (l IS NOT NULL) AS n FROM (SELECT spp, land_mt, lag(land_mt) OVER (PARTITION BY spp, lat_bin ORDER BY year) AS l FROM v_bio_panel) GROUP BY 1""", fl="r")
def _(v):
    d = v.bio_panel().select(*UNIT, "year", "land_mt")
    d = P.row_shift(d, UNIT, "year", {"l": "land_mt"}, 1)
    return d.groupBy("spp").agg(F.corr("land_mt", "l").alias("r"), F.count("l").alias("n"))


@query("h3_keyed_lookup_chain", """
    SELECT spp, "NESPP3", count(*) AS n FROM (SELECT "ADFG_I_SPECIES_CODE" AS "NESPP3", spp FROM v_ak_species) JOIN v_land_area USING ("NESPP3") GROUP BY 1, 2""")
def _(v):
    s = v.ak_species().select(F.col("ADFG_I_SPECIES_CODE").alias("NESPP3"), "spp")
    return R.merge(s, v.land_area(), by="NESPP3").groupBy("spp", "NESPP3").agg(F.count(F.lit(1)).alias("n"))
