"""Domain tables derived from the generic order/part/event tables.

Each stand-in exists twice: as a DataFrame (``View``) and as SQL for the
correctness oracle (``SQL``).  Integer modulus formulas make positions,
environment and missing values, so both give the same numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bin_mid
from ..functions.text import capitalize
from ..operators.relational import grid, merge
from ..operators.survey import survey_landings_panel, zero_fill_summary
from ..session import cut
from .tables import rectangle

# -- fixed values of the stand-ins ---------------------------------------------
REGION_CODE = ["NEFSC_NEUS", "AFSC_EBS", "NWFSC_WCAnn", "SCDNR_SEUS", "DFO_ScotianShelf"]
STATE_ABB = ["ma", "me", "ri", "nj", "va"]
STATE_NAME = ["Massachusetts", "Maine", "Rhode Island", "New Jersey", "Virginia"]
STOCK_REGION = ["US East Coast", "US Alaska", "US West Coast", "US Southeast and Gulf", "Canada East Coast"]
AREA_ID = [
    ["USA-NMFS-NE", "USA-NMFS-EBS", "USA-NMFS-WC", "USA-NMFS-SATL", "Canada-DFO-4X"],
    ["USA-NMFS-5Z", "USA-NMFS-BSAI", "USA-NMFS-PC", "USA-NMFS-GM", "Mexico-INP-GM"],
]


# -- schemas of the driver tables read here: declared, so that no file is opened
# -- to infer them
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _pick(values, i):
    """``values[i]`` for a column ``i`` of small integers."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def _sql_pick(values, i):
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST({i} AS INTEGER) + 1]"


class View:
    """DataFrames of the stand-ins over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    # survey ------------------------------------------------------------------
    def hauls(self) -> DataFrame:
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        d = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        k, y = F.col("o_orderkey"), F.year("o_orderdate")
        region = _pick(REGION_CODE, F.col("n_regionkey"))
        d = d.select(
            F.concat(y.cast("string"), F.lit("-"), k.cast("string")).alias("haulid"),
            y.alias("year"), F.month("o_orderdate").alias("month"), region.alias("regionfact"), region.alias("region"),
            F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("stratum"),
            F.lit("Atl").alias("ocean"), F.concat(region, F.lit("_bts")).alias("surveyfact"),
            ((3000 + k * 37 % 1700) / 100).alias("lat"), ((k * 53 % 1100 - 7600) / 100).alias("lon"),
            F.when(k % 13 != 0, F.col("o_totalprice") / 1000).alias("depth"),
            ((k * 3 % 100) / 10).alias("rugosity"), ((k * 5 % 90) / 10).alias("GRAINSIZE"),
            F.when(k % 1009 != 0, (400 + k * 7 % 1500 + (y - 1995) * 10) / 100).alias("SBT_actual"),
            ((900 + k * 11 % 1700) / 100).alias("SST_actual"),
            ((500 + k * 13 % 1400) / 100).alias("SBT_seasonal"),
            ((1000 + k * 17 % 1500) / 100).alias("SST_seasonal_mean"),
        )
        return d.withColumns({
            "SBT_min": F.col("SBT_actual") - 2, "SBT_max": F.col("SBT_actual") + 3,
            "SST_min": F.col("SST_actual") - 4, "SST_max": F.col("SST_actual") + 5,
        })

    def catch(self) -> DataFrame:
        li, p, o = self.table("lineitem"), self.table("part"), self.table("orders")
        d = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey", "p_type").agg(
            F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")
        )
        d = d.join(o.select("o_orderkey", "o_orderdate"), d.l_orderkey == F.col("o_orderkey"))
        miss = (F.col("l_orderkey") * 7 + F.col("q").cast("long")) % 997 == 0
        return d.select(
            F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("haulid"),
            F.concat(F.lower("p_type"), F.lit(" marina_Atl")).alias("sppocean"),
            F.when(miss, F.lit(-9999.0)).otherwise(F.col("q")).alias("wtcpue"),
            F.when(F.col("n") == 3, F.lit(-9999.0)).otherwise(F.col("n").cast("double")).alias("cntcpue"),
            F.when(~miss, F.ln("q")).alias("logwtcpue"), F.lit(True).alias("presfit"),
        )

    def catch_spp(self) -> DataFrame:
        """Catches with the species name in place of the species-ocean key."""
        return self.catch().withColumn("spp", capitalize(F.substring_index("sppocean", "_", 1))).select(
            "haulid", "spp", "wtcpue", "cntcpue"
        )

    def neus_hauls(self) -> DataFrame:
        return self.hauls().where(F.col("regionfact") == "NEFSC_NEUS")

    # areas --------------------------------------------------------------------
    def stat_areas(self) -> DataFrame:
        k = F.col("n_nationkey")
        row, col = F.floor(k / 5), k % 5
        d = self.table("nation").where(k != 12).select(
            k.alias("Id"), ((col * 22 - 760) / 10).alias("lon_lo"), ((col * 22 - 738) / 10).alias("lon_hi"),
            ((row * 34 + 300) / 10).alias("lat_lo"), ((row * 34 + 334) / 10).alias("lat_hi"),
        )
        ring = rectangle(*[F.col(c) for c in ("lon_lo", "lon_hi", "lat_lo", "lat_hi")])
        return d.select(
            "Id", ((F.col("lon_lo") + F.col("lon_hi")) / 2).alias("lon"), ((F.col("lat_lo") + F.col("lat_hi")) / 2).alias("lat"),
            (F.lit(1000.0) + F.col("Id") * 10.0).alias("area"), ring.alias("ring"),
        )

    def stock_map(self) -> DataFrame:
        n = self.table("nation").select("n_nationkey", "n_regionkey")
        d = grid(n, self.table("part"), "p_type")
        return d.select(
            F.concat("p_type", F.lit("-"), F.col("n_regionkey").cast("string")).alias("RAM_stockid"),
            capitalize(F.concat(F.lower("p_type"), F.lit(" marina"))).alias("spp"),
            F.substring("p_type", 1, 3).alias("VTR_sppcode"), F.col("n_nationkey").alias("StatArea"),
            F.when(F.col("n_nationkey") % 3 == 0, "y").otherwise("n").alias("DoubleLat"),
        )

    def boundaries(self) -> DataFrame:
        """Two features per stock; only the first is meant to count."""
        d = self.stock_map().select("RAM_stockid", "spp").distinct()
        r = F.substring_index("RAM_stockid", "-", -1).cast("int")
        d = d.select(
            F.concat(F.lit("ORG-"), F.col("RAM_stockid"), F.lit("-1995-2001-X")).alias("assessid"),
            F.col("RAM_stockid").alias("stockid"), F.col("spp").alias("species"),
            F.when(r == 4, "Mexico").when(r == 3, "Canada").otherwise("USA").alias("country"), r.alias("r"),
            F.explode(F.array(F.lit(0), F.lit(1))).alias("feature_id"),
        )
        lat, lon = 30 + 3.0 * F.col("r") + 2.0 * F.col("feature_id"), -76 + 2.0 * F.col("r") + F.col("feature_id")
        return d.select("assessid", "stockid", "species", "country", "feature_id",
                        rectangle(lon, lon + 3.0, lat, lat + 4.0).alias("ring"))

    # landings ---------------------------------------------------------------------
    def _lines(self) -> DataFrame:
        li, p, s, n = (self.table(t) for t in ("lineitem", "part", "supplier", "nation"))
        d = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
        d = d.join(n, s.s_nationkey == n.n_nationkey)
        return d.withColumn("code", _code())

    def land_area(self) -> DataFrame:
        d = self._lines().groupBy(F.year("l_shipdate").alias("YEAR"), F.col("s_nationkey").alias("AREA"), F.col("code").alias("NESPP3"))
        q = F.sum("l_quantity")
        return d.agg(F.when(q.cast("long") % 19 != 0, q).alias("SPPLIVMT"))

    def species_key(self) -> DataFrame:
        """Species codes with duplicates, NULL codes and stray blanks."""
        name = F.concat(F.upper("p_type"), F.lit(" MARINA"), F.when(F.col("p_type") == "LARGE", "  ").otherwise(""))
        return self.table("part").select(
            F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 50 != 0, _code()).alias("NESPP3"),
            name.alias("SCINAME"), F.col("p_name").alias("COMNAME"),
        )

    def trips(self) -> DataFrame:
        k, ln, st = F.col("l_orderkey"), F.col("l_linenumber"), _pick(STATE_ABB, F.col("n_regionkey"))
        return self._lines().select(
            F.substring("p_type", 1, 3).alias("sppcode"), F.year("l_shipdate").alias("year"),
            F.col("s_nationkey").alias("cnemarea"),
            F.when((k * 7 + ln) % 29 != 0, F.col("l_quantity")).alias("qtykept"),
            k.alias("anon_id"), F.when(F.col("l_suppkey") % 11 != 0, F.col("l_suppkey")).alias("VP_anon"),
            ((k * 37 + ln * 211) % 1700 / 100 + 30.5).alias("declat"), ((k * 53 + ln * 97) % 1100 / 100 - 76).alias("declon"),
            F.when(F.col("l_suppkey") % 4 == 0, "harbour_NA").otherwise(F.concat(F.lit("port_x_"), st)).alias("portlnd1"),
            F.concat(F.lit("dock_"), st).alias("dec_port"),
        )

    def state_land(self) -> DataFrame:
        d = self._lines().withColumn("year", F.year("l_shipdate"))
        st = _pick(STATE_NAME, F.col("n_regionkey"))
        g = d.groupBy(st.alias("state"), F.lower("p_type").alias("taxa_format"), "year", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
        lb = F.when(F.col("taxa_format") == "small", 5000.0 + 10.0 * F.col("year")).otherwise(F.col("q"))
        return g.select("state", "taxa_format", "year", lb.alias("tl_lb"), (lb * 0.000453592).alias("tl_mt"))

    def taxa_names(self) -> DataFrame:
        """State species names matched to species; several records, one unmatched."""
        p = self.table("part").select("p_type", (F.col("p_size") % 2).alias("v")).distinct()
        return p.select(
            F.lower("p_type").alias("taxa_format"),
            F.when(F.col("p_type") != "PROMO", capitalize(F.concat(F.lower("p_type"), F.lit(" marina")))).alias("spp"),
            (100.0 + F.col("v") * 50.0).alias("mean_land_lb"),
        )

    # stocks -------------------------------------------------------------------------
    def assess(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_orderdate")
        d = self._lines().join(o, F.col("l_orderkey") == o.o_orderkey)
        half = F.floor(F.col("s_nationkey") / 5) % 2
        d = d.groupBy(
            _stockid(F.col("n_regionkey"), half).alias("stockid"), F.year("o_orderdate").alias("year")
        ).agg(F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("q"))
        c, q = F.col("c"), F.col("q")
        qi = q.cast("long")
        return d.select(
            "stockid", "year", F.when(qi % 3 != 0, q).alias("TB"), F.when(qi % 4 != 0, q * 0.5).alias("SSB"),
            F.when(c % 5 != 0, (c % 20) / 10.0).alias("UdivUmsypref"), F.when(c % 6 != 0, (c % 7) / 10.0).alias("F"),
            F.when(c % 4 != 0, (qi % 100) / 100.0).alias("ER"), q.alias("Ctouse"),
            F.when(c % 9 != 0, (c % 11) / 10.0).alias("Utouse"),
        )

    def stock(self) -> DataFrame:
        n = self.table("nation").select("n_regionkey", (F.floor(F.col("n_nationkey") / 5) % 2).alias("half")).distinct()
        d = grid(n, self.table("part"), "p_type")
        r = F.col("n_regionkey")
        return d.select(
            _stockid(r, F.col("half")).alias("stockid"),
            F.when(F.col("half") == 0, _pick(AREA_ID[0], r)).otherwise(_pick(AREA_ID[1], r)).alias("areaid"),
            _pick(STOCK_REGION, r).alias("region"), capitalize(F.concat(F.lower("p_type"), F.lit(" marina"))).alias("scientificname"),
        )

    # tickets ---------------------------------------------------------------------------
    def tickets(self) -> DataFrame:
        return self._lines().select(
            F.col("code").alias("ADFG_I_SPECIES_CODE"), (F.col("code") * 2).alias("AKFIN_SPECIES_CODE"),
            (300000 + F.col("l_suppkey")).cast("int").alias("ADFG_I_STAT_AREA"), F.year("l_shipdate").alias("AKFIN_YEAR"),
            F.when(F.col("l_orderkey") % 997 != 0, F.col("l_quantity")).alias("WHOLE_LBS"), F.col("l_linenumber").alias("N_FT"),
            F.col("n_name").alias("FMP_AREA"), _pick(STATE_ABB, F.col("n_regionkey")).alias("FMP_SUBAREA"),
        )

    def ak_species(self) -> DataFrame:
        p = self.table("part").select("p_type", _code().alias("code")).distinct()
        return p.select(
            F.col("code").alias("ADFG_I_SPECIES_CODE"), (F.col("code") * 2).alias("AKFIN_SPECIES_CODE"),
            (F.col("code") + 1000).alias("OBS_SPECIES_NO"), capitalize(F.concat(F.lower("p_type"), F.lit(" marina"))).alias("spp"),
        )

    def observer(self) -> DataFrame:
        return self._lines().select(
            (F.col("code") + 1000 + F.when(F.col("l_orderkey") % 10 == 0, 5000).otherwise(0)).alias("OBS_SPECIE_CODE"),
            F.col("l_orderkey").alias("haul"), F.col("l_linenumber").alias("line"), "l_quantity",
        )

    def areas_new(self) -> DataFrame:
        s = self.table("supplier").where(F.col("s_suppkey") % 5 != 0)
        return s.select((300000 + F.col("s_suppkey")).cast("int").alias("STAT_AREA"),
                        (F.col("s_suppkey") % 100 - 180.0).alias("lon"), (F.col("s_suppkey") % 20 + 50.0).alias("lat"))

    def areas_old(self) -> DataFrame:
        s = self.table("supplier").where(F.col("s_suppkey") % 3 == 0)
        return s.select((300000 + F.col("s_suppkey")).cast("int").alias("STAT_AREA"),
                        (F.col("s_suppkey") % 90 - 179.0).alias("lon"), (F.col("s_suppkey") % 25 + 48.0).alias("lat"))

    # panels -------------------------------------------------------------------------------
    def panel(self) -> DataFrame:
        """Users by day: gaps where a user has no event."""
        return self.table("events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(
            F.avg("value").alias("y"), F.count(F.lit(1)).cast("double").alias("x"),
            F.sum((F.col("event_type") == "click").cast("double")).alias("clicks"),
            F.sum((F.col("event_type") == "purchase").cast("double")).alias("buys"),
            F.max("value").alias("peak"),
        ).withColumn("grp", (F.col("user_id") % 3).cast("int"))


    def bin_landings(self) -> DataFrame:
        t = self.trips().withColumn("lat_bin", bin_mid("declat", 30, 46)).where(F.col("lat_bin").isNotNull())
        names = self.stock_map().select("VTR_sppcode", "spp").distinct()
        t = merge(t, names, by_x="sppcode", by_y="VTR_sppcode", nulls="drop")
        return t.groupBy("spp", "lat_bin", "year").agg(F.sum("qtykept").alias("tl_mt"))

    def bio_panel(self) -> DataFrame:
        """Species by latitude bin and year: survey means and landings.

        Stored, as the panel is the hand-over between the survey summary and
        the models, which read it several times.
        """
        h = self.hauls().withColumn("lat_bin", bin_mid("lat", 30, 46)).where(F.col("lat_bin").isNotNull())
        h = h.withColumnsRenamed({"SBT_seasonal": "SBT", "SST_seasonal_mean": "SST"})
        s = zero_fill_summary(self.catch_spp(), h, ["lat_bin", "year"], strict=("SBT", "SST", "SBT_max", "SST_max"), skip=("depth",))
        s = s.drop("wtcpue_skip")
        return cut(survey_landings_panel(s, self.bin_landings(), ["spp", "lat_bin", "year"], "tl_mt").drop("tl_mt"))


def _stockid(region, half):
    return F.concat("p_type", F.lit("-"), region.cast("string"), F.when(half == 1, "b").otherwise(""))


def _code():
    """Landing code of a part: one of two per species."""
    return (101 + F.length("p_type") + F.ascii(F.substr("p_type", F.lit(2))) % 7 * 10 + F.col("p_size") % 2 * 100).cast("int")


_CODE = "CAST(101 + length(p_type) + ascii(substr(p_type, 2)) % 7 * 10 + p_size % 2 * 100 AS INTEGER)"
_SPP = "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' marina'"
_STOCKID = "p_type || '-' || n_regionkey || CASE WHEN {half} = 1 THEN 'b' ELSE '' END"
_RC = _sql_pick(REGION_CODE, "n_regionkey")

SQL = {
    "v_hauls": f"""
        SELECT year || '-' || k AS haulid, year, month, r AS regionfact, r AS region, 'S' || o_custkey AS stratum,
               'Atl' AS ocean, r || '_bts' AS surveyfact, CAST(3000 + k * 37 % 1700 AS DOUBLE) / 100 AS lat,
               CAST(k * 53 % 1100 - 7600 AS DOUBLE) / 100 AS lon,
               CASE WHEN k % 13 <> 0 THEN o_totalprice / 1000 END AS depth,
               CAST(k * 3 % 100 AS DOUBLE) / 10 AS rugosity, CAST(k * 5 % 90 AS DOUBLE) / 10 AS "GRAINSIZE",
               sbt AS "SBT_actual", sst AS "SST_actual", CAST(500 + k * 13 % 1400 AS DOUBLE) / 100 AS "SBT_seasonal",
               CAST(1000 + k * 17 % 1500 AS DOUBLE) / 100 AS "SST_seasonal_mean",
               sbt - 2 AS "SBT_min", sbt + 3 AS "SBT_max", sst - 4 AS "SST_min", sst + 5 AS "SST_max"
        FROM (SELECT *, o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
                     {_RC} AS r,
                     CASE WHEN o_orderkey % 1009 <> 0 THEN CAST(400 + o_orderkey * 7 % 1500 + (year(o_orderdate) - 1995) * 10 AS DOUBLE) / 100 END AS sbt,
                     CAST(900 + o_orderkey * 11 % 1700 AS DOUBLE) / 100 AS sst
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "v_catch": """
        SELECT year(o_orderdate) || '-' || o_orderkey AS haulid, lower(p_type) || ' marina_Atl' AS sppocean,
               CASE WHEN (l_orderkey * 7 + CAST(q AS BIGINT)) % 997 = 0 THEN CAST(-9999 AS DOUBLE) ELSE q END AS wtcpue,
               CASE WHEN n = 3 THEN CAST(-9999 AS DOUBLE) ELSE CAST(n AS DOUBLE) END AS cntcpue,
               CASE WHEN (l_orderkey * 7 + CAST(q AS BIGINT)) % 997 <> 0 THEN ln(q) END AS logwtcpue, TRUE AS presfit
        FROM (SELECT l_orderkey, p_type, sum(l_quantity) AS q, count(*) AS n
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey""",
    "v_catch_spp": """
        SELECT haulid, upper(substr(sppocean, 1, 1)) || substr(split_part(sppocean, '_', 1), 2) AS spp, wtcpue, cntcpue FROM v_catch""",
    "v_neus": "SELECT * FROM v_hauls WHERE regionfact = 'NEFSC_NEUS'",
    "v_areas": """
        SELECT "Id", (lon_lo + lon_hi) / 2 AS lon, (lat_lo + lat_hi) / 2 AS lat, CAST(1000 + "Id" * 10 AS DOUBLE) AS area,
               lon_lo, lon_hi, lat_lo, lat_hi
        FROM (SELECT n_nationkey AS "Id", CAST(n_nationkey % 5 * 22 - 760 AS DOUBLE) / 10 AS lon_lo,
                     CAST(n_nationkey % 5 * 22 - 738 AS DOUBLE) / 10 AS lon_hi,
                     CAST(n_nationkey // 5 * 34 + 300 AS DOUBLE) / 10 AS lat_lo,
                     CAST(n_nationkey // 5 * 34 + 334 AS DOUBLE) / 10 AS lat_hi FROM nation WHERE n_nationkey <> 12)""",
    "v_stock_map": f"""
        SELECT p_type || '-' || n_regionkey AS "RAM_stockid", {_SPP} AS spp, substr(p_type, 1, 3) AS "VTR_sppcode",
               n_nationkey AS "StatArea", CASE WHEN n_nationkey % 3 = 0 THEN 'y' ELSE 'n' END AS "DoubleLat"
        FROM nation CROSS JOIN (SELECT DISTINCT p_type FROM part)""",
    "v_boundaries": """
        SELECT assessid, stockid, species, country, feature_id, CAST(-76 + 2 * r + feature_id AS DOUBLE) AS lon_lo,
               CAST(-73 + 2 * r + feature_id AS DOUBLE) AS lon_hi, CAST(30 + 3 * r + 2 * feature_id AS DOUBLE) AS lat_lo,
               CAST(34 + 3 * r + 2 * feature_id AS DOUBLE) AS lat_hi
        FROM (SELECT DISTINCT 'ORG-' || "RAM_stockid" || '-1995-2001-X' AS assessid, "RAM_stockid" AS stockid, spp AS species,
                     CAST(split_part("RAM_stockid", '-', 2) AS INTEGER) AS r,
                     CASE CAST(split_part("RAM_stockid", '-', 2) AS INTEGER) WHEN 4 THEN 'Mexico' WHEN 3 THEN 'Canada' ELSE 'USA' END AS country
              FROM v_stock_map) CROSS JOIN (SELECT unnest([0, 1]) AS feature_id)""",
    "v_lines": f"""
        SELECT *, {_CODE} AS code, CAST(year(l_shipdate) AS INTEGER) AS yr FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "v_land_area": """
        SELECT yr AS "YEAR", s_nationkey AS "AREA", code AS "NESPP3",
               CASE WHEN CAST(sum(l_quantity) AS BIGINT) % 19 <> 0 THEN sum(l_quantity) END AS "SPPLIVMT"
        FROM v_lines GROUP BY 1, 2, 3""",
    "v_species_key": f"""
        SELECT p_partkey AS ord, CASE WHEN p_partkey % 50 <> 0 THEN {_CODE} END AS "NESPP3",
               upper(p_type) || ' MARINA' || CASE WHEN p_type = 'LARGE' THEN '  ' ELSE '' END AS "SCINAME", p_name AS "COMNAME" FROM part""",
    "v_trips": f"""
        SELECT substr(p_type, 1, 3) AS sppcode, yr AS year, s_nationkey AS cnemarea,
               CASE WHEN (l_orderkey * 7 + l_linenumber) % 29 <> 0 THEN l_quantity END AS qtykept, l_orderkey AS anon_id,
               CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey END AS "VP_anon",
               CAST((l_orderkey * 37 + l_linenumber * 211) % 1700 AS DOUBLE) / 100 + CAST(30.5 AS DOUBLE) AS declat,
               CAST((l_orderkey * 53 + l_linenumber * 97) % 1100 AS DOUBLE) / 100 - 76 AS declon,
               CASE WHEN l_suppkey % 4 = 0 THEN 'harbour_NA' ELSE 'port_x_' || st END AS portlnd1, 'dock_' || st AS dec_port
        FROM (SELECT *, {_sql_pick(STATE_ABB, 'n_regionkey')} AS st FROM v_lines)""",
    "v_state_land": f"""
        SELECT state, taxa_format, year, tl_lb, tl_lb * CAST(0.000453592 AS DOUBLE) AS tl_mt
        FROM (SELECT {_sql_pick(STATE_NAME, 'n_regionkey')} AS state, lower(p_type) AS taxa_format, yr AS year, l_returnflag,
                     CASE WHEN lower(p_type) = 'small' THEN CAST(5000 + 10 * yr AS DOUBLE) ELSE sum(l_quantity) END AS tl_lb
              FROM v_lines GROUP BY 1, 2, 3, 4)""",
    "v_taxa_names": f"""
        SELECT DISTINCT lower(p_type) AS taxa_format, CASE WHEN p_type <> 'PROMO' THEN {_SPP} END AS spp,
               CAST(100 + p_size % 2 * 50 AS DOUBLE) AS mean_land_lb FROM part""",
    "v_assess": f"""
        SELECT stockid, year, CASE WHEN qi % 3 <> 0 THEN q END AS "TB", CASE WHEN qi % 4 <> 0 THEN q * 0.5 END AS "SSB",
               CASE WHEN c % 5 <> 0 THEN CAST(c % 20 AS DOUBLE) / 10 END AS "UdivUmsypref",
               CASE WHEN c % 6 <> 0 THEN CAST(c % 7 AS DOUBLE) / 10 END AS "F",
               CASE WHEN c % 4 <> 0 THEN CAST(qi % 100 AS DOUBLE) / 100 END AS "ER", q AS "Ctouse",
               CASE WHEN c % 9 <> 0 THEN CAST(c % 11 AS DOUBLE) / 10 END AS "Utouse"
        FROM (SELECT {_STOCKID.format(half='s_nationkey // 5 % 2')} AS stockid, CAST(year(o_orderdate) AS INTEGER) AS year,
                     count(*) AS c, sum(l_quantity) AS q, CAST(sum(l_quantity) AS BIGINT) AS qi
              FROM v_lines JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
    "v_stock": f"""
        SELECT {_STOCKID.format(half='half')} AS stockid,
               CASE WHEN half = 0 THEN {_sql_pick(AREA_ID[0], 'n_regionkey')} ELSE {_sql_pick(AREA_ID[1], 'n_regionkey')} END AS areaid,
               {_sql_pick(STOCK_REGION, 'n_regionkey')} AS region, {_SPP} AS scientificname
        FROM (SELECT DISTINCT n_regionkey, n_nationkey // 5 % 2 AS half FROM nation) CROSS JOIN (SELECT DISTINCT p_type FROM part)""",
    "v_tickets": f"""
        SELECT code AS "ADFG_I_SPECIES_CODE", code * 2 AS "AKFIN_SPECIES_CODE", CAST(300000 + l_suppkey AS INTEGER) AS "ADFG_I_STAT_AREA",
               yr AS "AKFIN_YEAR", CASE WHEN l_orderkey % 997 <> 0 THEN l_quantity END AS "WHOLE_LBS", l_linenumber AS "N_FT",
               n_name AS "FMP_AREA", {_sql_pick(STATE_ABB, 'n_regionkey')} AS "FMP_SUBAREA" FROM v_lines""",
    "v_ak_species": f"""
        SELECT DISTINCT {_CODE} AS "ADFG_I_SPECIES_CODE", {_CODE} * 2 AS "AKFIN_SPECIES_CODE", {_CODE} + 1000 AS "OBS_SPECIES_NO",
               {_SPP} AS spp FROM part""",
    "v_observer": """
        SELECT code + 1000 + CASE WHEN l_orderkey % 10 = 0 THEN 5000 ELSE 0 END AS "OBS_SPECIE_CODE", l_orderkey AS haul,
               l_linenumber AS line, l_quantity FROM v_lines""",
    "v_areas_new": """
        SELECT CAST(300000 + s_suppkey AS INTEGER) AS "STAT_AREA", CAST(s_suppkey % 100 - 180 AS DOUBLE) AS lon,
               CAST(s_suppkey % 20 + 50 AS DOUBLE) AS lat FROM supplier WHERE s_suppkey % 5 <> 0""",
    "v_areas_old": """
        SELECT CAST(300000 + s_suppkey AS INTEGER) AS "STAT_AREA", CAST(s_suppkey % 90 - 179 AS DOUBLE) AS lon,
               CAST(s_suppkey % 25 + 48 AS DOUBLE) AS lat FROM supplier WHERE s_suppkey % 3 = 0""",
    "v_zero": """
        SELECT h.*, s.spp, c.haulid IS NOT NULL AS pres2, nullif(coalesce(c.wtcpue, 0), -9999) AS wtcpue,
               ln(CASE WHEN nullif(coalesce(c.wtcpue, 0), -9999) = 0 THEN CAST(1e-4 AS DOUBLE) ELSE nullif(coalesce(c.wtcpue, 0), -9999) END) AS wtcpuenal,
               CASE WHEN lat > 30 AND lat <= 46 THEN ceil(lat) - CAST(0.5 AS DOUBLE) END AS lat_bin
        FROM v_hauls h CROSS JOIN (SELECT DISTINCT spp FROM v_catch_spp) s LEFT JOIN v_catch_spp c ON c.haulid = h.haulid AND c.spp = s.spp""",
    "v_bin_landings": """
        SELECT spp, ceil(declat) - CAST(0.5 AS DOUBLE) AS lat_bin, year, sum(qtykept) AS tl_mt FROM v_trips
        JOIN (SELECT DISTINCT "VTR_sppcode" AS sppcode, spp FROM v_stock_map) USING (sppcode) WHERE declat > 30 AND declat <= 46 GROUP BY 1, 2, 3""",
    "v_bio_panel": """
        SELECT b.*, coalesce(l.tl_mt, 0) AS land_mt FROM (
            SELECT spp, lat_bin, year, avg(CAST(pres2 AS INTEGER)) AS pres2, CASE WHEN count(*) = count(wtcpue) THEN avg(wtcpue) END AS wtcpue,
                   CASE WHEN count(*) = count(wtcpue) THEN avg(wtcpuenal) END AS wtcpuenal,
                   avg("SBT_seasonal") AS "SBT", avg("SST_seasonal_mean") AS "SST",
                   CASE WHEN count(*) = count("SBT_max") THEN avg("SBT_max") END AS "SBT_max", avg("SST_max") AS "SST_max", avg(depth) AS depth, count(*) AS num_hauls
            FROM v_zero WHERE lat_bin IS NOT NULL GROUP BY 1, 2, 3) b LEFT JOIN v_bin_landings l USING (spp, lat_bin, year)""",
    "v_panel": """
        SELECT user_id, CAST(dayofmonth(ts) AS INTEGER) AS day, avg(value) AS y, CAST(count(*) AS DOUBLE) AS x,
               sum(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END)::DOUBLE AS clicks,
               sum(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END)::DOUBLE AS buys, max(value) AS peak,
               CAST(user_id % 3 AS INTEGER) AS grp FROM events GROUP BY user_id, dayofmonth(ts)""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the stand-ins it names, in dependency order."""
    views = SQL | (extra or {})
    order: list[str] = []

    def need(text: str):
        for name in re.findall(r"\bv_\w+", text):
            if name in views and name not in order:
                need(views[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in order) + "\n" + sql
