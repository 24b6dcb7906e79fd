"""Sources, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import finite, n_unique, not_in
from ..functions.text import capitalize
from ..operators import relational as R
from ..session import shared_folder
from ..sources import tables as T
from .registry import query

# -- sources -------------------------------------------------------------------


@query("a1_read_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(v):
    path = shared_folder(v.spark) + "/nation_csv"
    v.table("nation").write.mode("overwrite").csv(path, header=True)
    return T.read_csv(v.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("a2_read_snapshot", 'SELECT haulid, lat, lon, depth FROM v_hauls')
def _(v):
    return v.hauls().select("haulid", "lat", "lon", "depth")


@query("a3_write_snapshot", """
    SELECT regionfact, year, count(*) AS n, min(lat) AS lo, max(lat) AS hi FROM v_hauls GROUP BY 1, 2""")
def _(v):
    path = shared_folder(v.spark)
    T.write_bundle(path, hauls=v.hauls().select("haulid", "lat", "year", "regionfact"))
    d = T.read_snapshot(v.spark, f"{path}/hauls")
    return d.groupBy("regionfact", "year").agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("lo"), F.max("lat").alias("hi"))


@query("a3_write_partitioned", "SELECT haulid, lat, year FROM v_hauls WHERE year >= 1999")
def _(v):
    path = T.write_snapshot(v.hauls().select("haulid", "lat", "year"), shared_folder(v.spark) + "/by_year", ["year"])
    return T.read_snapshot(v.spark, path).where(F.col("year") >= 1999)


@query("a4_inline_lookup", """
    SELECT s.stockid, l.min_survyr, l.max_survyr FROM v_stock s JOIN (VALUES ('US East Coast', 1968, 2016), ('US Alaska', 1981, 2016),
    ('US West Coast', 1981, 2016), ('US Southeast and Gulf', 1981, 2016), ('Canada East Coast', 1971, 2016)) l(region, min_survyr, max_survyr)
    ON s.region = l.region""")
def _(v):
    from ..operators.stocks import SURVEY_YEARS

    look = T.literal(v.spark, "region string, min_survyr int, max_survyr int", SURVEY_YEARS)
    return v.stock().join(look, "region").select("stockid", "min_survyr", "max_survyr")


@query("a5_polygon_layer", 'SELECT "Id", lon, lat, 4 AS corners, lon_lo, lat_hi FROM v_areas')
def _(v):
    d = T.polygon_layer(v.stat_areas(), "Id", attrs=["lon", "lat"])
    return d.select(
        "Id", "lon", "lat", F.size("ring").alias("corners"),
        F.array_min(F.transform("ring", lambda p: p["lon"])).alias("lon_lo"),
        F.array_max(F.transform("ring", lambda p: p["lat"])).alias("lat_hi"),
    )


# -- projections ------------------------------------------------------------------


@query("b1_project_rename", "SELECT o_orderkey AS haul, o_custkey AS stratum, o_totalprice AS total FROM orders")
def _(v):
    return v.table("orders").select(
        F.col("o_orderkey").alias("haul"), F.col("o_custkey").alias("stratum"), F.col("o_totalprice").alias("total")
    )


@query("b2_project_names", 'SELECT haulid, regionfact, lat, lon, "SBT_seasonal" FROM v_hauls')
def _(v):
    keep = ["haulid", "regionfact", "lat", "lon", "SBT_seasonal"]
    return v.hauls().select(*keep)


# The columns kept of the assessment series, where they exist.
SERIES = ["stockid", "year", "UdivUmsypref", "FdivFmsy", "ERdivERmsy", "F", "ER", "CdivMSY", "CPUE", "EFFORT", "TBbest", "TB", "SSB", "TC"]


@query("b3_project_existing", 'SELECT stockid, year, "UdivUmsypref", "TB", "SSB", "F", "ER" FROM v_assess')
def _(v):
    return R.pick(v.assess(), SERIES)


@query("b4_derive", """
    SELECT l_orderkey, l_linenumber, l_quantity * (1 - l_discount) AS net, l_quantity / 2 AS half FROM lineitem""", fl="net half")
def _(v):
    d = v.table("lineitem").withColumn("net", F.col("l_quantity") * (1 - F.col("l_discount")))
    return d.withColumn("half", F.col("l_quantity") / 2).select("l_orderkey", "l_linenumber", "net", "half")


@query("b5_derive_many", """
    SELECT l_orderkey, l_linenumber, l_quantity * 2 AS dbl_l_quantity, l_discount * 2 AS dbl_l_discount, l_tax * 2 AS dbl_l_tax
    FROM lineitem""", fl="dbl_l_quantity dbl_l_discount dbl_l_tax")
def _(v):
    cols = ["l_quantity", "l_discount", "l_tax"]
    d = v.table("lineitem").withColumns({f"dbl_{c}": F.col(c) * 2 for c in cols})
    return d.select("l_orderkey", "l_linenumber", *[f"dbl_{c}" for c in cols])


@query("b6_drop_column", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def _(v):
    return v.table("part").drop("p_size", "p_retailprice")


@query("b7_split_column", """
    SELECT DISTINCT split_part(sppocean, '_', 1) AS spp, split_part(sppocean, '_', 2) AS ocean FROM v_catch""")
def _(v):
    p = F.split("sppocean", "_")
    return v.catch().select(p[0].alias("spp"), p[1].alias("ocean")).distinct()


@query("b8_distinct", "SELECT DISTINCT regionfact, year, month FROM v_hauls")
def _(v):
    return v.hauls().select("regionfact", "year", "month").distinct()


@query("b9_constant", "SELECT haulid, 'fall' AS season FROM v_hauls WHERE month IN (9, 10, 11)")
def _(v):
    return v.hauls().where(F.col("month").isin(9, 10, 11)).select("haulid", F.lit("fall").alias("season"))


@query("b10_convert", """
    SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand, TRY_CAST(p_name AS DOUBLE) AS name_num,
           CAST(p_size % 2 = 1 AS INTEGER) AS odd, CAST(CASE WHEN p_size > 25 THEN 'TRUE' ELSE 'FALSE' END AS BOOLEAN) AS big FROM part""")
def _(v):
    return v.table("part").select(
        "p_partkey", F.substr("p_brand", F.lit(7)).try_cast("int").alias("brand"), F.col("p_name").try_cast("double").alias("name_num"),
        (F.col("p_size") % 2 == 1).cast("int").alias("odd"),
        F.when(F.col("p_size") > 25, "TRUE").otherwise("FALSE").try_cast("boolean").alias("big"),
    )


# -- filters --------------------------------------------------------------------------


@query("c1_compare", "SELECT haulid, year, depth FROM v_hauls WHERE regionfact = 'NEFSC_NEUS' AND year >= 1997 AND depth > 100")
def _(v):
    h = v.hauls()
    return h.where((h.regionfact == "NEFSC_NEUS") & (h.year >= 1997) & (h.depth > 100)).select("haulid", "year", "depth")


@query("c2_in_list", "SELECT haulid, month FROM v_hauls WHERE month IN (3, 4, 5)")
def _(v):
    return v.hauls().where(F.col("month").isin(3, 4, 5)).select("haulid", "month")


@query("c3_not_in_list", """
    SELECT haulid, nullif(month, 2) AS m FROM v_hauls WHERE nullif(month, 2) IS NULL OR nullif(month, 2) NOT IN (1, 6, 7)""")
def _(v):
    d = v.hauls().select("haulid", F.nullif("month", F.lit(2)).alias("m"))
    return d.where(not_in("m", (1, 6, 7)))


@query("c4_in_table", """
    SELECT count(*) AS n, sum(wtcpue) AS total FROM v_catch c WHERE EXISTS (SELECT 1 FROM v_neus h WHERE h.haulid IS NOT DISTINCT FROM c.haulid)""")
def _(v):
    d = R.keep_in(v.catch(), v.neus_hauls(), "haulid")
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("wtcpue").alias("total"))


@query("c4_in_table_null", """
    SELECT p_partkey, nullif(p_size, 7) AS s FROM part p WHERE EXISTS
    (SELECT 1 FROM part q WHERE q.p_type = 'SMALL' AND nullif(q.p_size, 7) IS NOT DISTINCT FROM nullif(p.p_size, 7) AND q.p_size < 20)""")
def _(v):
    d = v.table("part").select("p_partkey", "p_type", "p_size", F.nullif("p_size", F.lit(7)).alias("s"))
    return R.keep_in(d, d.where((F.col("p_type") == "SMALL") & (F.col("p_size") < 20)), "s").select("p_partkey", "s")


@query("c5_not_in_table", """
    SELECT haulid FROM v_hauls h WHERE NOT EXISTS (SELECT 1 FROM v_catch c WHERE c.haulid IS NOT DISTINCT FROM h.haulid)""")
def _(v):
    return R.drop_in(v.hauls(), v.catch(), "haulid").select("haulid")


@query("c6_having", """
    SELECT c.spp, count(*) AS n FROM v_catch_spp c WHERE c.spp IN
    (SELECT spp FROM v_catch_spp GROUP BY spp HAVING count(DISTINCT substr(haulid, 1, 4)) >= 5) GROUP BY 1""")
def _(v):
    c = v.catch_spp().withColumn("yr", F.substring("haulid", 1, 4))
    keep = R.having(c, "spp", F.col("num_yrs") >= 5, num_yrs=n_unique("yr"))
    return R.keep_in(c, keep, "spp").groupBy("spp").agg(F.count(F.lit(1)).alias("n"))


@query("c7_complete_cases", 'SELECT haulid, lat, lon, depth FROM v_hauls WHERE lat IS NOT NULL AND lon IS NOT NULL AND depth IS NOT NULL AND "SBT_actual" IS NOT NULL')
def _(v):
    return v.hauls().dropna(subset=["lat", "lon", "depth", "SBT_actual"]).select("haulid", "lat", "lon", "depth")


@query("c8_finite", """
    SELECT haulid, depth FROM v_hauls WHERE depth IS NOT NULL AND NOT isnan(depth) AND NOT isinf(depth)""")
def _(v):
    return v.hauls().where(finite("depth")).select("haulid", "depth")


@query("c9_first_per_key", """
    SELECT ord, "NESPP3", "SCINAME", "COMNAME" FROM (SELECT *, row_number() OVER (PARTITION BY "NESPP3" ORDER BY ord) AS rn FROM v_species_key) WHERE rn = 1""")
def _(v):
    return R.first_per_key(v.species_key(), "NESPP3", "ord")


@query("c10_duplicates", """
    SELECT ord, "NESPP3", "SCINAME", "COMNAME" FROM (SELECT *, row_number() OVER (PARTITION BY "NESPP3" ORDER BY ord) AS rn FROM v_species_key) WHERE rn > 1""")
def _(v):
    return R.later_per_key(v.species_key(), "NESPP3", "ord")


@query("c11_outliers", "SELECT haulid, lat - 38 AS off FROM v_hauls WHERE abs(lat - 38) < 5", fl="off")
def _(v):
    d = v.hauls().select("haulid", (F.col("lat") - 38).alias("off"))
    return d.where(F.abs("off") < 5)


@query("b1_species_name", """
    SELECT DISTINCT upper(substr(sppocean, 1, 1)) || substr(sppocean, 2) AS name FROM v_catch""")
def _(v):
    return v.catch().select(capitalize("sppocean").alias("name")).distinct()
