"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import missing as M
from ..functions import text as X
from ..operators.landings import state_of_landing
from ..operators.stocks import north_american_stocks, stock_subarea
from .registry import query


@query("i1_capitalize", "SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name FROM part")
def _(v):
    return v.table("part").select("p_partkey", X.capitalize("p_name").alias("name"))


@query("i2_sentence_case", "SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS t FROM part")
def _(v):
    return v.table("part").select("p_partkey", X.sentence_case("p_type").alias("t"))


@query("i3_upper_lower", "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up FROM nation")
def _(v):
    return v.table("nation").select("n_nationkey", F.lower("n_name").alias("lo"), F.upper("n_name").alias("up"))


@query("i4_regex_replace", r"""
    SELECT stockid, regexp_replace(areaid, '-.*$', '') AS area, regexp_replace(areaid, '.*-', '') AS last, regexp_replace(areaid, 'USA-NMFS-', '') AS code,
    regexp_replace(stockid, '-[0-9]b?$', '') AS spp FROM v_stock""")
def _(v):
    return v.stock().select(
        "stockid", X.before("areaid", "-").alias("area"), X.after_last("areaid", "-").alias("last"),
        F.regexp_replace("areaid", "USA-NMFS-", "").alias("code"), F.regexp_replace("stockid", "-[0-9]b?$", "").alias("spp"),
    )


@query("i5_split_piece", "SELECT DISTINCT assessid, split_part(assessid, '-', 2) AS stock, '' AS none FROM v_boundaries")
def _(v):
    return v.boundaries().select("assessid", X.piece("assessid", "-", 2, 5).alias("stock"), X.piece("stockid", "-", 4, 5).alias("none")).distinct()


@query("i6_key_year", "SELECT haulid, TRY_CAST(substr(haulid, 1, 4) AS INTEGER) AS year FROM v_hauls")
def _(v):
    return v.hauls().select("haulid", X.key_year("haulid").alias("year"))


@query("i7_trim_names", """
    SELECT DISTINCT "SCINAME", upper(substr(lower("SCINAME"), 1, 1)) || rtrim(substr(lower("SCINAME"), 2)) AS spp FROM v_species_key""")
def _(v):
    return v.species_key().select("SCINAME", X.clean_name("SCINAME").alias("spp")).distinct()


@query("i8_concat_length", "SELECT p_partkey, p_brand || '-' || p_type AS k, length(p_name) AS n FROM part")
def _(v):
    return v.table("part").select("p_partkey", F.concat("p_brand", F.lit("-"), "p_type").alias("k"), F.length("p_name").alias("n"))


@query("i9_nested_conditional", """
    SELECT stockid, CASE WHEN region IN ('US Alaska', 'US Southeast and Gulf') THEN
    CASE replace(areaid, 'USA-NMFS-', '') WHEN 'BS' THEN 'EBS' WHEN 'EBS' THEN 'EBS' WHEN 'BSAI' THEN 'EBS' WHEN 'SATL' THEN 'SEUS' WHEN 'GM' THEN 'GMex' END
    ELSE region END AS subarea FROM v_stock""")
def _(v):
    return v.stock().select("stockid", stock_subarea("areaid", "region").alias("subarea"))


@query("i10_fallback", """
    SELECT stockid, year, coalesce("TB", "SSB") AS bio FROM v_assess""")
def _(v):
    return v.assess().select("stockid", "year", F.coalesce("TB", "SSB").alias("bio"))


@query("i10_state_fallback", """
    SELECT state, count(*) AS n FROM (SELECT CASE WHEN regexp_replace(portlnd1, '.*_', '') = 'NA' THEN regexp_replace(dec_port, '.*_', '') ELSE regexp_replace(portlnd1, '.*_', '') END AS state FROM v_trips) GROUP BY 1""")
def _(v):
    return v.trips().groupBy(state_of_landing("portlnd1", "dec_port").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("i11_fill", "SELECT haulid, coalesce(depth, 0) AS depth FROM v_hauls")
def _(v):
    return v.hauls().select("haulid", M.fill("depth", 0.0).alias("depth"))


@query("i12_sentinel", "SELECT haulid, sppocean, nullif(wtcpue, -9999) AS wtcpue FROM v_catch")
def _(v):
    return v.catch().select("haulid", "sppocean", M.sentinel_to_null("wtcpue").alias("wtcpue"))


@query("i13_zero_floor", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 1e-4::DOUBLE ELSE l_tax END AS tax FROM lineitem""", fl="tax")
def _(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", M.floor_zero("l_tax").alias("tax"))


@query("i14_squeeze", """
    SELECT spp, lat_bin, year, CASE WHEN pres2 = 0 THEN 1e-5::DOUBLE WHEN pres2 = 1 THEN 1 - 1e-5::DOUBLE ELSE pres2 END AS p FROM v_bio_panel""", fl="p")
def _(v):
    return v.bio_panel().select("spp", "lat_bin", "year", M.squeeze("pres2").alias("p"))


@query("i15_math", """
    SELECT o_orderkey, ln(o_totalprice) AS l, exp(o_totalprice / 1e6) AS e, abs(o_totalprice - 2e5) AS a, sqrt(o_totalprice) AS s, sign(o_totalprice - 2e5)::DOUBLE AS g FROM orders""", fl="l e a s")
def _(v):
    x = F.col("o_totalprice")
    return v.table("orders").select("o_orderkey", F.ln(x).alias("l"), F.exp(x / 1e6).alias("e"), F.abs(x - 2e5).alias("a"), F.sqrt(x).alias("s"), F.signum(x - 2e5).alias("g"))


@query("i16_log_ratio", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN ln(l_discount / l_tax) END AS r FROM lineitem""", fl="r")
def _(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", M.log_ratio("l_discount", F.nullif("l_tax", F.lit(0.0))).alias("r"))


@query("i17_round_multiple", """
    SELECT haulid, round_even(lat / 0.1::DOUBLE, 0) * 0.1::DOUBLE AS lat_1, round_even(lon / 0.1::DOUBLE, 0) * 0.1::DOUBLE AS lon_1 FROM v_hauls""", fl="lat_1 lon_1")
def _(v):
    return v.hauls().select("haulid", G.round_to("lat", 0.1).alias("lat_1"), G.round_to("lon", 0.1).alias("lon_1"))


@query("i18_bin", """
    SELECT lat_bin, count(*) AS n, min(lat) AS lo, max(lat) AS hi FROM (SELECT lat, CASE WHEN lat > 30 AND lat <= 46 THEN ceil(lat) - 0.5::DOUBLE END AS lat_bin FROM v_hauls) GROUP BY 1""")
def _(v):
    d = v.hauls().select("lat", G.bin_mid("lat", 30, 46).alias("lat_bin"))
    return d.groupBy("lat_bin").agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("lo"), F.max("lat").alias("hi"))


@query("i20_units", """
    SELECT state, taxa_format, year, tl_lb, tl_lb * 0.000453592::DOUBLE AS mt, tl_lb / 1000 AS per FROM v_state_land""", fl="mt per")
def _(v):
    return v.state_land().select("state", "taxa_format", "year", "tl_lb", (F.col("tl_lb") * 0.000453592).alias("mt"), (F.col("tl_lb") / 1000).alias("per"))


@query("i21_sequence", """
    SELECT regionfact, CAST(unnest(generate_series(min(year), max(year))) AS INTEGER) AS year FROM v_hauls GROUP BY 1""")
def _(v):
    d = v.hauls().groupBy("regionfact").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return d.select("regionfact", F.explode(F.sequence("lo", "hi")).alias("year"))


@query("j6_parse_species", """
    SELECT sppocean, upper(substr(sppocean, 1, 1)) || substr(split_part(sppocean, '_', 1), 2) AS spp, split_part(sppocean, '_', 2) AS ocean, count(*) AS n FROM v_catch GROUP BY 1""")
def _(v):
    from ..operators.survey import parse_species_key

    return parse_species_key(v.catch()).groupBy("sppocean", "spp", "ocean").agg(F.count(F.lit(1)).alias("n"))


@query("j8_stock_subarea", """
    SELECT stockid, region, subarea FROM (SELECT stockid, region, areaid, CASE WHEN region IN ('US Alaska', 'US Southeast and Gulf') THEN
    CASE replace(areaid, 'USA-NMFS-', '') WHEN 'EBS' THEN 'EBS' WHEN 'BSAI' THEN 'EBS' WHEN 'SATL' THEN 'SEUS' WHEN 'GM' THEN 'GMex' END
    ELSE region END AS subarea FROM v_stock) WHERE split_part(areaid, '-', 1) IN ('USA', 'Canada')""")
def _(v):
    return north_american_stocks(v.stock()).select("stockid", "region", "subarea")
