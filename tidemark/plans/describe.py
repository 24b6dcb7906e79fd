"""Histograms, five-number summaries and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe as D
from .registry import query


@query("l1_histogram", """
    SELECT bin, count(*) AS n, bin * 25::DOUBLE AS bin_lo FROM (
    SELECT CAST(CASE WHEN depth = 0 THEN 0 ELSE ceil(depth / 25) - 1 END AS INTEGER) AS bin FROM v_hauls WHERE depth IS NOT NULL) GROUP BY 1""")
def _(v):
    return D.histogram(v.hauls(), "depth", 0.0, 25.0)


@query("l2_weighted_histogram", """
    SELECT *, weight / sum(weight) OVER (PARTITION BY spp) AS share, sum(weight) OVER (PARTITION BY spp) AS total FROM (
    SELECT spp, bin, count(*) AS n, CAST(sum(CAST(pres2 AS INTEGER)) AS DOUBLE) AS weight, 4 + bin::DOUBLE AS bin_lo
    FROM (SELECT *, CAST(CASE WHEN "SBT_seasonal" = 4 THEN 0 ELSE ceil("SBT_seasonal" - 4) - 1 END AS INTEGER) AS bin FROM v_zero WHERE "SBT_seasonal" IS NOT NULL) GROUP BY 1, 2)""", fl="share")
def _(v):
    from ..operators.survey import zero_fill

    d = zero_fill(v.catch_spp().select("haulid", "spp", "wtcpue"), v.hauls().select("haulid", "SBT_seasonal"))
    return D.histogram(d.withColumn("w", F.col("pres2").cast("double")), "SBT_seasonal", 4.0, 1.0, "spp", "w")


@query("l3_five_numbers", """
    SELECT regionfact, min(depth) AS lowest, quantile_cont(depth, 0.25) AS q1, quantile_cont(depth, 0.5) AS median, quantile_cont(depth, 0.75) AS q3, max(depth) AS highest
    FROM v_hauls GROUP BY 1""", fl="lowest q1 median q3 highest")
def _(v):
    return D.five_numbers(v.hauls(), "regionfact", "depth")


@query("l3_box_plot_by_bin", """
    SELECT spp, lat_bin, min("SBT") AS lowest, quantile_cont("SBT", 0.25) AS q1, quantile_cont("SBT", 0.5) AS median, quantile_cont("SBT", 0.75) AS q3, max("SBT") AS highest
    FROM v_bio_panel GROUP BY 1, 2""", fl="lowest q1 median q3 highest")
def _(v):
    return D.five_numbers(v.bio_panel(), ["spp", "lat_bin"], "SBT")


@query("l4_series", 'SELECT year, lat_bin, land_mt, num_hauls FROM v_bio_panel WHERE spp = \'Promo marina\' AND pres2 > 0')
def _(v):
    return D.series(v.bio_panel(), (F.col("spp") == "Promo marina") & (F.col("pres2") > 0), "year", "lat_bin", "land_mt", "num_hauls")
