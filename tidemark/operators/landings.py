"""Landings: species keys, state records, stock shares, latitude spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bin_mid
from ..functions.missing import ifelse, n_unique, skip_sum, strict_mean, strict_sum, sum_or_mean, weighted_mean
from ..functions.text import after_last, clean_name
from .panel import share, with_n_unique
from .relational import drop_in, first_per_key, having, keep_in, merge, stack

# -- fixed values: pounds to metric tons; first year each state reported ------
LB_TO_MT = 0.000453592
REPORTING = [
    (1960, "Massachusetts", "ma"), (1960, "Maine", "me"), (1960, "Rhode Island", "ri"),
    (1978, "New Jersey", "nj"), (1980, "Virginia", "va"), (1982, "Maryland", "md"),
    (1982, "New Hampshire", "nh"), (1988, "New York", "ny"), (1989, "Delaware", "de"),
    (1989, "Connecticut", "ct"),
]


def reporting_years(spark, shift: int = 0) -> DataFrame:
    """Ten literal rows; ``shift`` moves the years for other periods."""
    return spark.createDataFrame(
        [(y + shift, s, a) for y, s, a in REPORTING], "year_catch int, state string, state_abb string"
    )


def clean_species_key(species: DataFrame, order: str) -> DataFrame:
    """Readable names, and the first record of every code."""
    named = species.withColumn("spp", clean_name("SCINAME"))
    return first_per_key(named, "NESPP3", order)


def state_of_landing(port, fallback) -> Column:
    """State suffix of the port; where it reads 'NA', that of the fallback."""
    s = after_last(port, "_")
    return ifelse(s == "NA", after_last(fallback, "_"), s)


def trips_by_area(trips: DataFrame, area_meta: DataFrame, lo=34, hi=45) -> DataFrame:
    """Landings, trips and vessels by area and year, rolled up to latitude bins.
    Trip and vessel counts add over areas."""
    by_area = trips.groupBy("sppcode", "year", "cnemarea").agg(
        skip_sum("qtykept").alias("land"), n_unique("anon_id").alias("num_trips"), n_unique("VP_anon").alias("num_vessels")
    )
    meta = area_meta.withColumn("lat_bin", bin_mid("declat", lo, hi))
    j = merge(by_area, meta, by="cnemarea")
    return j.groupBy("sppcode", "year", "lat_bin").agg(
        strict_sum("land").alias("land"), strict_sum("num_trips").alias("num_trips"),
        strict_sum("num_vessels").alias("num_vessels"),
    )


def stock_state_landings(trips: DataFrame) -> DataFrame:
    """Yearly landings by stock and state, share of the species, years seen."""
    base = trips.groupBy("sppcode", "RAM_stockid", "state", "year").agg(skip_sum("qtykept").alias("qtykept"))
    out = share(base, ["sppcode", "state", "year"], "qtykept", "total_qtykept", "frac_stock", small=True)
    out = with_n_unique(out, ["RAM_stockid", "sppcode", "state"], "year", "num_yrs_stock", small=True)
    return with_n_unique(out, ["sppcode", "state"], "year", "num_yrs_spp", small=True)


def main_stocks(trips: DataFrame, min_share: float | None = 0.15) -> DataFrame:
    """Each state's landings by stock over all years, keeping shares above ``min_share``."""
    base = trips.groupBy("spp", "sppcode", "RAM_stockid", "state").agg(
        skip_sum("qtykept").alias("stock_qtykept"), n_unique("year").alias("stock_yrs")
    )
    out = share(base, ["sppcode", "state"], "stock_qtykept", "total_qtykept", "frac_stock", small=True)
    return out if min_share is None else out.where(F.col("frac_stock") > min_share)


def landings_per_km2(land: DataFrame, areas: DataFrame) -> DataFrame:
    j = merge(land, areas, by_x="AREA", by_y="stat_area")
    return j.withColumn("kg_km2", F.try_divide(F.lit(1000.0) * F.col("SPPLIVMT"), F.col("area_km2")))


def roll_up_state_records(records: DataFrame) -> DataFrame:
    """One row per state, species and year: several equal records are one."""
    return records.groupBy("state", "taxa_format", "year").agg(
        sum_or_mean("tl_lb").alias("tl_lb"), sum_or_mean("tl_mt").alias("tl_mt"), F.count(F.lit(1)).alias("num_rec")
    )


def spread_over_density(totals: DataFrame, density: DataFrame, by, qty="tl_lb_stock", dens="dens_qty") -> DataFrame:
    """Each total over the grid of its group, in proportion to the density."""
    by = [by] if isinstance(by, str) else list(by)
    d = share(density, by, dens, "total_dens", "__f", small=True)
    j = merge(totals, d, by=by)
    return j.withColumn("tl_lb_est", F.col("__f") * F.col(qty)).withColumn(
        "tl_mt_est", F.col("tl_lb_est") * F.lit(LB_TO_MT)
    ).drop("__f")


def state_landings_by_stock(records: DataFrame, names: DataFrame, reporting: DataFrame, stocks: DataFrame) -> DataFrame:
    """State totals given to stocks by the state's stock shares."""
    n2 = names.where(F.col("spp").isNotNull()).groupBy("taxa_format", "spp").agg(
        strict_mean("mean_land_lb").alias("mean_land_lb")
    )
    j = merge(merge(roll_up_state_records(records), n2, by="taxa_format"), reporting, by="state")
    j = merge(j, stocks, by_x=["spp", "state_abb"], by_y=["spp", "state"])
    return j.withColumn("tl_lb_stock", F.col("tl_lb") * F.col("frac_stock"))


def estimated_landings(state_stock: DataFrame, density: DataFrame, first_year=1960) -> DataFrame:
    """Latitude landings of states for the years before they reported."""
    early = state_stock.where((F.col("year") >= first_year) & (F.col("year") < F.col("year_catch")))
    by = ["state_abb", "spp", "sppcode", "RAM_stockid"]
    d = density.withColumnRenamed("state", "state_abb").select(*by, "lat", "dens_qty")
    return spread_over_density(early, d, by)


def area_landings_by_lat(land: DataFrame, key: DataFrame, stock_map: DataFrame) -> DataFrame:
    """Stat-area landings named, limited to each stock's areas, summed by latitude."""
    j = merge(land, key.select("NESPP3", "spp"), by="NESPP3", how="left").withColumnRenamed("YEAR", "year")
    j = merge(j, stock_map.select("spp", "StatArea", "RAM_stockid"), by_x=["spp", "AREA"], by_y=["spp", "StatArea"])
    return j.groupBy("spp", "RAM_stockid", "year", "lat").agg(skip_sum("SPPLIVMT").alias("tl_mt")).withColumn(
        "source", F.lit("catch_dat")
    )


def combine_landings(estimated: DataFrame, area: DataFrame) -> DataFrame:
    est = estimated.groupBy("spp", "RAM_stockid", "year", "lat").agg(skip_sum("tl_mt_est").alias("tl_mt")).withColumn(
        "source", F.lit("noaa_ann")
    )
    return stack(est, area)


def landings_by_bin(total: DataFrame, lo=30, hi=46, keys=("RAM_stockid", "spp", "year")) -> DataFrame:
    return total.withColumn("lat_bin", bin_mid("lat", lo, hi)).groupBy(*keys, "lat_bin").agg(
        skip_sum("tl_mt").alias("tl_mt")
    )


def landings_centroid(total: DataFrame, first_year=1968, source="catch_dat") -> DataFrame:
    """Yearly landings-weighted latitude, overall and for one source."""
    return total.where(F.col("year") >= first_year).groupBy("spp", "RAM_stockid", "year").agg(
        weighted_mean("lat", "tl_mt").alias("cent_lat"),
        weighted_mean("lat", "tl_mt", F.col("source") == source).alias("cent_lat_cd"),
        strict_sum("tl_mt").alias("total_land_mt"),
    )


def long_series(binned: DataFrame, by_year: int) -> DataFrame:
    """Rows of stocks whose series starts by ``by_year``."""
    span = having(
        binned, ["spp", "RAM_stockid"], F.col("min_yr") <= by_year, min_yr=F.min("year"), max_yr=F.max("year")
    )
    return keep_in(binned, span, "RAM_stockid")


def unmapped_share(tickets: DataFrame, areas: DataFrame, area_col="ADFG_I_STAT_AREA", by=("spp", "AKFIN_YEAR"), qty="WHOLE_LBS") -> DataFrame:
    """Landings in all areas and in areas missing from the map, per group.

    Both sums start from (group, area) cells, so the area test meets few rows.
    """
    cells = tickets.groupBy(*by, area_col).agg(
        F.sum(qty).alias("s"), F.count(qty).alias("n"), F.count(F.lit(1)).alias("m")
    )
    out = drop_in(cells, areas, area_col, "STAT_AREA").select(*by, area_col).withColumn("__out", F.lit(True))
    j = merge(cells, out, by=[*by, area_col], how="left")
    miss = F.coalesce(F.col("__out"), F.lit(False))
    outside_known = F.sum(F.when(miss, F.col("m") - F.col("n")).otherwise(0)) == 0
    g = j.groupBy(*by).agg(
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("land_all"),
        F.when(outside_known, F.coalesce(F.sum(F.when(miss, F.col("s"))), F.lit(0.0))).alias("land_nonstat"),
    )
    return g.withColumn("frac_nonstat", F.try_divide(F.col("land_nonstat"), F.col("land_all")))


def mostly_unmapped_species(shares: DataFrame, frac=0.5, min_years=20) -> DataFrame:
    return having(
        shares.where(F.col("frac_nonstat") > frac), "spp", F.col("num_years") > min_years, num_years=n_unique("AKFIN_YEAR")
    )


