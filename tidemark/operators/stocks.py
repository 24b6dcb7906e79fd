"""Assessment series: coverage, sub-areas, species-level fishing intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import _c, any_present, finite, min_where, n_unique, n_unique_where, skip_sum
from ..functions.text import before
from .panel import with_n_unique
from .relational import keep_in, merge
from .survey import lookup

# -- fixed values: assessment area code -> sub-area; survey years by region ---
AREA_SUBAREA = {
    "BS": "EBS", "AI": "AI", "GA": "GOA", "EBSAI": "EBS", "EBS": "EBS", "EBSAIGA": "EBS", "BSAI": "EBS",
    "SATLC": "SEUS", "SATL": "SEUS", "ATL": "SEUS", "GM": "GMex",
}
CODED_REGIONS = ("US Alaska", "US Southeast and Gulf")
SURVEY_YEARS = [
    ("US East Coast", 1968, 2016), ("US Alaska", 1981, 2016), ("US West Coast", 1981, 2016),
    ("US Southeast and Gulf", 1981, 2016), ("Canada East Coast", 1971, 2016),
]


def survey_years(spark) -> DataFrame:
    return spark.createDataFrame(SURVEY_YEARS, "region string, min_survyr int, max_survyr int")


def stock_subarea(areaid, region) -> Column:
    """Sub-area from the area code in two regions, else the region itself."""
    region = _c(region)
    code = F.regexp_replace(_c(areaid), "USA-NMFS-", "")
    # a NULL code can only come from the other regions or a NULL area
    return F.when(region.isin(*CODED_REGIONS) & code.isNotNull(), lookup(code, AREA_SUBAREA)).otherwise(region)


def north_american_stocks(stock: DataFrame) -> DataFrame:
    out = stock.withColumn("area", before("areaid", "-")).where(F.col("area").isin("USA", "Canada"))
    return out.withColumn("subarea", stock_subarea("areaid", "region"))


def with_survey_window(series: DataFrame, stock: DataFrame, years: DataFrame) -> DataFrame:
    s = stock.where(F.col("subarea").isNotNull())
    return merge(merge(series, s, by="stockid"), years, by="region")


MEASURES = {"U": "UdivUmsypref", "ER": "ER", "F": "F"}


def stock_fractions(df: DataFrame) -> DataFrame:
    """Each stock's share of its species' biomass and any-value flags.

    Biomass totals go by (species, region, year) while the stock count goes by
    (species, sub-area, region).  One row per stock and year, so every group is
    a handful of rows and windows suit.
    """
    df = with_n_unique(df, ["scientificname", "subarea", "region"], "stockid", "num_stocks", small=True)
    together = Window.partitionBy("scientificname", "region", "year")
    many = F.col("num_stocks") > 1
    df = df.withColumns({
        f"{b}_spp": F.when(many, F.coalesce(F.sum(b).over(together), F.lit(0.0))).otherwise(F.col(b)) for b in ("TB", "SSB")
    })
    tb, ssb = F.col("TB_spp"), F.col("SSB_spp")
    # three-valued as the nested conditional is: an unknown test stays unknown
    both_zero = (tb == 0) & (ssb == 0)
    only_ssb = (tb == 0) & (ssb > 0)
    df = df.withColumns({
        "Bio": F.coalesce("TB", "SSB"),
        "Bio_spp": F.when(both_zero, F.lit(None)).when(~both_zero, F.when(only_ssb, ssb).when(~only_ssb, tb)),
    })
    df = df.withColumn("frac_stock", F.try_divide(F.col("Bio"), F.col("Bio_spp")))
    seen = Window.partitionBy("scientificname", "subarea", "year")
    return df.withColumns({f"{m}_any": any_present(c).over(seen) for m, c in MEASURES.items()})


def species_intensity(df: DataFrame) -> DataFrame:
    """Biomass-weighted intensity over the stocks of a species; the value itself
    for a single stock, NULL where no stock reports the measure."""
    rows = df.where((F.col("year") >= F.col("min_survyr")) & F.col("frac_stock").isNotNull())
    key = ["scientificname", "subarea", "region", "year", "min_survyr", "num_stocks", "U_any", "F_any", "ER_any"]
    many = F.col("num_stocks") > 1
    aggs = []
    for m, c in MEASURES.items():
        some = F.col(f"{m}_any") == 1
        aggs.append(
            F.when(many & some, skip_sum(F.col(c) * F.col("frac_stock"))).when(many, F.lit(None)).otherwise(F.max(c))
            .alias(f"{m}_spp")
        )
    out = rows.groupBy(*key).agg(*aggs)
    u = F.col("U_spp")
    return out.withColumn("overage", F.when(finite(u) & (u > 1), 1.0).when(finite(u) & (u <= 1), 0.0))


def species_overage(intensity: DataFrame) -> DataFrame:
    """Years assessed, mean intensity and years over, by species and sub-area."""
    u_known = F.col("U_any") == 1
    over = F.when(u_known, F.col("overage"))
    out = intensity.groupBy("subarea", "region", "scientificname", "num_stocks").agg(
        n_unique_where(finite("U_spp"), "year").alias("num_yrs"),
        F.avg("U_spp").alias("meanU"), F.avg("ER_spp").alias("meanER"), F.avg("F_spp").alias("meanF"),
        F.when(
            F.sum((u_known & F.col("overage").isNull()).cast("int")) == 0, F.coalesce(F.sum(over), F.lit(0.0))
        ).alias("num_yrs_overage"),
    )
    n = F.col("num_yrs_overage")
    none = (n == 0) & (F.col("num_yrs") == 0)
    out = out.withColumn("num_yrs_overage", F.when(none, F.lit(None)).when(~none, n))
    return out.withColumn(
        "frac_yrs_overage", F.try_divide(F.col("num_yrs_overage"), F.col("num_yrs").cast("double"))
    )


def coverage_profile(series: DataFrame, by) -> DataFrame:
    """Years with each measure, and the span of the series."""
    named = {"TB": "TB", "SSB": "SSB", "C": "Ctouse", "U": "Utouse", "ER": "ER"}
    return series.groupBy(*by).agg(
        *[n_unique_where(F.col(c).isNotNull(), "year").alias(f"yrs_{n}") for n, c in named.items()],
        F.min("year").alias("min_yr"), F.max("year").alias("max_yr"),
        min_where(F.col("TB").isNotNull(), "year").alias("min_yr_TB"),
        min_where(F.col("SSB").isNotNull(), "year").alias("min_yr_SSB"),
    )


def without_biomass(profile: DataFrame, regions) -> DataFrame:
    return profile.where(F.col("region").isin(*regions) & (F.col("yrs_TB") == 0) & (F.col("yrs_SSB") == 0))


def series_of(series: DataFrame, profile: DataFrame) -> DataFrame:
    return keep_in(series, profile, "stockid")


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def stocks_per_area(area_means: DataFrame, **lists) -> DataFrame:
    """Per statistical area: its stocks, whether any of them was ever caught there, and for each list of areas
    whether it names the area and something was caught there."""
    present = F.max(F.coalesce(F.col("pres2") > 0, F.lit(False)))
    d = area_means.groupBy("StatArea").agg(n_unique("RAM_stockid").alias("num_stocks"), present.alias("present"))
    return d.withColumns({name: F.col("StatArea").isin(*areas) & F.col("present") for name, areas in lists.items()})
