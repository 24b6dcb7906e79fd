"""Survey hauls and catches: zero-filling, strata, stock summaries, biomass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import round_to
from ..functions.missing import _c, fill, floor_zero, n_unique, sentinel_to_null
from ..functions.text import capitalize
from .panel import share
from .relational import _names, grid, having, keep_in, merge, with_lists

# -- fixed values: survey programme -> assessment sub-area --------------------
REGION_SUBAREA = {
    "AFSC_EBS": "EBS",
    "AFSC_Aleutians": "AI",
    "AFSC_GOA": "GOA",
    "AFSC_WCTri": "US West Coast",
    "NEFSC_NEUS": "US East Coast",
    "NWFSC_WCAnn": "US West Coast",
    "SEFSC_GOMex": "GMex",
    "SCDNR_SEUS": "SEUS",
    "DFO_Newfoundland": "Canada East Coast",
    "DFO_SoGulf": "Canada East Coast",
    "DFO_ScotianShelf": "Canada East Coast",
}
# -- fixed values: months of a season, swept area of one tow in km2 -----------
SEASON_MONTHS = {"fall": (9, 10, 11), "spring": (3, 4, 5)}
TOW_KM2_AREA = 0.0343
TOW_KM2_DENSITY = 0.0384


def lookup(x, table: dict, default: Column | None = None) -> Column:
    """Literal table as a CASE chain; unlisted and NULL give ``default``."""
    out = None
    for k, v in table.items():
        cond, val = _c(x) == k, F.lit(v)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out if default is None else out.otherwise(default)


def region_subarea(region) -> Column:
    return lookup(region, REGION_SUBAREA)


def season(month) -> Column:
    m = _c(month)
    return F.when(m.isin(*SEASON_MONTHS["fall"]), "fall").when(m.isin(*SEASON_MONTHS["spring"]), "spring")


def parse_species_key(df: DataFrame, key="sppocean") -> DataFrame:
    """'genus species_Ocean' into ``spp`` (capitalised) and ``ocean``."""
    parts = F.split(F.col(key), "_")
    return df.withColumns({"spp": capitalize(F.get(parts, F.lit(0))), "ocean": F.get(parts, F.lit(1))})


def persistent_species(catch: DataFrame, min_years: int, spp="spp", year="year") -> DataFrame:
    """Species seen in at least ``min_years`` distinct years."""
    return having(catch, spp, F.col("num_yrs") >= min_years, num_yrs=n_unique(year))


def stratum_coverage(hauls: DataFrame, extra=()) -> DataFrame:
    """Share of a survey's years in which each stratum was visited."""
    key = ["regionfact", *extra, "ocean", "surveyfact"]
    seen = hauls.groupBy("stratum", *key).agg(n_unique("year").alias("num_yrs_obs"))
    total = hauls.groupBy(*key).agg(n_unique("year").alias("num_yrs_surv"))
    out = merge(seen, total, by=key)
    return out.withColumn("frac_yrs", F.try_divide(F.col("num_yrs_obs").cast("double"), F.col("num_yrs_surv")))


def consistent_strata(hauls: DataFrame, frac=0.9, min_year: int | None = None, by_region=False, extra=()) -> DataFrame:
    """Hauls in strata visited in at least ``frac`` of a survey's years.  The
    stratum alone decides, whatever its region, unless ``by_region``."""
    keep = stratum_coverage(hauls, extra).where(F.col("frac_yrs") >= frac)
    out = keep_in(hauls, keep, ["stratum", "regionfact"] if by_region else "stratum")
    return out if min_year is None else out.where(F.col("year") >= min_year)


# -- zero filling ------------------------------------------------------------

def _recode(df: DataFrame, measures) -> DataFrame:
    """Missing to 0, then the sentinel to NULL, then a floored log."""
    for m in measures:
        df = df.withColumn(m, sentinel_to_null(fill(m, 0.0)))
        df = df.withColumn(f"{m}na", floor_zero(m))
        df = df.withColumn(f"{m}nal", F.ln(f"{m}na"))
    return df


def zero_fill(catch: DataFrame, hauls: DataFrame, measures=("wtcpue",), within=(), spp="spp", recode: bool = True) -> DataFrame:
    """Every haul with every species; absences get zero catch.

    Catches are gathered per haul once and meet the hauls in one equi-join; the
    haul's own rows and its absent species, taken from the species list, are
    then exploded in place, so the haul-by-species product is never shuffled.
    ``within`` limits a species to hauls of the groups in which it occurs.
    """
    catch = catch.where(F.col(spp).isNotNull())
    shared = [c for c in catch.columns if c in hauls.columns]
    own = [c for c in catch.columns if c not in shared]
    nulls = "drop" if shared == ["haulid"] else "match"
    caught = catch.groupBy(*shared).agg(F.collect_list(F.struct(*own)).alias("__caught"))
    values = merge(catch.select("haulid", spp), hauls.select("haulid", *within), by="haulid", nulls="drop") if within else catch
    todo = with_lists(merge(hauls, caught, by=shared, how="left", nulls=nulls), values, spp, within)
    kind = caught.schema["__caught"].dataType.elementType
    empty = F.array().cast(caught.schema["__caught"].dataType)
    mine = F.coalesce("__caught", empty)

    def row(values, here):
        return F.struct(*[values(f).cast(f.dataType).alias(f.name) for f in kind.fields], F.lit(here).alias("pres2"))

    present = F.when(F.col("__chunk") == 0, F.transform(mine, lambda r: row(lambda f: r[f.name], True)))
    species = F.transform(mine, lambda r: r[spp])
    absent = F.transform(F.array_except("__values", species), lambda s: row(lambda f: s if f.name == spp else F.lit(None), False))
    rows = F.concat(F.coalesce(present, F.filter(absent, lambda r: F.lit(False))), absent)
    out = todo.select(*hauls.columns, F.explode(rows).alias("__row")).select(*hauls.columns, *[F.col(f"__row.`{c}`").alias(c) for c in [*own, "pres2"]])
    return _recode(out, measures) if recode else out


def zero_fill_summary(catch: DataFrame, hauls: DataFrame, group, measure="wtcpue", strict=(), skip=(), spp="spp") -> DataFrame:
    """Group means over the zero-filled table without building it.

    Hauls and catches are aggregated apart; absences enter as (hauls - caught).
    (haulid, species) must be unique in ``catch``.
    """
    group = _names(group)
    catch = catch.where(F.col(spp).isNotNull())
    h = _haul_sums(hauls, group, strict, skip)
    c = _catch_sums(catch, hauls, group, measure, spp)
    cells = grid(h, catch, spp)
    return _means(merge(cells, c, by=group + [spp], how="left"), group + [spp], measure, strict, skip)


def stock_summary(catch: DataFrame, hauls: DataFrame, stock_map: DataFrame, group, measure="wtcpue", strict=(), skip=()) -> DataFrame:
    """As ``zero_fill_summary`` per stock: hauls carry their ``StatArea``, and a
    stock owns the hauls of its areas.

    Hauls and catches shrink to (group, area) cells before they meet the stocks.
    """
    group = _names(group)
    cell = list(dict.fromkeys([*group, "StatArea"]))
    catch = catch.where(F.col("spp").isNotNull())
    stocks = stock_map.select("RAM_stockid", "spp", "StatArea").distinct()
    stocks = keep_in(stocks, catch.select("spp"), "spp")
    key = ["RAM_stockid", "spp", *group]
    hs = merge(stocks, _haul_sums(hauls, cell, strict, skip), by="StatArea", nulls="drop")
    cs = merge(stocks, _catch_sums(catch, hauls, cell, measure, "spp"), by=["StatArea", "spp"], nulls="drop")
    hs = hs.groupBy(*key).agg(*[F.sum(c).alias(c) for c in hs.columns if c.startswith("__")])
    cs = cs.groupBy(*key).agg(*[F.sum(c).alias(c) for c in cs.columns if c.startswith("__")])
    return _means(merge(hs, cs, by=key, how="left"), key, measure, strict, skip)


def _haul_sums(hauls, group, strict, skip):
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in [*strict, *skip]:
        aggs += [F.sum(c).alias(f"__s_{c}"), F.count(c).alias(f"__c_{c}")]
    return hauls.groupBy(*group).agg(*aggs)


def _catch_sums(catch, hauls, group, measure, spp):
    cells = hauls.select("haulid", *[c for c in group if c != "haulid"])
    rows = merge(catch.select("haulid", spp, measure), cells, by="haulid", nulls="drop")
    rows = _recode(rows, [measure])
    return rows.groupBy(*group, spp).agg(
        F.count(F.lit(1)).alias("__pos"), F.sum(measure).alias("__w"), F.count(measure).alias("__wn"),
        F.sum(f"{measure}nal").alias("__l"),
    )


def _means(df, key, measure, strict, skip):
    n = F.col("__n").cast("double")
    pos, wn = (F.coalesce(F.col(c), F.lit(0)) for c in ("__pos", "__wn"))
    known = pos == wn  # no sentinel among the caught
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    cols = [
        (pos / n).alias("pres2"),
        F.when(known, zero("__w") / n).alias(measure),
        F.try_divide(zero("__w"), F.nullif(n - pos + wn, F.lit(0.0))).alias(f"{measure}_skip"),
        F.when(known, (zero("__l") + (n - pos) * F.ln(F.lit(1e-4))) / n).alias(f"{measure}nal"),
    ]
    for c in strict:
        cols.append(F.when(F.col(f"__c_{c}") == F.col("__n"), F.col(f"__s_{c}") / n).alias(c))
    for c in skip:
        cols.append(F.try_divide(F.col(f"__s_{c}"), F.col(f"__c_{c}").cast("double")).alias(c))
    return df.select(*key, *cols, F.col("__n").alias("num_hauls"))


def zero_fill_full(catch: DataFrame, hauls: DataFrame, measures=("wtcpue", "cntcpue")) -> DataFrame:
    """Zero-fill of weight and count, the species' mean for its year and season,
    and the 0.1 degree cell of the haul."""
    rows = zero_fill(catch, hauls, measures)
    means = zero_fill_summary(catch, hauls, ["year", "season"]).select(
        "spp", "year", "season", F.col("wtcpue_skip").alias("mean_wtcpue")
    )
    out = merge(rows, means, by=["spp", "year", "season"])
    return out.withColumns({"lon_1": round_to("lon", 0.1), "lat_1": round_to("lat", 0.1)})


def zero_fill_regional(catch: DataFrame, hauls: DataFrame) -> DataFrame:
    """Species meet only the hauls of regions where they occur.

    Absences are 0 in weight, -10 in log weight and FALSE in presence.  A catch
    of unknown weight (the sentinel or NULL) stays a presence with NULL weights.
    """
    out = zero_fill(catch, hauls, (), within=("regionfact",), spp="sppocean", recode=False)
    absent = ~F.col("pres2")
    weight = sentinel_to_null("wtcpue")
    return out.withColumns({
        "spp": capitalize(F.substring_index("sppocean", "_", 1)),
        "wtcpue": F.when(absent, 0.0).otherwise(weight),
        "logwtcpue": F.when(absent, -10.0).when(weight.isNotNull(), F.col("logwtcpue")),
        "presfit": F.when(absent, False).otherwise(fill("presfit", True)),
    }).drop("pres2")


# -- biomass -----------------------------------------------------------------

def swept_area_biomass(area_means: DataFrame, tow_km2=TOW_KM2_AREA) -> DataFrame:
    """Biomass (t) of each area from its mean catch, and its share of the stock-year."""
    df = area_means.withColumn(
        "swept_bio_mt", F.col("wtcpue") * (F.col("area") / F.lit(tow_km2)) * F.lit(0.001)
    )
    return share(df, ["RAM_stockid", "spp", "year"], "swept_bio_mt", "total_swept_bio_mt", "frac_swept_bio", small=True)


def density_biomass(wtcpue, area_km2, tow_km2=TOW_KM2_DENSITY) -> dict[str, Column]:
    """Mean catch as kg per km2 and as tonnes in the whole area."""
    kg = _c(wtcpue) / F.lit(tow_km2)
    return {"kg_km2": kg, "bio_mt": _c(area_km2) * kg / F.lit(1000.0)}


def absolute_biomass(areas: DataFrame, assess: DataFrame) -> DataFrame:
    """Assessed total (else spawning) biomass spread by the swept-area share."""
    ts = assess.select("stockid", "year", "TB", "SSB")
    j = merge(areas, ts, by_x=["RAM_stockid", "year"], by_y=["stockid", "year"])
    frac = F.col("frac_swept_bio")
    return j.withColumn("abs_bio", F.when(F.col("TB").isNotNull(), F.col("TB") * frac).otherwise(F.col("SSB") * frac))


# -- panel -------------------------------------------------------------------

def survey_landings_panel(survey: DataFrame, landings: DataFrame, by, qty: str, out="land_mt") -> DataFrame:
    """Survey cells with their landings; cells without a record get 0."""
    j = merge(survey, landings, by=by, how="left")
    return j.withColumn(out, fill(qty, 0.0))


def percap_growth(df: DataFrame, by, order: str, bio="bio_mt", land="land_mt", temps=("SBT", "SST"), slab=None) -> DataFrame:
    """Next year's biomass and temperatures, per-head growth and its log, and
    the log of landings over biomass; rows with positive biomass."""
    from .panel import row_shift

    names = {"bio_next": bio} | {f"{t}_next": t for t in temps}
    out = row_shift(df, by, order, names, -1, slab)
    out = out.withColumn("bio_diff", F.col("bio_next") - F.col(bio))
    out = out.withColumns({f"{t}_diff": F.col(f"{t}_next") - F.col(t) for t in temps})
    out = out.withColumn("percap_diff", F.try_divide(F.col("bio_diff"), F.col(bio)))
    out = out.withColumn("percap_log", F.ln(F.col("percap_diff") + F.lit(1.0001)))
    out = out.withColumn("land_pos", floor_zero(land, 1e-4))
    out = out.withColumn("logLB", F.ln(F.try_divide(F.col("land_pos"), F.col(bio))))
    return out.where(F.col(bio) > 0)
