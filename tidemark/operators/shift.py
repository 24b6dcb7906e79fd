"""Centroids, their observed and predicted shifts, and bias."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.missing import (
    finite, floor_zero, frequency, ifelse, log_ratio, n_unique_where, skip_mean, strict_mean, weighted_mean,
)
from ..functions.tails import t_two_sided
from .panel import row_shift
from .relational import _names, merge


def observed_centroid(rows: DataFrame, by) -> DataFrame:
    return rows.groupBy(*by).agg(
        weighted_mean("lat", "wtcpue").alias("lat_cent"), weighted_mean("lat", "presfit").alias("lat_cent_pres")
    )


def predicted_centroid(rows: DataFrame, by, sbt="SBT_seasonal", sst="SST_seasonal_mean") -> DataFrame:
    return rows.groupBy(*by).agg(
        weighted_mean("lat", "pred_total").alias("lat_cent_cm"), weighted_mean("lat", "pred_pres").alias("lat_cent_pres_cm"),
        skip_mean(sbt).alias("sbt"), skip_mean(sst).alias("sst"),
    )


def distribution_summary(pred: DataFrame, by=("spp", "sppocean", "subarea", "year")) -> DataFrame:
    """Observed and predicted positions, mean environment and occurrence over
    rows with a complete position."""
    d = pred.dropna(subset=["lat", "lon", "depth"])
    weights = {"obs": "wtcpue", "pres": "pred_pres", "bio": "pred_total"}
    names = {
        "obs": ("obs_lat", "obs_lon", "obs_depth"),
        "pres": ("pred_lat_pres", "pred_lon_pres", "pred_depth_pres"),
        "bio": ("pred_lat_bio", "pred_lon_bio", "pred_depth"),
    }
    aggs = [
        weighted_mean(v, weights[k]).alias(n) for k, ns in names.items() for v, n in zip(("lat", "lon", "depth"), ns)
    ]
    env = {"SBT_seasonal": "SBT_seasonal", "SST_seasonal": "SST_seasonal_mean", "SBT_min": "SBT_min",
           "SST_min": "SST_min", "SBT_max": "SBT_max", "SST_max": "SST_max", "wtcpue": "wtcpue"}
    aggs += [strict_mean(c).alias(n) for n, c in env.items()]
    return d.groupBy(*by).agg(*aggs, frequency("presfit").alias("freq_occ"))


def annual_shift(cent: DataFrame, by, order="year", slab: Column | None = None) -> DataFrame:
    """Move to the next observed year, observed and predicted, and the bias
    signed by the predicted direction."""
    by = _names(by)
    out = row_shift(cent, by, order, {"lead_obs": "obs_lat", "lead_pred": "pred_lat_bio"}, -1, slab)
    out = out.withColumns({
        "lat_cent_diff": F.col("lead_obs") - F.col("obs_lat"),
        "lat_cent_cm_diff": F.col("lead_pred") - F.col("pred_lat_bio"),
    }).drop("lead_obs", "lead_pred")
    out = out.withColumn("annual_obsminuspred", F.col("lat_cent_diff") - F.col("lat_cent_cm_diff"))
    out = out.withColumn("sign_pred", F.signum("lat_cent_cm_diff"))
    out = out.withColumn("annual_bias", F.col("annual_obsminuspred") * F.col("sign_pred"))
    years = cent.groupBy(*by).agg(n_unique_where(finite("obs_lat"), order).alias("nyrs_obs"))
    return merge(out, years, by=by, how="left")


@F.pandas_udf(DoubleType())
def _p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float, na_value=float("nan")), dof.to_numpy(float, na_value=0.0)))


def simple_fit(y: str, x: str) -> dict[str, Column]:
    """Aggregates of a straight-line fit over complete pairs: slope, t, dof, r2."""
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    yy, xx = F.when(ok, F.col(y).cast("double")), F.when(ok, F.col(x).cast("double"))
    n = F.count(yy)
    sxx, syy, sxy = F.var_pop(xx) * n, F.var_pop(yy) * n, F.covar_pop(yy, xx) * n
    slope = F.try_divide(sxy, sxx)
    dof = (n - 2).cast("double")
    resid = syy - slope * sxy
    se = F.sqrt(F.try_divide(F.try_divide(F.greatest(resid, F.lit(0.0)), dof), sxx))
    return {"slope": slope, "t": F.try_divide(slope, se), "dof": dof, "r2": F.try_divide(slope * sxy, syy)}


def trends(cent: DataFrame, by, more_than=5, obs="obs_lat", pred="pred_lat_bio", x="year") -> DataFrame:
    """Slope, p and R2 of observed and predicted positions over the years, and
    the observed slope in excess of the predicted, in its direction."""
    by = _names(by)
    fits = {p: simple_fit(y, x) for p, y in (("obs", obs), ("pred", pred))}
    aggs = [v.alias(f"__{p}_{k}") for p, f in fits.items() for k, v in f.items()]
    d = cent.where(F.col("nyrs_obs") > more_than).groupBy(*by, "nyrs_obs").agg(*aggs)
    cols = []
    for p in fits:
        cols += [
            F.col(f"__{p}_slope").alias(f"lm_{p}_slope"),
            F.nanvl(_p_value(f"__{p}_t", f"__{p}_dof"), F.lit(None).cast("double")).alias(f"lm_{p}_p"),
            F.col(f"__{p}_r2").alias(f"lm_{p}_r2"),
        ]
    d = d.select(*by, "nyrs_obs", *cols)
    gap = F.col("lm_obs_slope") - F.col("lm_pred_slope")
    return d.withColumn("obsminuspred", ifelse(F.col("lm_pred_slope") > 0, gap, -gap))


def landings_around_centroid(land: DataFrame, cent: DataFrame, on=("year", "spp"), keep=()) -> DataFrame:
    """Landings north and south of the yearly centroid, their log ratio, and
    that ratio signed by the predicted direction ("leading edge")."""
    j = merge(land, cent.select(*on, "obs_lat", "sign_pred", *keep), by=list(on))
    north = F.col("lat_bin") >= F.col("obs_lat")
    d = j.groupBy("spp", "year", "obs_lat", "sign_pred", *keep).agg(
        F.coalesce(F.sum(F.when(north, F.col("tl_mt"))), F.lit(0.0)).alias("landN"),
        F.coalesce(F.sum(F.when(~north, F.col("tl_mt"))), F.lit(0.0)).alias("landS"),
    )
    d = d.withColumn("log_landNS", log_ratio(floor_zero("landN", 1e-5), floor_zero("landS", 1e-5)))
    return d.withColumn("log_landedge", F.col("log_landNS") * F.col("sign_pred"))


def score_two_stage(rows: DataFrame, model: DataFrame, terms, spp="sppocean") -> DataFrame:
    """Occurrence probability, log biomass and their product for every row.

    ``model`` has one row per species: an intercept and a coefficient per term
    for both stages (``p_*`` and ``b_*``), and the regions it was fitted on.
    Rows of other regions get no score and drop out.
    """
    j = merge(rows, model, by=spp)
    j = j.where(F.col("fit_regions").isNull() | F.array_contains("fit_regions", F.col("regionfact")))
    eta = {s: F.col(f"{s}_0") + sum((F.col(f"{s}_{t}") * F.col(t) for t in terms), F.lit(0.0)) for s in ("p", "b")}
    out = j.withColumns({
        "pred_pres": F.lit(1.0) / (F.lit(1.0) + F.exp(-eta["p"])), "pred_log_bio": eta["b"],
    })
    out = out.withColumn("pred_total", F.col("pred_pres") * F.exp("pred_log_bio"))
    return out.select(*rows.columns, "pred_pres", "pred_log_bio", "pred_total")
