"""Weighted Gaussian densities on a fixed grid.

Weights are first summed into at most ``n`` grid cells per group by linear
binning - a plain aggregation - so the smoothing works on ``n`` numbers per
group however many rows the group had.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import finite
from .panel import share
from .relational import merge


def _binned(rows: DataFrame, by, x: str, w: str, lo: float, step: float, n: int) -> DataFrame:
    """Mass per cell; what falls off the grid is kept under a NULL cell."""
    pos = (F.col(x) - F.lit(lo)) / F.lit(step)
    left = F.floor(pos).cast("int")
    right = pos - F.floor(pos)
    parts = F.array(
        F.struct(left.alias("cell"), (F.col(w) * (F.lit(1.0) - right)).alias("mass")),
        F.struct((left + 1).alias("cell"), (F.col(w) * right).alias("mass")),
    )
    d = rows.select(*by, F.explode(parts).alias("p")).select(*by, "p.cell", "p.mass")
    d = d.withColumn("cell", F.when(F.col("cell").between(0, n - 1), F.col("cell")))
    return d.groupBy(*by, "cell").agg(F.sum("mass").alias("mass"))


def kernel_density(df: DataFrame, by, x: str, w: str, lo: float, hi: float, bw: float, n: int = 512) -> DataFrame:
    """``n`` rows per group: ``at`` and its density, weights scaled to sum 1.

    Mass is binned on ``n`` cells reaching four bandwidths past both ends and
    smoothed at ``n`` points from ``lo`` to ``hi``.  Rows without a finite
    weight do not count.
    """
    by = [by] if isinstance(by, str) else list(by)
    rows = df.where(finite(w) & finite(x)).select(*by, x, w)
    start, step = lo - 4 * bw, (hi - lo + 8 * bw) / (n - 1)
    cells = _binned(rows, by, x, w, start, step, n)
    # at most n cells a group, so the list is bounded
    on_grid = F.when(F.col("cell").isNotNull(), F.struct("cell", "mass"))
    mass = cells.groupBy(*by).agg(F.sort_array(F.collect_list(on_grid)).alias("c"), F.sum("mass").alias("total"))
    at = np.linspace(lo, hi, n)
    centres = start + step * np.arange(n)
    kernel = np.exp(-0.5 * ((at[:, None] - centres[None, :]) / bw) ** 2) / (bw * np.sqrt(2 * np.pi))

    @F.pandas_udf("array<double>")
    def smooth(cell: pd.Series, m: pd.Series, total: pd.Series) -> pd.Series:
        dense = np.zeros((len(cell), n))
        for i, (c, v) in enumerate(zip(cell, m)):
            dense[i, np.asarray(c, int)] = v
        dens = (dense / total.to_numpy(float)[:, None]) @ kernel.T
        return pd.Series(list(dens))

    out = mass.withColumn("d", smooth(F.transform("c", lambda s: s["cell"]), F.transform("c", lambda s: s["mass"]), "total"))
    out = out.select(*by, F.posexplode("d").alias("i", "dens"))
    return out.withColumn("at", F.lit(lo) + F.col("i") * F.lit((hi - lo) / (n - 1))).select(*by, "i", "at", "dens")


def landings_density(trips: DataFrame, by, bw=0.5, lat=(30.5, 47.5), lon=(-76.0, -65.0)) -> DataFrame:
    """Landings density over latitude and over longitude, side by side."""
    a = kernel_density(trips, by, "declat", "qtykept", *lat, bw).withColumnsRenamed({"at": "lat", "dens": "dens_qty"})
    b = kernel_density(trips, by, "declon", "qtykept", *lon, bw).withColumnsRenamed({"at": "lon", "dens": "lon_dens_qty"})
    return merge(a, b, by=[*by, "i"])


def normalise(density: DataFrame, by, dens="dens_qty") -> DataFrame:
    """Scale the grid values of each group to sum 1."""
    return share(density, by, dens, "total_dens", "norm_dens", small=True)
