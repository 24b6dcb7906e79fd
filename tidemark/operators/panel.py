"""Group totals, standardisation and lags.

Group statistics are aggregated and joined back instead of computed in a
window: aggregation combines on the map side, and the joined table has one row
per group, so a hot group is never sorted in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import ifelse, n_unique, root, skip_sum, strict_sum, weighted_mean, weighted_var
from .relational import _names, merge


def with_stats(df: DataFrame, by, **aggs: Column) -> DataFrame:
    """Attach aggregates of each row's group to the row."""
    by = _names(by)
    stats = df.groupBy(*by).agg(*[v.alias(k) for k, v in aggs.items()])
    return merge(df, stats, by=by, how="left").select(*df.columns, *aggs)


def share(df: DataFrame, by, x: str, total: str, frac: str, strict: bool = True, small: bool = False) -> DataFrame:
    """Group total of ``x`` on every row, and each row's share of it.

    ``small`` says ``df`` is itself an aggregate with few rows per group: then a
    window is cheaper than computing ``df`` a second time.
    """
    by = _names(by)
    if small:
        w = Window.partitionBy(*by)
        t = F.sum(x).over(w)
        known = F.count(F.lit(1)).over(w) == F.count(x).over(w)
        out = df.withColumn(total, F.when(known, t) if strict else F.coalesce(t, F.lit(0.0)))
    else:
        out = with_stats(df, by, **{total: strict_sum(x) if strict else skip_sum(x)})
    return out.withColumn(frac, F.try_divide(F.col(x), F.col(total)))


def with_n_unique(df: DataFrame, by, x, name: str, small: bool = False) -> DataFrame:
    """Distinct count of the group, NULL counted, on every row."""
    if not small:
        return with_stats(df, by, **{name: n_unique(x)})
    w = Window.partitionBy(*_names(by))
    return df.withColumn(name, F.size(F.collect_set(x).over(w)) + F.max(F.col(x).isNull().cast("int")).over(w))


def standardise(df: DataFrame, by, x: str, name: str, mean="__m", sd="__s") -> DataFrame:
    """(x - mean) / sd within the group; 0 where the group mean is 0."""
    out = with_stats(df, by, **{mean: F.avg(x), sd: F.stddev_samp(x)})
    z = F.try_divide(F.col(x) - F.col(mean), F.col(sd))
    out = out.withColumn(name, ifelse(F.col(mean) == 0, F.lit(0.0), z))
    return out.drop(*[c for c in (mean, sd) if c.startswith("__")])


def niche(df: DataFrame, by, vars_: dict[str, str], weights: dict[str, str]) -> DataFrame:
    """Weighted mean and sd of each variable under each weight, on every row.

    ``vars_`` maps a label to its column, likewise ``weights``; results are
    named ``mean_<label><weight>`` and ``sd_<label><weight>``.
    """
    centred = with_stats(df, by, **{f"__c_{vl}": F.avg(v) for vl, v in vars_.items()})
    aggs = {}
    for wl, w in weights.items():
        for vl, v in vars_.items():
            aggs[f"mean_{vl}{wl}"] = weighted_mean(v, w)
            aggs[f"sd_{vl}{wl}"] = root(weighted_var(F.col(v) - F.col(f"__c_{vl}"), w))
    return with_stats(centred, by, **aggs).drop(*[f"__c_{vl}" for vl in vars_])


def weighted_variance(df: DataFrame, by, x: str, w: str, name: str = "var") -> DataFrame:
    """Weighted variance of each group about the group's mean, in two passes: stable however large the mean is."""
    by = _names(by)
    centred = with_stats(df, by, __c=F.avg(x))
    return centred.groupBy(*by).agg(weighted_var(F.col(x) - F.col("__c"), w).alias(name))


def demean(df: DataFrame, by, cols, prefix="fe_", mean_of: dict[str, str] | None = None) -> DataFrame:
    """Subtract group means.  ``mean_of`` names another column whose mean is
    subtracted (a lagged column less the mean of the unlagged one)."""
    mean_of = mean_of or {}
    cols = _names(cols)
    out = with_stats(df, by, **{f"__m_{c}": F.avg(mean_of.get(c, c)) for c in cols})
    out = out.withColumns({f"{prefix}{c}": F.col(c) - F.col(f"__m_{c}") for c in cols})
    return out.drop(*[f"__m_{c}" for c in cols])


def row_shift(df: DataFrame, by, order: str, cols: dict, n: int = 1, slab: Column | None = None) -> DataFrame:
    """Value ``n`` rows before (``n`` > 0) or after (``n`` < 0) in ``order``.

    ``cols`` maps new names to source columns, or to (column, distance) pairs to
    take several distances in one pass.  ``order`` must be unique in a group.
    With ``slab`` - a non-decreasing function of ``order``, such as its decade -
    a group is cut into slabs that are sorted in separate tasks; the few rows
    that look across a slab border take their value from a table of slab ends.
    Without it a group must be small, as a panel unit is.
    """
    by = _names(by)
    want = {name: (c, abs(n)) if isinstance(c, str) else c for name, c in cols.items()}
    shift = F.lag if n > 0 else F.lead
    if slab is None:
        w = Window.partitionBy(*by).orderBy(order)
        return df.withColumns({name: shift(c, k).over(w) for name, (c, k) in want.items()})
    src, far = sorted({c for c, _ in want.values()}), max(k for _, k in want.values())
    toward, away = (F.asc, F.desc) if n > 0 else (F.desc, F.asc)
    d = df.withColumn("__slab", slab)
    w = Window.partitionBy(*by, "__slab").orderBy(toward(order))
    here = d.withColumn("__rn", F.row_number().over(w))
    here = here.withColumns({f"__s_{name}": F.lag(c, k).over(w) for name, (c, k) in want.items()})
    # The last rows of a slab in looking direction: at most ``far`` of them.
    back = F.row_number().over(Window.partitionBy(*by, "__slab").orderBy(away(order)))
    ends = (
        d.withColumn("__e", back).where(F.col("__e") <= far).groupBy(*by, "__slab")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("__e"), *src)), asc=False).alias("__end"))
    )
    # Every slab holds at least one row, so ``far`` slabs hold ``far`` rows.
    before = Window.partitionBy(*by).orderBy(toward("__slab")).rowsBetween(-far, -1)
    ends = ends.withColumn("__prev", F.flatten(F.collect_list("__end").over(before))).drop("__end")
    j = merge(here, ends, by=by + ["__slab"], how="left")

    def value(name, c, k):
        at = F.size("__prev") - F.lit(k) + F.col("__rn")  # 1-based place in the rows before
        old = F.when(at >= 1, F.try_element_at("__prev", at))[c]
        return F.when(F.col("__rn") <= k, old).otherwise(F.col(f"__s_{name}")).alias(name)

    return j.select(*df.columns, *[value(name, c, k) for name, (c, k) in want.items()])


def calendar_lag(df: DataFrame, unit, time: str, cols: dict[str, str], k: int = 1) -> DataFrame:
    """Value of the same unit exactly ``k`` time steps earlier, NULL over gaps.

    An equi-join on (unit, time): a long unit spreads over all partitions.
    (unit, time) must identify a row.
    """
    unit = _names(unit)
    past = df.select(
        *unit, (F.col(time) + F.lit(k)).alias(time), *[F.col(c).alias(name) for name, c in cols.items()]
    )
    return merge(df, past, by=unit + [time], how="left").select(*df.columns, *cols)


def neighbour(
    df: DataFrame, by, bin_: str, time: str, cols: dict[str, str], step: int = 1, years: tuple[int, int] | None = None
) -> DataFrame:
    """Value of the next bin up (``step`` 1) or down (-1) at the same time.

    Bins are ranked within ``by`` among the distinct bins that occur; ``years``
    limits the times for which a neighbour is looked up.
    """
    by = _names(by)
    # Distinct (group, bin) pairs only: the window never sees data rows.
    rank = df.select(*by, bin_).distinct().withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*by).orderBy(bin_))
    )
    here = merge(df, rank, by=by + [bin_], how="left")
    other = here.select(
        *by, (F.col("__rank") - F.lit(step)).alias("__rank"), time, *[F.col(c).alias(f"__n_{n}") for n, c in cols.items()]
    )
    out = merge(here, other, by=by + ["__rank", time], how="left")
    ok = F.lit(True) if years is None else F.col(time).between(*years)
    # both values must exist
    vals = {n: F.when(ok & F.col(c).isNotNull(), F.col(f"__n_{n}")) for n, c in cols.items()}
    return out.select(*df.columns, *[v.alias(n) for n, v in vals.items()])


def spread_lags(df: DataFrame, by, order: str, vars_, lags=(1, 2, 3), slab: Column | None = None) -> DataFrame:
    """``lag<k>_<var>`` for every variable and lag."""
    return row_shift(df, by, order, {f"lag{k}_{v}": (v, k) for k in lags for v in vars_}, 1, slab)
