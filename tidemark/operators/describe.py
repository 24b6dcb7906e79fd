"""The numbers behind figures: histograms, quantiles, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .relational import _names, keep_in, merge


def histogram(df: DataFrame, x: str, lo: float, width: float, by=(), w: str | None = None) -> DataFrame:
    """Right-closed bins counted from ``lo`` (bin 0 also holds ``lo`` itself, values below it have negative bins):
    count, and with ``w`` the weight and its share."""
    by = _names(by)
    d = df.where(F.col(x).isNotNull())
    b = F.when(F.col(x) == lo, 0).otherwise(F.ceil((F.col(x) - F.lit(lo)) / F.lit(width)) - F.lit(1)).cast("int")
    d = d.withColumn("bin", b)
    out = d.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), *([F.coalesce(F.sum(w), F.lit(0.0)).alias("weight")] if w else [])
    )
    out = out.withColumn("bin_lo", F.lit(lo) + F.col("bin") * F.lit(width))
    if not w:
        return out
    if not by:
        # bins of one table: the total is one number over few bins
        out = out.withColumn("__all", F.expr("cast(bin * 0 as int)"))
        by = ["__all"]
    total = out.groupBy(*by).agg(F.sum("weight").alias("total"))
    out = merge(out, total, by=by)
    return out.withColumn("share", F.try_divide("weight", "total")).drop("__all")


def exact_quantiles(df: DataFrame, by, x: str, probs, bins: int = 1024, levels: int = 2) -> DataFrame:
    """Exact interpolated quantiles without gathering a group.

    Values are counted in ``bins`` equal cells between the group's extremes, the
    cells holding the wanted ranks are cut again, and only what is left is
    sorted, by distinct value: three passes over ``df`` (extremes, counts,
    wanted cells), then stored remainders.
    """
    by = _names(by)
    key = [*by, "__cell"]
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("__x")).withColumn("__cell", F.lit(0).cast("bigint"))
    want = None
    for _ in range(levels):
        r = cut(rows.groupBy(*key).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count(F.lit(1)).alias("__n")))
        if want is None:
            ends = F.array(*[
                F.struct(F.lit(p).alias("prob"), f(F.lit(p) * (F.col("__n") - 1)).cast("bigint").alias("__off"), F.lit(s).alias("side"))
                for p in probs for f, s in ((F.floor, 0), (F.ceil, 1))
            ])
            want = r.select(*key, "__n", F.explode(ends).alias("e")).select(*key, "__n", "e.*")
        pos = F.try_divide(F.col("__x") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins
        sub = F.least(F.lit(bins - 1), F.coalesce(F.floor(pos), F.lit(0)).cast("int"))
        rows = merge(rows, r.drop("__n"), by=key).withColumn("__new", F.col("__cell") * bins + sub).drop("__lo", "__hi")
        c = rows.groupBy(*key, "__new").agg(F.count(F.lit(1)).alias("__c"))
        # at most ``bins`` rows per window partition
        w = Window.partitionBy(*key).orderBy("__new").rowsBetween(Window.unboundedPreceding, -1)
        c = c.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0)))
        hit = (F.col("__off") >= F.col("__before")) & (F.col("__off") < F.col("__before") + F.col("__c"))
        want = merge(want, c, by=key, where=hit)
        want = want.withColumn("__off", F.col("__off") - F.col("__before")).withColumn("__cell", F.col("__new"))
        want = cut(want.drop("__new", "__before", "__c"))
        # the few cells that hold a wanted rank are stored; the rest is done with
        rows = cut(keep_in(rows.withColumn("__cell", F.col("__new")).drop("__new"), want, key))
    v = rows.groupBy(*key, "__x").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*key).orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    hit = (F.col("__off") >= F.col("__before")) & (F.col("__off") < F.col("__before") + F.col("__c"))
    at = merge(want, v, by=key, where=hit)
    h = F.col("prob") * (F.col("__n") - 1)
    weight = F.when(F.col("side") == 0, F.lit(1.0) - (h - F.floor(h))).otherwise(h - F.floor(h))
    return at.groupBy(*by, "prob").agg(F.sum(F.col("__x") * weight).alias("value"))


def five_numbers(df: DataFrame, by, x: str) -> DataFrame:
    by = _names(by)
    names = {0.0: "lowest", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "highest"}
    q = exact_quantiles(df, by, x, list(names))
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()])


def series(df: DataFrame, cond: Column, *cols: str) -> DataFrame:
    """The points of a figure: filtered rows, chosen columns."""
    return df.where(cond).select(*cols)


def profile(df: DataFrame, cond: Column, x: str, measure: Column, over: str, values) -> DataFrame:
    """A measure along ``x`` with one column per value of ``over`` among the rows of ``cond``; all must be listed."""
    rows = df.where(cond)
    return rows.groupBy(x).pivot(over, _listed(rows, over, values)).agg(measure)


def _listed(df: DataFrame, col: str, values) -> list:
    """``values``, after a check that ``col`` has no others."""
    other = df.where(~F.coalesce(F.col(col).isin(list(values)), F.lit(False))).select(col).first()
    if other is not None:
        raise ValueError(f"{col} has the value {other[0]!r}, which is not listed")
    return list(values)


def contingency(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """Counts by two columns; every value of ``col`` must be listed."""
    return df.groupBy(row).pivot(col, _listed(df, col, values)).agg(F.count(F.lit(1))).na.fill(0)
