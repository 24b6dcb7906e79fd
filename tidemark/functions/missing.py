"""Scalar and aggregate expressions with explicit missing-value rules.

"strict" aggregates are NULL as soon as one input is NULL; "skip" aggregates
ignore NULL.  Both are ordinary partial aggregates, so Spark combines them on
the map side and a hot group costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- scalar -----------------------------------------------------------------

def ifelse(cond: Column, a, b) -> Column:
    """Conditional that stays NULL where the condition is NULL."""
    a, b = (v if isinstance(v, Column) else F.lit(v) for v in (a, b))
    return F.when(cond, a).when(~cond, b)


def fill(x, default) -> Column:
    return F.coalesce(_c(x), default if isinstance(default, Column) else F.lit(default))


def sentinel_to_null(x, sentinel=-9999.0) -> Column:
    return F.nullif(_c(x), F.lit(sentinel))


def floor_zero(x, eps=1e-4) -> Column:
    """Replace exact zeros by ``eps`` so that a log exists; NULL stays NULL."""
    x = _c(x)
    return ifelse(x == 0, F.lit(eps), x)


def squeeze(x, eps=1e-5) -> Column:
    """Move the end points of a proportion inside the open unit interval."""
    x = _c(x)
    return F.when(x == 0, F.lit(eps)).when(x == 1, F.lit(1.0 - eps)).otherwise(x)


def finite(x) -> Column:
    """TRUE only for a present, non-NaN, non-infinite number (never NULL)."""
    x = _c(x)
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def log_ratio(a, b) -> Column:
    return F.ln(F.try_divide(_c(a), _c(b)))


def not_in(x, values) -> Column:
    """Exclusion list that keeps NULL, as membership there is never NULL."""
    return ~F.coalesce(_c(x).isin(list(values)), F.lit(False))


# -- aggregates ---------------------------------------------------------------

def _complete(x: Column) -> Column:
    return F.count(F.lit(1)) == F.count(x)


def strict_sum(x) -> Column:
    return F.when(_complete(_c(x)), F.sum(_c(x)))


def strict_mean(x) -> Column:
    x = _c(x)
    return F.when(_complete(x), F.avg(x))


def skip_sum(x) -> Column:
    """Sum of the present values; 0 when there are none."""
    return F.coalesce(F.sum(_c(x)), F.lit(0.0))


def skip_mean(x) -> Column:
    return F.avg(_c(x))


def frequency(b) -> Column:
    """Strict mean of a logical column."""
    return strict_mean(_c(b).cast("double"))


def n_unique(x) -> Column:
    """Distinct count in which NULL is one more value."""
    x = _c(x)
    return F.count_distinct(x) + F.max(x.isNull().cast("int"))


def n_unique_where(cond: Column, x) -> Column:
    return F.count_distinct(F.when(cond, _c(x)))


def min_where(cond: Column, x) -> Column:
    return F.min(F.when(cond, _c(x)))


def any_present(x) -> Column:
    """1 if the group holds one non-NULL value, else 0."""
    return F.max(_c(x).isNotNull().cast("int"))


def weighted_mean(x, w, cond: Column | None = None) -> Column:
    """Weighted mean; NULL if a weight is NULL, if a value with non-zero weight
    is NULL, or if the weights add up to zero.  Logical weights are allowed."""
    x, w = _c(x).cast("double"), _c(w).cast("double")
    if cond is not None:
        bad = F.when(cond, w.isNull() | (x.isNull() & (w != 0)))
        xw, w = F.when(cond & (w != 0), x * w), F.when(cond, w)
    else:
        bad = w.isNull() | (x.isNull() & (w != 0))
        xw = F.when(w != 0, x * w)
    return F.when(~F.coalesce(F.max(bad), F.lit(False)), F.try_divide(F.sum(xw), F.sum(w)))


def weighted_var(x, w) -> Column:
    """Weighted variance over complete pairs with divisor (sum of weights - 1).

    One pass of squares: shift ``x`` near zero first, by any constant of the
    group (``panel.weighted_variance`` does), or large means cancel.
    """
    x, w = _c(x).cast("double"), _c(w).cast("double")
    both = x.isNotNull() & w.isNotNull()
    sw = F.sum(F.when(both, w))
    swx = F.sum(F.when(both, w * x))
    swxx = F.sum(F.when(both, w * x * x))
    return F.try_divide(swxx - F.try_divide(swx * swx, sw), sw - F.lit(1.0))


def root(v: Column) -> Column:
    """Square root, NULL for a negative argument."""
    return F.when(v >= 0, F.sqrt(v))


def sum_or_mean(x) -> Column:
    """Mean when every record of the group carries the same value, else sum."""
    x = _c(x)
    same = F.min(x).eqNullSafe(F.max(x)) & ((F.count(x) == F.count(F.lit(1))) | (F.count(x) == 0))
    return F.when(same, F.avg(x)).otherwise(F.coalesce(F.sum(x), F.lit(0.0)))


def share_where(cond: Column, x) -> Column:
    """Share of the group's total that meets ``cond``."""
    return F.try_divide(F.sum(F.when(cond, _c(x))), F.sum(_c(x)))
