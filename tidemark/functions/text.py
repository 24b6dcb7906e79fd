"""Name and key clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import _c


def capitalize(x) -> Column:
    """Upper-case the first letter only; the rest is untouched."""
    x = _c(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def sentence_case(x) -> Column:
    x = _c(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def before(x, sep: str) -> Column:
    """Text before the first ``sep`` (all of it when there is none)."""
    return F.substring_index(_c(x), sep, 1)


def after_last(x, sep: str) -> Column:
    """Text after the last ``sep`` (all of it when there is none)."""
    return F.substring_index(_c(x), sep, -1)


def piece(x, sep: str, n: int, limit: int) -> Column:
    """The n-th (1-based) of at most ``limit`` pieces; '' when absent."""
    x = _c(x)
    return F.when(x.isNotNull(), F.coalesce(F.try_element_at(F.split(x, sep, limit), F.lit(n)), F.lit("")))


def key_year(x) -> Column:
    """Year held in the first four characters of a key, NULL if unreadable."""
    return F.substring(_c(x), 1, 4).try_cast("int")


def clean_name(x) -> Column:
    """Trailing blanks off, lower case, first letter upper case."""
    return capitalize(F.rtrim(F.lower(_c(x))))
