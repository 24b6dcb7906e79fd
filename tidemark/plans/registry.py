"""Registered queries: a Spark plan and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.standins import View, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VIEWS: dict[str, str] = {}  # further oracle views shared by several queries


def query(name: str, sql: str | None = None, fl: str = "", d: int = 6):
    """Register ``fn(view) -> DataFrame``.

    ``fl`` lists floating columns both sides round to ``d`` digits, since the
    order of a distributed sum is not fixed.
    """
    digits = {}
    for item in fl.split():
        col, _, n = item.partition(":")
        digits[col] = int(n or d)

    def deco(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(View(spark, folder))
            return df.withColumns({c: rounded(F.col(c), n) for c, n in digits.items()}) if digits else df

        QUERIES[name] = run
        if sql:
            text = f"SELECT * FROM ({sql})"
            if digits:
                repl = ", ".join(f'floor("{c}" * 1e{n} + 0.501) / 1e{n} AS "{c}"' for c, n in digits.items())
                text = f"SELECT * REPLACE ({repl}) FROM ({sql})"
            ORACLE[name] = with_views(text, VIEWS)
        return fn

    return deco


def rounded(x, n: int):
    """Round half up; a tie stays a tie under the noise of a distributed sum."""
    return F.floor(x * F.lit(10.0**n) + F.lit(0.501)).cast("double") / F.lit(10.0**n)
