"""Joins, keyed filters and unions with NULL-matches-NULL keys.

No join here carries a broadcast hint but those with a counted list or table:
Spark compares the measured size of a side with
``spark.sql.autoBroadcastJoinThreshold`` and falls back to a sort-merge join,
whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


FEW = 10_000  # short rows that are sent to every task


def _names(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _on(pairs, nulls: str) -> Column:
    if nulls == "match":
        return reduce(lambda a, b: a & b, (F.col(l).eqNullSafe(F.col(r)) for l, r in pairs))
    return reduce(lambda a, b: a & b, (F.col(l) == F.col(r) for l, r in pairs))


def merge(
    a: DataFrame, b: DataFrame, by=None, by_x=None, by_y=None, how: str = "inner",
    suffixes=("_x", "_y"), nulls: str = "match", where: Column | None = None,
) -> DataFrame:
    """Equi-join on ``by`` (or ``by_x``/``by_y``), keys first and named as in ``a``.

    Columns both sides carry outside the key get ``suffixes``.  NULL keys match
    each other unless ``nulls='drop'``.  ``where`` is a further condition on the
    joined row (for inequalities between the sides).
    """
    kx = _names(by if by is not None else by_x)
    ky = _names(by if by is not None else by_y)
    clash = [c for c in a.columns if c in b.columns and c not in kx and c not in ky]
    # a left column named like a differently named right key also clashes
    a2 = a.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    tmp = {k: f"__key{i}" for i, k in enumerate(ky)}
    b2 = b.withColumnsRenamed({c: c + suffixes[1] for c in clash} | tmp)
    j = a2.join(b2, _on(list(zip(kx, tmp.values())), nulls), how)
    if where is not None:
        j = j.where(where)
    if how in ("right", "full", "outer"):
        keys = [F.coalesce(F.col(x), F.col(t)).alias(x) for x, t in zip(kx, tmp.values())]
    else:
        keys = [F.col(x) for x in kx]
    rest = [F.col(c) for c in a2.columns if c not in kx]
    rest += [F.col(c) for c in b2.columns if c not in tmp.values()]
    return j.select(*keys, *rest)


def merge_few(a: DataFrame, b: DataFrame, by) -> DataFrame:
    """``merge`` with a stored table of one short row per key, sent to ``a``'s tasks if it has at most ``FEW`` rows (counted first).

    Else a key with very many rows would be sorted in one task.
    """
    return merge(a, F.broadcast(b) if b.count() <= FEW else b, by=by)


def shared_join(a: DataFrame, b: DataFrame, how: str = "inner", nulls: str = "match") -> DataFrame:
    """Join on every column name the two tables have in common."""
    return merge(a, b, by=[c for c in a.columns if c in b.columns], how=how, nulls=nulls)


def _keyed(a, b, by, by_y, how):
    kx, ky = _names(by), _names(by_y if by_y is not None else by)
    tmp = [f"__key{i}" for i in range(len(ky))]
    # Distinct keys combine on the map side: a hot key on the right is one row.
    right = b.select(*[F.col(k).alias(t) for k, t in zip(ky, tmp)]).distinct()
    return a.join(right, _on(list(zip(kx, tmp)), "match"), how)


def keep_in(a: DataFrame, b: DataFrame, by, by_y=None) -> DataFrame:
    """Rows of ``a`` whose key occurs in ``b``; NULL is in a set holding NULL."""
    return _keyed(a, b, by, by_y, "left_semi")


def drop_in(a: DataFrame, b: DataFrame, by, by_y=None) -> DataFrame:
    """Rows of ``a`` whose key does not occur in ``b``."""
    return _keyed(a, b, by, by_y, "left_anti")


def having(df: DataFrame, by, cond: Column, **aggs: Column) -> DataFrame:
    """Aggregate, then keep the groups that meet ``cond``."""
    return df.groupBy(*_names(by)).agg(*[v.alias(k) for k, v in aggs.items()]).where(cond)


def first_per_key(df: DataFrame, by, order) -> DataFrame:
    """First row of every key in the given order; NULL is one key.

    A minimum over (order, row) structs, so Spark reduces on the map side and a
    hot key never has to be sorted in one task.
    """
    by, order = _names(by), _names(order)
    rest = [c for c in df.columns if c not in by]
    row = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])
    out = df.groupBy(*by).agg(F.min(row).alias("__r"))
    return out.select(*[F.col(c) if c in by else F.col(f"__r.`{c}`").alias(c) for c in df.columns])


def later_per_key(df: DataFrame, by, order) -> DataFrame:
    """The complement of ``first_per_key``; ``order`` identifies a row."""
    return drop_in(df, first_per_key(df, by, order), by=_names(order))


def stack(*dfs: DataFrame, fill: bool = False) -> DataFrame:
    """Union of like tables by column name; ``fill`` adds missing columns as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), dfs)


def append_missing(preferred: DataFrame, other: DataFrame, by) -> DataFrame:
    """``preferred`` plus the rows of ``other`` whose key it does not hold."""
    cols = preferred.columns
    return preferred.unionByName(drop_in(other, preferred, by).select(*cols))


def pick(df: DataFrame, wanted) -> DataFrame:
    """The wanted columns that exist, in the table's own order."""
    keep = set(wanted)
    return df.select(*[c for c in df.columns if c in keep])


LIST = 100_000  # values in one array; a longer list is cut and its rows are salted
SALTS = 64


def with_lists(df: DataFrame, values: DataFrame, col: str, within=()) -> DataFrame:
    """``df`` with the distinct values of ``values[col]`` as the array ``__values``, within groups of the ``within``
    columns when given, and ``__chunk``.

    The list is stored and counted.  Up to ``LIST`` values it goes to every task
    as it is, so ``df`` is not shuffled.  A longer one is cut by hash into chunks
    of about that size; then a row comes once per chunk and finds it by an
    equi-join on (group, chunk, salt), whose salts spread the rows of a group.
    """
    within = _names(within)
    lists = cut(values.select(*within, col).where(F.col(col).isNotNull()).distinct())
    n = lists.count()
    chunks = max(1, -(-n // LIST))
    lists = lists.groupBy(*within, F.pmod(F.xxhash64(col), F.lit(chunks)).cast("int").alias("__chunk")).agg(F.collect_list(col).alias("__values"))
    if chunks == 1:
        if within:
            return merge(df.withColumn("__chunk", F.lit(0)), F.broadcast(lists), by=[*within, "__chunk"])
        return df.withColumn("__chunk", F.lit(0)).join(F.broadcast(lists), "__chunk")
    rows = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    lists = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return merge(rows, lists, by=[*within, "__chunk", "__salt"]).drop("__salt")


def grid(df: DataFrame, values: DataFrame, col: str, within=()) -> DataFrame:
    """Every row of ``df`` with every distinct value of ``values[col]``, within groups of the ``within`` columns when given."""
    return with_lists(df, values, col, within).select(*df.columns, F.explode("__values").alias(col))
