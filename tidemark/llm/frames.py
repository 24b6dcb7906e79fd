"""Columns that travel with a document through an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMBINE = 32 << 20  # bytes of text whose rows are combined before a shuffle


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, *own: str):
    """All columns but ``own`` as one struct, so that no name of an operator clashes with them."""
    rest = [F.col(quoted(c)) for c in df.columns if c not in own]
    return F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("nothing"))


def released(df: DataFrame, names: list[str], own: list[str], direct: tuple[str, ...] = ("text",)) -> DataFrame:
    """The first columns in their first order (``direct`` ones from outside ``rest``), then the operator's; an
    operator's column replaces one of its name."""
    kept = [F.col(c) if c in direct else F.col(f"rest.{quoted(c)}") for c in names if c not in own]
    return df.select(*kept, *own)


def key_column(df: DataFrame, name: str = "doc_id"):
    """The document key as a long; a null key comes before all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(1 << 63)).cast("long"))


def schema_of(df: DataFrame, **more: str) -> T.StructType:
    """``df``'s schema with further fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in more.items())])
