"""Readers and writers: CSV, parquet snapshots, literal tables, polygon layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "array<struct<lon:double,lat:double>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; unreadable fields become NULL,
    as do the texts NA and the empty field."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA", emptyValue="", mode="PERMISSIVE")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_snapshot(df: DataFrame, path: str, partition_by=()) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_bundle(path: str, **tables: DataFrame) -> dict[str, str]:
    """Several tables saved together, one folder each."""
    return {name: write_snapshot(df, f"{path}/{name}") for name, df in tables.items()}


def literal(spark: SparkSession, schema: str, rows) -> DataFrame:
    """Small lookup table written out in code (safe to broadcast: its size is
    the size of the source line)."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def rectangle(lon_lo, lon_hi, lat_lo, lat_hi):
    """Ring expression of an axis-parallel rectangle."""
    def point(x, y):
        return F.struct(x.alias("lon"), y.alias("lat"))

    return F.array(point(lon_lo, lat_lo), point(lon_hi, lat_lo), point(lon_hi, lat_hi), point(lon_lo, lat_hi))


def polygon_layer(df: DataFrame, area_id: str, ring: str = "ring", attrs=()) -> DataFrame:
    """A polygon layer as a table: id, attributes and ring."""
    return df.select(area_id, *attrs, F.col(ring).cast(RING).alias("ring"))
