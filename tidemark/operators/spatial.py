"""Points and polygons.

Polygons are indexed on square grid cells; points meet their cell by an
equi-join.  An index row holds only the edges that cross its cell, and whether the
cell's corner is inside, so that a point is tested against the edges near it
however long the ring is.  A cell that no edge crosses lies wholly inside or
outside, and needs no test.  Cells are gathered, not points: each point is joined
once and never regrouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import _edges, in_cell, left_of_corner
from .relational import first_per_key, merge


def _cells(low, high, size: float):
    """Numbers of the cells from ``low`` to ``high``, with room for rounding."""
    pad = size * 1e-9
    return F.sequence(F.floor((low - pad) / size).cast("int"), F.floor((high + pad) / size).cast("int"))


def cell_index(polys: DataFrame, size: float) -> DataFrame:
    """One row per (polygon, cell it may touch) with the polygon's attributes.

    ``__whole`` cells are inside all over; for the others ``__edges`` are the
    edges crossing the cell and ``__corner`` tells whether its lower left corner
    is inside.  Cells wholly outside are left out.

    Each edge goes to the cells it crosses, column by column, and to the rows
    whose lower line it crosses: all cells to the right of that place change
    sides.  The sum of these changes along a row tells inside from outside.
    Repeated polygons (all columns equal) count once; a polygon without points
    has no cells.
    """
    attrs = [c for c in polys.columns if c != "ring"]
    keyed = polys.withColumn("__poly", F.xxhash64(*polys.columns)).dropDuplicates(["__poly"])
    e = F.col("e")
    ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
    edges = keyed.select("__poly", F.explode(_edges(F.col("ring"))).alias("e"))

    columns = edges.withColumn("__cx", F.explode(_cells(F.least(ax, bx), F.greatest(ax, bx), size)))

    def height(x):  # of the edge over x, or over its nearer end
        x = F.greatest(F.least(x, F.greatest(ax, bx)), F.least(ax, bx))
        return ay + (by - ay) * F.try_divide(x - ax, bx - ax)

    left, right = height(F.col("__cx") * size), height((F.col("__cx") + 1) * size)
    upright = ax == bx
    low = F.when(upright, F.least(ay, by)).otherwise(F.least(left, right))
    high = F.when(upright, F.greatest(ay, by)).otherwise(F.greatest(left, right))
    crossed = columns.withColumn("__cy", F.explode(_cells(low, high, size))).select("__poly", "__cx", "__cy", "e", F.lit(0).alias("__turn"))

    y0 = F.col("__cy") * size
    lines = edges.withColumn("__cy", F.explode(_cells(F.least(ay, by), F.greatest(ay, by), size))).where((ay > y0) != (by > y0))
    near = F.floor((ax + (bx - ax) * (y0 - ay) / (by - ay)) / size).cast("int")

    def past(k):
        return left_of_corner(k * size, y0, e)

    first = F.when(past(near - 1), near - 1).when(past(near), near).when(past(near + 1), near + 1).otherwise(near + 2)
    turns = lines.select("__poly", first.alias("__cx"), "__cy", F.lit(None).cast(edges.schema["e"].dataType).alias("e"), F.lit(1).alias("__turn"))

    cells = crossed.unionByName(turns).groupBy("__poly", "__cy", "__cx").agg(
        F.collect_list("e").alias("__edges"), F.sum("__turn").alias("__turn"))
    row = Window.partitionBy("__poly", "__cy").orderBy("__cx")
    cells = cells.withColumn("__corner", F.sum("__turn").over(row) % 2 == 1).withColumn("__next", F.lead("__cx").over(row))
    run = F.sequence(F.col("__cx"), F.when(F.col("__corner"), F.coalesce(F.col("__next") - 1, F.col("__cx"))).otherwise(F.col("__cx")))
    cells = cells.withColumn("__at", F.explode(run))
    cut = (F.col("__at") == F.col("__cx")) & (F.size("__edges") > 0)
    cells = cells.where(cut | F.col("__corner")).select(
        "__poly", F.col("__at").alias("__cx"), "__cy", (~cut).alias("__whole"), "__corner", F.when(cut, F.col("__edges")).alias("__edges"))
    return cells.join(keyed.select("__poly", *attrs), "__poly").drop("__poly")


def _point_cells(points: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    return points.withColumns({
        "__cx": F.floor(F.col(lon) / size).cast("int"), "__cy": F.floor(F.col(lat) / size).cast("int")
    })


def _inside(lon: str, lat: str, size: float, cell):
    return cell["__whole"] | in_cell(lon, lat, F.col("__cx") * size, F.col("__cy") * size, cell["__corner"], cell["__edges"])


def locate(points: DataFrame, polys: DataFrame, area_id: str, carry=(), lon="lon", lat="lat", size: float = 0.25) -> DataFrame:
    """Every point with the lowest-numbered polygon containing it (border
    included), NULL when there is none.  ``carry`` adds polygon attributes.

    ``size`` is the cell edge in degrees; smaller cells settle more points
    without a test and keep the per-cell lists of edges short.
    """
    attrs = [area_id, *carry]
    found = F.struct(*attrs)
    cells = cell_index(polys.select(*attrs, "ring"), size)
    index = cells.groupBy("__cx", "__cy").agg(
        # the usual cell lies in one polygon all over: nothing is left to test
        F.when((F.count(F.lit(1)) == 1) & F.max("__whole"), F.max(found)).alias("__sole"),
        F.collect_list(F.struct(*attrs, "__whole", "__corner", "__edges")).alias("__near"),
    )
    j = merge(_point_cells(points, lon, lat, size), index, by=["__cx", "__cy"], how="left", nulls="drop")
    hits = F.filter("__near", lambda p: _inside(lon, lat, size, p))
    # structs order by their first field, the id
    best = F.array_min(F.transform(hits, lambda p: F.struct(*[p[c].alias(c) for c in attrs])))
    best = F.when(F.col("__sole").isNotNull(), F.col("__sole")).otherwise(best)
    # exploding a one-element array keeps Spark from repeating the test per use
    return j.withColumn("__hit", F.explode(F.array(best))).select(*points.columns, *[F.col(f"__hit.`{c}`").alias(c) for c in attrs])


def contained(points: DataFrame, polys: DataFrame, lon="lon", lat="lat", size: float = 0.25) -> DataFrame:
    """One row per (polygon, point inside it), with the polygon's attributes."""
    j = merge(_point_cells(points, lon, lat, size), cell_index(polys, size), by=["__cx", "__cy"], nulls="drop")
    attrs = [c for c in polys.columns if c != "ring"]
    near = {c: F.col(c) for c in ("__whole", "__corner", "__edges")}
    return j.where(_inside(lon, lat, size, near)).select(*attrs, *points.columns)


def hauls_by_boundary(hauls: DataFrame, boundaries: DataFrame, size: float = 0.25) -> DataFrame:
    """Hauls inside each stock boundary; only the first feature of a boundary counts."""
    first = first_per_key(boundaries, ["assessid", "stockid"], "feature_id")
    return contained(hauls, first, size=size)


def hauls_by_area(hauls: DataFrame, areas: DataFrame, stock_map: DataFrame, size: float = 0.25) -> DataFrame:
    """Hauls of each (stock, species): placed once, then joined to the stock's areas.

    ``areas`` holds ``Id``, ``area`` and ``ring``; hauls in none of the stock's
    areas drop out.
    """
    placed = locate(hauls, areas, "Id", carry=["area"], size=size).where(F.col("Id").isNotNull())
    return merge(
        stock_map.select("RAM_stockid", "spp", "StatArea"), placed, by_x="StatArea", by_y="Id", nulls="drop"
    )
