"""Binning and polygon expressions.  A polygon is an ``array<struct<lon,lat>>``
ring; it need not repeat its first point at the end."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import _c

EARTH_KM = 6371.0088


def bin_mid(x, lo: float, hi: float, width: float = 1.0) -> Column:
    """Midpoint of the right-closed bin holding ``x``; NULL outside (lo, hi]."""
    x = _c(x)
    mid = F.lit(float(lo)) + (F.ceil((x - F.lit(float(lo))) / F.lit(float(width))).cast("double") - 0.5) * float(width)
    return F.when((x > lo) & (x <= hi), mid)


def round_to(x, step: float) -> Column:
    """Nearest multiple of ``step``, ties to even."""
    return F.bround(_c(x) / F.lit(step)) * F.lit(step)


def wrap_lon(x) -> Column:
    """Longitudes below -180 continue from +180 downwards."""
    x = _c(x)
    return F.when(x < -180, F.lit(180.0) + (x + F.lit(180.0))).otherwise(x)


def _edges(ring: Column) -> Column:
    """Array of (a, b) point pairs, closing the ring."""
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_edges(px, py, edges) -> Column:
    """TRUE if the point is inside or on the border of the ring whose ``edges``
    (pairs of points) are given: 1 counts crossings, a border hit ends it."""
    px, py = _c(px), _c(py)

    def step(acc, e):
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        near = px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
        # left of an upward edge or right of a downward one: the ray to the east meets it
        meets = ((ay > py) != (by > py)) & ((cross > 0) == (by > ay))
        return F.when((acc < 0) | ((cross == 0) & near), F.lit(-1)).otherwise(acc + meets.cast("int"))

    hits = F.aggregate(edges, F.lit(0), step)
    return (hits < 0) | (hits % 2 == 1)


def side_of(x, y, e) -> Column:
    """Positive where edge ``e`` passes (x, y) on the right if it goes up, on the left if down; zero on its line."""
    ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
    return (bx - ax) * (y - ay) - (by - ay) * (x - ax)


def left_of_corner(x0, y0, e) -> Column:
    """TRUE if edge ``e`` meets the line just above ``y0`` to the left of a place just left of ``x0``.

    Just above and just left settle all ties: a place on the edge itself counts
    by the edge's slope.  Only edges with one end above ``y0`` are asked.
    """
    rise, run = F.signum(e["b"]["lat"] - e["a"]["lat"]), F.signum(e["b"]["lon"] - e["a"]["lon"])
    gap = side_of(x0, y0, e) * rise
    return (gap < 0) | ((gap == 0) & (run * rise < 0))


def in_cell(px, py, x0, y0, corner, edges) -> Column:
    """TRUE if a point of the cell with the lower left corner (x0, y0) is inside a ring or on its border.

    ``corner`` tells whether the place just left of and above the corner is
    inside; ``edges`` are the ring's edges that cross the cell.  The way from there
    goes up to the point's height and then to the point; each crossing changes
    sides.
    """
    px, py = _c(px), _c(py)

    def step(acc, e):
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        rise, run = F.signum(by - ay), F.signum(bx - ax)
        here, turn = side_of(px, py, e), side_of(x0, py, e)
        near = px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
        across = ((ay > py) != (by > py)) & ((here * rise < 0) != left_of_corner(x0, py, e))
        up = ((ax >= x0) != (bx >= x0)) & ((turn * run >= 0) != (side_of(x0, y0, e) * run >= 0))
        return F.when((acc < 0) | ((here == 0) & near), F.lit(-1)).otherwise(acc + across.cast("int") + up.cast("int"))

    hits = F.aggregate(edges, corner.cast("int"), step)
    return (hits < 0) | (hits % 2 == 1)


def in_ring(lon, lat, ring) -> Column:
    """TRUE if the point is inside the ring or on its border."""
    return in_edges(lon, lat, _edges(_c(ring)))


def ring_area_km2(ring) -> Column:
    """Spherical area of the ring in square kilometres."""
    rad = math.pi / 180.0
    total = F.aggregate(
        _edges(_c(ring)),
        F.lit(0.0),
        lambda acc, e: acc
        + (e["b"]["lon"] - e["a"]["lon"]) * rad
        * (F.lit(2.0) + F.sin(e["a"]["lat"] * rad) + F.sin(e["b"]["lat"] * rad)),
    )
    return F.abs(total) * F.lit(EARTH_KM * EARTH_KM / 2.0)


def ring_centroid(ring) -> Column:
    """Planar area-weighted centroid as ``struct<lon,lat>``."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc, e):
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        w = ax * by - bx * ay
        return F.struct(
            (acc["s"] + w).alias("s"), (acc["x"] + (ax + bx) * w).alias("x"), (acc["y"] + (ay + by) * w).alias("y")
        )

    return F.aggregate(
        _edges(_c(ring)), zero, step,
        lambda a: F.struct(
            F.try_divide(a["x"], a["s"] * 3.0).alias("lon"), F.try_divide(a["y"], a["s"] * 3.0).alias("lat")
        ),
    )
