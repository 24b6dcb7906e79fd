"""The cell index against tests over whole rings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geo import in_ring
from tidemark.operators import spatial as S

RING = "array<struct<lon:double,lat:double>>"


def star(r, n, cx=0.0, cy=0.0, size=5.0):
    out = []
    for k in range(n):
        d = size * (0.4 + 0.6 * r.random())
        out.append((cx + d * math.cos(2 * math.pi * k / n), cy + d * math.sin(2 * math.pi * k / n)))
    return out


def polygons(r):
    out = {"star": star(r, 40), "small": star(r, 9, 0.3, 0.2, 0.2), "triangle": [(-3.0, -3.0), (4.0, -1.0), (0.0, 4.0)]}
    out["grid"] = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0), (0.0, 1.0)]
    out["diamond"] = [(0.0, -2.0), (2.0, 0.0), (0.0, 2.0), (-2.0, 0.0)]
    # whole-number corners: edges and corners lie on the lines of the cells
    for k in range(25):
        ring = sorted({(float(r.randint(-4, 4)), float(r.randint(-4, 4))) for _ in range(r.randint(3, 9))}, key=lambda p: (math.atan2(p[1] - 0.1, p[0] - 0.1), p))
        out[f"corners{k}"] = ring
    out["closed"] = [*out["triangle"], out["triangle"][0]]
    return out


@pytest.mark.parametrize("size", [0.25, 1.0, 0.7])
def test_contained_against_whole_rings(spark, size):
    r = random.Random(5)
    rings = polygons(r)
    polys = spark.createDataFrame([(k, v) for k, v in rings.items()], f"name string, ring {RING}")
    spots = [(r.uniform(-6, 6), r.uniform(-6, 6)) for _ in range(300)] + [(x / 2, y / 2) for x in range(-9, 10) for y in range(-9, 10)]
    spots += rings["star"] + [(x * size, y * size) for x in range(-6, 7) for y in range(-6, 7)] + [(1 / 3, 1 / 3), (0.125, 0.5)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "id int, lon double, lat double")
    got = {(x.name, x.id) for x in S.contained(points, polys, size=size).collect()}
    whole = points.crossJoin(F.broadcast(polys)).where(in_ring("lon", "lat", "ring")).select("name", "id")  # a small fixture
    assert got == {tuple(x) for x in whole.collect()}


def test_long_ring_has_local_edges(spark):
    r = random.Random(6)
    n = 10_000
    ring = star(r, n, size=8.0)
    polys = spark.createDataFrame([("long", ring)], f"name string, ring {RING}")
    index = S.cell_index(polys, 0.25)
    most, edges, cells = index.select(F.max(F.size("__edges")), F.sum(F.coalesce(F.size("__edges"), F.lit(0))), F.count("*")).first()
    assert most < n / 20 and cells > 500 and index.where("__whole and __edges is not null").count() == 0
    points = spark.createDataFrame([(i, r.uniform(-9, 9), r.uniform(-9, 9)) for i in range(400)], "id int, lon double, lat double")
    got = {x.id for x in S.contained(points, polys).collect()}
    assert got == {x.id for x in points.crossJoin(F.broadcast(polys)).where(in_ring("lon", "lat", "ring")).collect()}


def test_index_rules(spark, rows):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    polys = spark.createDataFrame([(1, square), (1, square), (2, []), (3, None), (4, [(0.5, 0.5)])], f"id int, ring {RING}")
    points = spark.createDataFrame([(1, 0.6, 0.4), (2, None, 0.5), (3, 0.5, 0.5), (4, 7.0, 7.0)], "p int, lon double, lat double")
    assert rows(S.contained(points, polys), "id", "p") == [(1, 1), (1, 3), (4, 3)]
    assert rows(S.locate(points, polys, "id"), "p", "id") == [(1, 1), (2, None), (3, 1), (4, None)]
    assert S.contained(points, polys.limit(0)).count() == 0
