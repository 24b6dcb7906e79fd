"""Missing-value rules on hand-computed cases."""

import math

from pyspark.sql import functions as F

from tidemark.functions import geo, missing as M, text as X


def one(spark, expr, schema="x double, w double", data=()):
    return spark.createDataFrame(list(data), schema).agg(expr.alias("v")).first().v


def cell(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first().v


def test_strict_and_skip(spark):
    d = [(1.0, 1.0), (None, 1.0)]
    assert one(spark, M.strict_mean("x"), data=d) is None
    assert one(spark, M.strict_sum("x"), data=d) is None
    assert one(spark, M.skip_mean("x"), data=d) == 1.0
    assert one(spark, M.skip_sum("x"), data=d) == 1.0
    assert one(spark, M.n_unique("x"), data=d) == 2
    assert one(spark, M.skip_sum("x"), data=[(None, 1.0)]) == 0.0
    assert one(spark, M.skip_mean("x"), data=[(None, 1.0)]) is None


def test_ifelse_keeps_null(spark):
    c = M.ifelse(F.col("x") > 1, F.lit("a"), F.lit("b"))
    assert cell(spark, c, "x double", (None,)) is None
    assert cell(spark, c, "x double", (2.0,)) == "a"
    assert cell(spark, c, "x double", (0.0,)) == "b"


def test_weighted_mean(spark):
    wm = lambda d: one(spark, M.weighted_mean("x", "w"), data=d)
    assert wm([(None, 0.0), (2.0, 1.0)]) == 2.0
    assert wm([(1.0, 0.0), (2.0, 0.0)]) is None
    assert wm([(1.0, None), (2.0, 1.0)]) is None
    assert wm([(None, 1.0), (2.0, 1.0)]) is None
    assert wm([(1.0, -1.0), (3.0, 3.0)]) == 4.0


def test_weighted_var(spark):
    assert abs(one(spark, M.weighted_var("x", "w"), data=[(1.0, 2.0), (3.0, 2.0)]) - 4 / 3) < 1e-12
    assert abs(one(spark, M.weighted_var("x", "w"), data=[(1.0, 2.0), (3.0, 2.0), (None, 5.0), (9.0, None)]) - 4 / 3) < 1e-12


def test_sum_or_mean(spark):
    f = lambda d: one(spark, M.sum_or_mean("x"), data=[(x, 0.0) for x in d])
    assert f([4.0, 4.0]) == 4.0
    assert f([4.0, 5.0]) == 9.0
    assert f([4.0, None]) == 4.0  # two distinct values, NA being one: the sum
    assert f([4.0, 4.0, None]) == 8.0
    assert f([None, None]) is None


def test_zero_recode(spark):
    assert cell(spark, M.floor_zero("x"), "x double", (0.0,)) == 1e-4
    assert cell(spark, M.floor_zero("x"), "x double", (None,)) is None
    assert cell(spark, M.sentinel_to_null("x"), "x double", (-9999.0,)) is None
    assert cell(spark, M.squeeze("x"), "x double", (1.0,)) == 1 - 1e-5
    assert cell(spark, M.finite("x"), "x double", (float("inf"),)) is False
    assert cell(spark, M.finite("x"), "x double", (None,)) is False
    assert cell(spark, M.not_in("x", [1.0]), "x double", (None,)) is True


def test_bins(spark):
    want = {30.0: None, 30.5: 30.5, 31.0: 30.5, 31.0001: 31.5, 46.0: 45.5, 46.1: None}
    for x, b in want.items():
        assert cell(spark, geo.bin_mid("x", 30, 46), "x double", (x,)) == b
    assert cell(spark, geo.wrap_lon("x"), "x double", (-190.0,)) == 170.0


def test_names(spark):
    f = lambda e, s: cell(spark, e, "x string", (s,))
    assert f(X.capitalize(X.before("x", "_")), "gadus morhua_Atl") == "Gadus morhua"
    assert f(X.sentence_case("x"), "GADUS Morhua") == "Gadus morhua"
    assert f(X.clean_name("x"), "LIMANDA FERRUGINEA ") == "Limanda ferruginea"
    assert f(X.piece("x", "-", 2, 5), "a-b-c") == "b"
    assert f(X.piece("x", "-", 4, 5), "a-b-c") == ""
    assert f(X.key_year("x"), "19x5-1") is None
    assert f(X.after_last("x", "_"), "port_x_ma") == "ma"


def test_polygons(spark):
    from tidemark.sources.tables import rectangle

    ring = rectangle(*[F.lit(float(v)) for v in (0, 2, 0, 1)])
    for x, y, inside in ((1.0, 0.5, True), (0.0, 0.5, True), (2.0, 1.0, True), (2.1, 0.5, False), (1.0, -0.1, False)):
        assert cell(spark, geo.in_ring("x", "y", ring), "x double, y double", (x, y)) is inside
    c = cell(spark, geo.ring_centroid(ring), "x int", (1,))
    assert abs(c.lon - 1) < 1e-12 and abs(c.lat - 0.5) < 1e-12
    area = cell(spark, geo.ring_area_km2(rectangle(*[F.lit(float(v)) for v in (0, 1, 0, 1)])), "x int", (1,))
    exact = 6371.0088**2 * math.radians(1) * math.sin(math.radians(1))
    assert abs(area / exact - 1) < 1e-4
