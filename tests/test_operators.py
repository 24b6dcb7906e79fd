"""Operators against brute force on small, random and hand-made frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import density as K
from tidemark.operators import describe as D
from tidemark.operators import landings as L
from tidemark.operators import panel as P
from tidemark.operators import relational as R
from tidemark.operators import spatial as S
from tidemark.operators import survey as V


def test_merge_null_keys_and_suffixes(spark, rows):
    a = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(None, "x"), (2, "y")], "k int, v string")
    assert rows(R.merge(a, b, by="k")) == [(None, "n", "x")]
    assert R.merge(a, b, by="k").columns == ["k", "v_x", "v_y"]
    assert rows(R.merge(a, b, by="k", how="right")) == [(None, "n", "x"), (2, None, "y")]
    assert rows(R.merge(a, b, by="k", nulls="drop")) == []
    assert rows(R.keep_in(a, b, "k")) == [(None, "n")]
    assert rows(R.drop_in(a, b, "k")) == [(1, "a")]


def test_first_and_later_rows_partition_the_input(spark, rows):
    d = spark.createDataFrame([(3, 1, "c"), (1, 1, "a"), (2, None, "b"), (4, None, "d")], "ord int, k int, v string")
    assert rows(R.first_per_key(d, "k", "ord")) == [(1, 1, "a"), (2, None, "b")]
    assert rows(R.later_per_key(d, "k", "ord")) == [(3, 1, "c"), (4, None, "d")]


@pytest.mark.parametrize("size", [100, 1])
def test_grid(spark, rows, monkeypatch, size):
    monkeypatch.setattr(R, "LIST", size)  # with 1 every value is a chunk of its own
    a = spark.createDataFrame([(1, "r"), (2, "s")], "h int, g string")
    b = spark.createDataFrame([("r", "x"), ("r", "y"), ("s", "x"), ("r", "x")], "g string, sp string")
    assert rows(R.grid(a, b, "sp"), "h", "sp") == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
    assert rows(R.grid(a, b, "sp", within="g"), "h", "sp") == [(1, "x"), (1, "y"), (2, "x")]


def test_append_missing_and_fill(spark, rows):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (2, "b")], "k int, v string")
    assert rows(R.append_missing(a, b, "k")) == [(1, "a"), (2, "b")]
    assert rows(R.stack(a, b.drop("v"), fill=True)) == [(1, None), (1, "a"), (2, None)]


def test_row_and_calendar_lag(spark, rows):
    d = spark.createDataFrame([("u", 2000, 1.0), ("u", 2001, 2.0), ("u", 2003, None), ("u", 2004, 5.0)], "u string, y int, x double")
    r = P.row_shift(d, "u", "y", {"l": "x"}, 1)
    assert rows(r, "y", "l") == [(2000, None), (2001, 1.0), (2003, 2.0), (2004, None)]
    c = P.calendar_lag(d, "u", "y", {"l": "x"})
    assert rows(c, "y", "l") == [(2000, None), (2001, 1.0), (2003, None), (2004, None)]


@pytest.mark.parametrize("n", [1, 3, -1, -2])
def test_sliced_lag_equals_plain_lag(spark, rows, n):
    rnd = random.Random(n)
    data = [(g, y, rnd.choice([None, float(y)])) for g in "abc" for y in rnd.sample(range(60), 25)]
    data += [("hot", y, float(y)) for y in range(300)]
    d = spark.createDataFrame(data, "g string, y int, x double")
    plain = P.row_shift(d, "g", "y", {"l": "x"}, n)
    sliced = P.row_shift(d, "g", "y", {"l": "x"}, n, slab=F.floor(F.col("y") / 2))
    assert rows(plain) == rows(sliced)


def test_lags_agree_on_consecutive_years(spark):
    d = spark.createDataFrame([(g, y, float(g * y)) for g in (1, 2) for y in (1, 2, 3, 6, 7)], "g int, y int, x double")
    j = P.calendar_lag(P.row_shift(d, "g", "y", {"r": "x"}, 1), "g", "y", {"c": "x"})
    diff = j.where(~F.col("r").eqNullSafe(F.col("c"))).select("y").distinct().collect()
    assert [r.y for r in diff] == [6]


def test_neighbour(spark, rows):
    d = spark.createDataFrame([("s", 30.5, 1, 1.0), ("s", 32.5, 1, 2.0), ("s", 32.5, 2, 3.0), ("s", 33.5, 2, 4.0)], "g string, b double, y int, x double")
    n = P.neighbour(d, "g", "b", "y", {"north": "x"}, 1)
    assert rows(n, "b", "y", "north") == [(30.5, 1, 2.0), (32.5, 1, None), (32.5, 2, 4.0), (33.5, 2, None)]


def test_standardise_zero_mean(spark, rows):
    d = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    assert rows(P.standardise(d, "g", "x", "z"), "g", "z") == [("a", 0.0), ("a", 0.0), ("b", -0.707106781), ("b", 0.707106781)]


def _survey(spark):
    rnd = random.Random(7)
    hauls = [(f"h{i}", "r1" if i % 3 else "r2", 2000 + i % 4, 30 + rnd.random() * 3, rnd.choice([None, 5.0, 7.0]), rnd.choice([1.0, 2.0])) for i in range(60)]
    catch, seen = [], set()
    for _ in range(120):
        k = (f"h{rnd.randrange(60)}", rnd.choice(["a", "b", "c"]))
        if k not in seen:
            seen.add(k)
            catch.append((*k, rnd.choice([0.0, None, -9999.0, 2.0, 5.0])))
    h = spark.createDataFrame(hauls, "haulid string, region string, year int, lat double, depth double, sbt double")
    return h, spark.createDataFrame(catch, "haulid string, spp string, wtcpue double"), hauls, catch


def test_zero_fill_rows(spark):
    h, c, hauls, catch = _survey(spark)
    got = {(r.haulid, r.spp): r for r in V.zero_fill(c, h).collect()}
    assert len(got) == len(hauls) * 3
    known = {(a, b): w for a, b, w in catch}
    for key, r in got.items():
        assert r.pres2 == (key in known)
        w = known.get(key, 0.0)
        w = 0.0 if w is None else None if w == -9999 else w
        assert r.wtcpue == w
        floor = None if w is None else 1e-4 if w == 0 else w
        assert r.wtcpuena == floor
        assert (r.wtcpuenal is None) if floor is None else abs(r.wtcpuenal - math.log(floor)) < 1e-12


def test_zero_fill_micro(spark, rows):
    h = spark.createDataFrame([("h1",), ("h2",)], "haulid string")
    c = spark.createDataFrame([("h1", "a", -9999.0), ("h9", "b", 1.0)], "haulid string, spp string, wtcpue double")
    z = V.zero_fill(c, h)
    assert rows(z, "haulid", "spp", "wtcpue") == [("h1", "a", None), ("h1", "b", 0.0), ("h2", "a", 0.0), ("h2", "b", 0.0)]


def test_zero_fill_keeps_duplicate_catches(spark):
    h = spark.createDataFrame([("h1",)], "haulid string")
    c = spark.createDataFrame([("h1", "a", 1.0), ("h1", "a", 2.0)], "haulid string, spp string, wtcpue double")
    assert sorted(r.wtcpue for r in V.zero_fill(c, h).collect()) == [1.0, 2.0]


def test_summary_equals_rows(spark, rows):
    from tidemark.functions.missing import skip_mean, strict_mean

    h, c, _, _ = _survey(spark)
    z = V.zero_fill(c, h)
    direct = z.groupBy("region", "year", "spp").agg(
        F.avg(F.col("pres2").cast("double")).alias("pres2"), strict_mean("wtcpue").alias("wtcpue"), skip_mean("wtcpue").alias("wtcpue_skip"),
        strict_mean("wtcpuenal").alias("wtcpuenal"), strict_mean("sbt").alias("sbt"), skip_mean("depth").alias("depth"), F.count(F.lit(1)).alias("num_hauls"),
    )
    short = V.zero_fill_summary(c, h, ["region", "year"], strict=("sbt",), skip=("depth",))
    assert rows(direct) == rows(short.select(direct.columns))


def test_regional_fill_is_complete(spark, rows):
    h = spark.createDataFrame([("h1", "r"), ("h2", "r"), ("h3", "s")], "haulid string, regionfact string")
    c = spark.createDataFrame([("h1", "gadus morhua_Atl", 2.0, 0.7, True)], "haulid string, sppocean string, wtcpue double, logwtcpue double, presfit boolean")
    z = V.zero_fill_regional(c, h)
    assert rows(z, "haulid", "spp", "wtcpue", "logwtcpue", "presfit") == [("h1", "Gadus morhua", 2.0, 0.7, True), ("h2", "Gadus morhua", 0.0, -10.0, False)]


def test_points_in_irregular_polygons(spark):
    rnd = random.Random(3)
    polys = [(1, [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]), (2, [(2, 2), (5, 2), (3.5, 5)])]
    pts = [(i, rnd.uniform(-1, 6), rnd.uniform(-1, 6)) for i in range(400)]
    p = spark.createDataFrame(pts, "id int, lon double, lat double")
    q = spark.createDataFrame([(i, [(float(a), float(b)) for a, b in r]) for i, r in polys], "pid int, ring array<struct<lon:double,lat:double>>")

    def inside(x, y, ring):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    got = {r.id: r.pid for r in S.locate(p, q, "pid", size=0.7).collect()}
    for i, x, y in pts:
        assert got[i] == next((k for k, r in polys if inside(x, y, r)), None)
    assert S.contained(p, q, size=0.7).count() == sum(inside(x, y, r) for _, x, y in pts for _, r in polys)


def test_density_close_to_exact(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    x, w = rnd.normal(38, 2, 500).clip(33, 45), rnd.integers(1, 20, 500).astype(float)
    d = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, w)] + [("s", 40.0, None)], "g string, x double, w double")
    out = K.kernel_density(d, "g", "x", "w", 30.5, 47.5, 0.5).orderBy("at").toPandas()
    at = out["at"].to_numpy()
    exact = (np.exp(-0.5 * ((at[:, None] - x) / 0.5) ** 2) * w).sum(1) / (0.5 * np.sqrt(2 * np.pi)) / w.sum()
    assert len(out) == 512
    assert np.abs(out["dens"] - exact).max() < 1e-3
    assert abs(out["dens"].sum() * 17 / 511 - 1) < 1e-3
    norm = K.normalise(K.kernel_density(d, "g", "x", "w", 30.5, 47.5, 0.5).withColumnRenamed("dens", "dens_qty"), "g")
    assert abs(norm.agg(F.sum("norm_dens")).first()[0] - 1) < 1e-12
    assert abs(norm.first().total_dens - 30.06) < 0.05


@pytest.mark.parametrize("bins", [4, 1024])
def test_exact_quantiles(spark, bins):
    import numpy as np

    rnd = random.Random(2)
    groups = {"flat": [5.0] * 7, "one": [3.0], "mix": [rnd.choice([0.0, 1e6, rnd.random()]) for _ in range(501)]}
    d = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("one", None)], "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in D.exact_quantiles(d, "g", "x", probs, bins=bins).collect():
        assert abs(r.value - np.quantile(groups[r.g], r.prob)) < 1e-9 * max(1, abs(r.value)), r


def test_histogram_edges(spark, rows):
    d = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (2.0,), (-1.0,), (None,)], "x double")
    assert rows(D.histogram(d, "x", 0.0, 1.0), "bin", "n") == [(-2, 1), (0, 2), (1, 2)]


def test_unmapped_share(spark, rows):
    t = spark.createDataFrame([("a", 1, 10, 5.0), ("a", 1, 11, 3.0), ("a", 1, 11, None), ("b", 1, 10, None)], "spp string, AKFIN_YEAR int, ADFG_I_STAT_AREA int, WHOLE_LBS double")
    area = spark.createDataFrame([(10,)], "STAT_AREA int")
    assert rows(L.unmapped_share(t, area), "spp", "land_all", "land_nonstat") == [("a", 8.0, None), ("b", 0.0, 0.0)]


def test_state_records(spark, rows):
    r = spark.createDataFrame([("MA", "x", 1, 5.0, 1.0), ("MA", "x", 1, 5.0, 1.0), ("MA", "y", 1, 5.0, 1.0), ("MA", "y", 1, 6.0, 2.0)], "state string, taxa_format string, year int, tl_lb double, tl_mt double")
    assert rows(L.roll_up_state_records(r), "taxa_format", "tl_lb", "num_rec") == [("x", 5.0, 2), ("y", 11.0, 2)]


def test_catch_of_unknown_weight_is_present(spark, rows):
    hauls = spark.createDataFrame([("1", "r"), ("2", "r"), ("3", "r")], "haulid string, regionfact string")
    catch = spark.createDataFrame([("1", "a b_Atl", 5.0, 1.6, True), ("2", "a b_Atl", -9999.0, None, True)],
                                  "haulid string, sppocean string, wtcpue double, logwtcpue double, presfit boolean")
    got = rows(V.zero_fill_regional(catch, hauls), "haulid", "wtcpue", "logwtcpue", "presfit")
    assert got == [("1", 5.0, 1.6, True), ("2", None, None, True), ("3", 0.0, -10.0, False)]


@pytest.mark.parametrize("size", [100, 1])
def test_zero_fill_with_a_long_list(spark, rows, monkeypatch, size):
    monkeypatch.setattr(R, "LIST", size)
    hauls = spark.createDataFrame([(str(i),) for i in range(5)], "haulid string")
    catch = spark.createDataFrame([("0", "a", 1.0), ("0", "b", 2.0), ("3", "c", None)], "haulid string, spp string, wtcpue double")
    got = rows(V.zero_fill(catch, hauls), "haulid", "spp", "wtcpue", "pres2")
    caught = {("0", "a"): 1.0, ("0", "b"): 2.0, ("3", "c"): 0.0}
    assert got == sorted((str(i), s, caught.get((str(i), s), 0.0), (str(i), s) in caught) for i in range(5) for s in "abc")
