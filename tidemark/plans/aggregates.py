"""Grouped aggregates with strict and skipping missing-value rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import missing as M
from ..operators import describe as D
from ..operators import panel as P
from ..operators import relational as R
from .registry import VIEWS, query

VIEWS["v_li"] = """
    SELECT l_returnflag AS g, l_linestatus AS s, l_orderkey, l_linenumber, nullif(l_linenumber, 4) AS ln,
    CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS q, l_extendedprice AS p, l_discount AS disc,
    CAST(year(l_shipdate) AS INTEGER) AS yr, l_suppkey FROM lineitem"""


def _li(v):
    return v.table("lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("s"), "l_orderkey", "l_linenumber",
        F.nullif("l_linenumber", F.lit(4)).alias("ln"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("q"),
        F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("disc"), F.year("l_shipdate").alias("yr"), "l_suppkey",
    )


@query("e1_row_count", "SELECT g, s, count(*) AS n FROM v_li GROUP BY 1, 2")
def _(v):
    return _li(v).groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"))


@query("e2_distinct_with_null", """
    SELECT g, yr, count(DISTINCT ln) + max(CASE WHEN ln IS NULL THEN 1 ELSE 0 END) AS n, count(DISTINCT l_suppkey) AS supp FROM v_li GROUP BY 1, 2""")
def _(v):
    return _li(v).groupBy("g", "yr").agg(M.n_unique("ln").alias("n"), M.n_unique("l_suppkey").alias("supp"))


@query("e3_distinct_subset", """
    SELECT stockid, count(DISTINCT year) FILTER ("TB" IS NOT NULL) AS yrs_tb, count(DISTINCT year) FILTER ("ER" IS NOT NULL) AS yrs_er FROM v_assess GROUP BY 1""")
def _(v):
    return v.assess().groupBy("stockid").agg(
        M.n_unique_where(F.col("TB").isNotNull(), "year").alias("yrs_tb"), M.n_unique_where(F.col("ER").isNotNull(), "year").alias("yrs_er")
    )


@query("e4_skip_sum", """
    SELECT l_orderkey, coalesce(sum(q), 0) AS q FROM v_li GROUP BY 1""")
def _(v):
    return _li(v).groupBy("l_orderkey").agg(M.skip_sum("q").alias("q"))


@query("e5_strict_sum", """
    SELECT l_suppkey, yr, CASE WHEN count(*) = count(q) THEN sum(q) END AS q FROM v_li GROUP BY 1, 2""")
def _(v):
    return _li(v).groupBy("l_suppkey", "yr").agg(M.strict_sum("q").alias("q"))


@query("e6_skip_mean", "SELECT g, s, yr, avg(q) AS q, avg(p) AS p FROM v_li GROUP BY 1, 2, 3", fl="q p:4")
def _(v):
    return _li(v).groupBy("g", "s", "yr").agg(M.skip_mean("q").alias("q"), M.skip_mean("p").alias("p"))


@query("e7_strict_mean", """
    SELECT l_suppkey, yr, CASE WHEN count(*) = count(q) THEN avg(q) END AS q, avg(CAST(p > 50000 AS INTEGER)) AS freq FROM v_li GROUP BY 1, 2""", fl="q freq")
def _(v):
    return _li(v).groupBy("l_suppkey", "yr").agg(M.strict_mean("q").alias("q"), M.frequency(F.col("p") > 50000).alias("freq"))


@query("e8_min_max", "SELECT g, min(yr) AS lo, max(yr) AS hi, max(p) AS top FROM v_li GROUP BY 1")
def _(v):
    return _li(v).groupBy("g").agg(F.min("yr").alias("lo"), F.max("yr").alias("hi"), F.max("p").alias("top"))


@query("e9_min_subset", """
    SELECT l_suppkey, min(yr) FILTER (p > 95000) AS first_big FROM v_li GROUP BY 1""")
def _(v):
    return _li(v).groupBy("l_suppkey").agg(M.min_where(F.col("p") > 95000, "yr").alias("first_big"))


@query("e10_sample_sd", "SELECT g, s, stddev_samp(q) AS sd, avg(q) AS m FROM v_li GROUP BY 1, 2", fl="sd m")
def _(v):
    return _li(v).groupBy("g", "s").agg(F.stddev_samp("q").alias("sd"), F.avg("q").alias("m"))


@query("e11_weighted_mean", """
    SELECT l_suppkey, yr, CASE WHEN NOT coalesce(bool_or(w IS NULL OR (x IS NULL AND w <> 0)), false) AND sum(w) <> 0
    THEN sum(CASE WHEN w <> 0 THEN x * w END) / sum(w) END AS m, sum(CASE WHEN d <> 0 THEN p * d END) / nullif(sum(d), 0) AS neg
    FROM (SELECT *, CASE WHEN l_linenumber > 1 THEN p / 1000 END AS x, CAST(l_linenumber > 1 AS INTEGER) * disc AS w, disc - 0.02::DOUBLE AS d FROM v_li) GROUP BY 1, 2""",
       fl="m neg:3")
def _(v):
    d = _li(v).withColumns({
        "x": F.when(F.col("l_linenumber") > 1, F.col("p") / 1000), "w": (F.col("l_linenumber") > 1).cast("int") * F.col("disc"),
        "d": F.col("disc") - 0.02,
    })
    return d.groupBy("l_suppkey", "yr").agg(M.weighted_mean("x", "w").alias("m"), M.weighted_mean("p", "d").alias("neg"))


@query("e11_weighted_mean_logical", """
    SELECT sppocean, sum(CASE WHEN caught THEN lat END) / count(*) FILTER (caught) AS lat FROM
    (SELECT sppocean, lat, wtcpue > 30 AS caught FROM v_catch JOIN v_hauls USING (haulid)) GROUP BY 1""", fl="lat")
def _(v):
    j = R.merge(v.catch(), v.hauls().select("haulid", "lat"), by="haulid", nulls="drop")
    return j.groupBy("sppocean").agg(M.weighted_mean("lat", F.col("wtcpue") > 30).alias("lat"))


@query("e12_weighted_variance", """
    SELECT g, yr, CASE WHEN var >= 0 THEN sqrt(var) END AS sd, var FROM (SELECT g, yr, sum(q * (p - m) * (p - m)) / (sum(q) - 1) AS var
    FROM (SELECT *, sum(q * p) OVER u / sum(q) OVER u AS m FROM v_li WHERE q IS NOT NULL WINDOW u AS (PARTITION BY g, yr)) GROUP BY 1, 2)""", fl="sd:4 var:1")
def _(v):
    return P.weighted_variance(_li(v), ["g", "yr"], "p", "q").withColumn("sd", M.root(F.col("var")))


@query("e13_filtered_aggregate", """
    SELECT g, yr, coalesce(sum(q) FILTER (s = 'F'), 0) AS f, coalesce(sum(q) FILTER (s = 'O'), 0) AS o,
    CASE WHEN count(*) FILTER (s = 'F' AND q IS NULL) = 0 THEN sum(disc * q) FILTER (s = 'F') / nullif(sum(q) FILTER (s = 'F'), 0) END AS wm
    FROM v_li GROUP BY 1, 2""", fl="wm")
def _(v):
    return _li(v).groupBy("g", "yr").agg(
        M.skip_sum(F.when(F.col("s") == "F", F.col("q"))).alias("f"), M.skip_sum(F.when(F.col("s") == "O", F.col("q"))).alias("o"),
        M.weighted_mean("disc", "q", F.col("s") == "F").alias("wm"),
    )


@query("e14_any_present", """
    SELECT stockid, max(CASE WHEN "UdivUmsypref" IS NOT NULL THEN 1 ELSE 0 END) AS u_any FROM v_assess GROUP BY 1""")
def _(v):
    return v.assess().groupBy("stockid").agg(M.any_present("UdivUmsypref").alias("u_any"))


@query("e15_sum_or_mean", """
    SELECT state, taxa_format, year, CASE WHEN count(DISTINCT tl_lb) = 1 AND count(tl_lb) = count(*) THEN avg(tl_lb) ELSE coalesce(sum(tl_lb), 0) END AS tl_lb, count(*) AS num_rec
    FROM v_state_land GROUP BY 1, 2, 3""")
def _(v):
    return v.state_land().groupBy("state", "taxa_format", "year").agg(M.sum_or_mean("tl_lb").alias("tl_lb"), F.count(F.lit(1)).alias("num_rec"))


@query("e16_dependent_keys", """
    SELECT s_nationkey, n_name, r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def _(v):
    j = R.merge(v.table("supplier"), v.table("nation"), by_x="s_nationkey", by_y="n_nationkey")
    j = R.merge(j, v.table("region"), by_x="n_regionkey", by_y="r_regionkey")
    return j.groupBy("s_nationkey", "n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("e17_ratio", """
    SELECT g, yr, sum(q) FILTER (s = 'F') / nullif(sum(q), 0) AS share, CAST(count(DISTINCT l_suppkey) AS DOUBLE) / count(DISTINCT l_orderkey) AS per FROM v_li GROUP BY 1, 2""", fl="share per")
def _(v):
    return _li(v).groupBy("g", "yr").agg(
        M.share_where(F.col("s") == "F", "q").alias("share"),
        F.try_divide(F.count_distinct("l_suppkey").cast("double"), F.count_distinct("l_orderkey")).alias("per"),
    )


@query("e18_contingency", """
    SELECT yr, count(*) FILTER (g = 'A') AS "A", count(*) FILTER (g = 'N') AS "N", count(*) FILTER (g = 'R') AS "R" FROM v_li GROUP BY 1""")
def _(v):
    return D.contingency(_li(v), "yr", "g", ["A", "N", "R"])


@query("e19_global_true_count", """
    SELECT count(*) FILTER (q > 25) AS big, count(*) FILTER (disc > 0.05::DOUBLE) AS off FROM v_li""")
def _(v):
    return _li(v).agg(F.sum((F.col("q") > 25).cast("int")).alias("big"), F.sum((F.col("disc") > 0.05).cast("int")).alias("off"))


@query("e20_group_size_choice", """
    SELECT l_orderkey, CASE WHEN n > 1 AND any_q = 1 THEN wq WHEN n > 1 THEN NULL ELSE mq END AS v FROM
    (SELECT l_orderkey, count(*) AS n, max(CASE WHEN q IS NOT NULL THEN 1 ELSE 0 END) AS any_q, coalesce(sum(q * disc), 0) AS wq, max(q) AS mq FROM v_li GROUP BY 1)""", fl="v")
def _(v):
    n, some = F.count(F.lit(1)), M.any_present("q")
    return _li(v).groupBy("l_orderkey").agg(
        F.when((n > 1) & (some == 1), M.skip_sum(F.col("q") * F.col("disc"))).when(n > 1, F.lit(None)).otherwise(F.max("q")).alias("v")
    )


@query("e21_coverage_profile", """
    SELECT stockid, count(DISTINCT year) FILTER ("TB" IS NOT NULL) AS "yrs_TB", count(DISTINCT year) FILTER ("SSB" IS NOT NULL) AS "yrs_SSB",
    count(DISTINCT year) FILTER ("Ctouse" IS NOT NULL) AS "yrs_C", count(DISTINCT year) FILTER ("Utouse" IS NOT NULL) AS "yrs_U",
    count(DISTINCT year) FILTER ("ER" IS NOT NULL) AS "yrs_ER", min(year) AS min_yr, max(year) AS max_yr,
    min(year) FILTER ("TB" IS NOT NULL) AS "min_yr_TB", min(year) FILTER ("SSB" IS NOT NULL) AS "min_yr_SSB" FROM v_assess GROUP BY 1""")
def _(v):
    from ..operators.stocks import coverage_profile

    return coverage_profile(v.assess(), ["stockid"])


@query("e22_long_to_flags", """
    SELECT g, bool_or(avg_p < 53000) FILTER (yr = 1996) AS y96, bool_or(avg_p < 53000) FILTER (yr = 1999) AS y99 FROM
    (SELECT g, yr, avg(p) AS avg_p FROM v_li GROUP BY 1, 2) GROUP BY 1""")
def _(v):
    d = _li(v).groupBy("g", "yr").agg(F.avg("p").alias("avg_p"))
    low = F.col("avg_p") < 53000
    return d.groupBy("g").agg(F.max(F.when(F.col("yr") == 1996, low)).alias("y96"), F.max(F.when(F.col("yr") == 1999, low)).alias("y99"))


@query("b8_share_of_total", """
    SELECT g, yr, q, q / sum(q) OVER (PARTITION BY g) AS frac FROM (SELECT g, yr, coalesce(sum(q), 0) AS q FROM v_li GROUP BY 1, 2)""", fl="frac")
def _(v):
    d = _li(v).groupBy("g", "yr").agg(M.skip_sum("q").alias("q"))
    return P.share(d, "g", "q", "t", "frac").drop("t")
