"""Registered queries against their SQL at the smallest scale.

A cross-section runs by default; ALL_QUERIES=1 runs every one.  The full
comparison at sf0.01 is ``python tests/check_oracle.py``.
"""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SECTION = [
    "a1_read_csv", "a3_write_partitioned", "b10_convert", "c4_in_table_null", "c9_first_per_key", "c10_duplicates", "d4_right_join",
    "d6_combinations_within", "d10_point_in_polygon", "d11_points_of_polygon", "d14_spread_over_density", "e11_weighted_mean",
    "e15_sum_or_mean", "f8_row_lag_users", "f13_spatial_calendar_lag", "f15_lag_audit", "h4_append_missing", "i17_round_multiple",
    "j1_zero_fill", "j3_zero_fill_regional", "j10_latbin_summary", "j27_overfishing", "j38_landings_by_bin", "j43_unmapped_share",
    "k4_dummy_regression", "k9_manual_fixed_effects", "k20_kernel_density", "l3_five_numbers",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ALL_QUERIES") else SECTION)
def test_query(spark, con, name):
    _, err = compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert err is None, err


def test_every_oracle_belongs_to_a_query_and_binds(con):
    assert set(ORACLES) <= set(QUERIES)
    for sql in ORACLES.values():
        con.execute(f"DESCRIBE {sql}")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"lat_bin", "RAM_stockid", "spp", "year", "pres2", "wtcpuenal"} <= set(df.columns)
