"""Every query with an SQL twin must agree with it; ORACLE_SF picks the scale (0.001 by default)."""

import os

import pytest
from oracle import compare, duck

from panelspark.queries import all_queries, all_sql

SF = os.environ.get("ORACLE_SF", "0.001")
SF_DIR = f"/root/testdata/sf{SF}"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_matches_sql(spark, con, name):
    # at the smallest scale no two places lie within 20 km
    problem = compare(spark, con, SF_DIR, all_queries()[name], all_sql()[name], need_rows=SF != "0.001")
    assert problem is None, problem


@pytest.mark.parametrize("name", ["e1_power_law", "e4_noise_law", "g6_correlation_of_measures", "t4_stable_sample", "m3_hashed_split", "v12_indicator_panel", "x1_permutation_importance", "s16_model_save_load"])
def test_rows_only_query_gives_rows(spark, name):
    assert all_queries()[name](spark, SF_DIR).count() > 0
