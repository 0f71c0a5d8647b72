"""Queries on tables with a row for each track or entry broadcast nothing, whatever Spark takes their size for."""

import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
QUERIES = ["q_m3u_lines", "q_match_best", "q_match_misses", "q_match_summary", "q_match_union", "q_miss_reports", "q_tier_filename"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_broadcast(spark, name):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")  # any broadcast is larger, and fails
    try:
        assert driver.queries()[name](spark, SF).count() > 0
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
