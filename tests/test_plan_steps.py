"""Spark's driver plans and describes a plan anew after each of its stages: no large plans, and no more of them for it."""

import pytest

import __spark_entry__ as driver
from larkspur.operators import lineage, match
from larkspur.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_match_summary", "q_match_misses", "q_match_best"])
def test_no_large_plan(spark, monkeypatch, name):
    plans = []
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString().count("- Exchange "))

    def cut(df):
        note(df)
        return lineage.cut(df)

    for module in (match, queries):
        monkeypatch.setattr(module, "cut", cut)
    note(driver.queries()[name](spark, SF))
    assert 0 < sum(plans) <= 78 and max(plans) <= 15 and len(plans) <= 12
