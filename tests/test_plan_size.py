"""Spark's driver plans a query anew after each of its stages, so its memory grows with the exchanges of a plan."""

import pytest

import __spark_entry__ as driver
from larkspur.operators import lineage, match
from larkspur.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_match_misses", "q_match_summary"])
def test_few_exchanges(spark, monkeypatch, name):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return lineage.cut(df)

    for module in (match, queries):
        monkeypatch.setattr(module, "cut", cut)
    plans.append(driver.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and 0 < sum(p.count("- Exchange ") for p in plans) <= 90


def test_artist_links_equal_brute_force(spark):
    names = ["u2", "the", "the cure", "cure", "fay and the foxes", "foxes", "the foxes", "fay", "and the", "dora"]
    holds = lambda a, b: len(b) >= 5 and len(a) > len(b) and f" {b} " in f" {a} "
    left, right = spark.createDataFrame([(x,) for x in [*names, ""]], "artist string"), spark.createDataFrame([(x,) for x in [*names[:-1], ""]], "artist string")
    got = sorted(map(tuple, match.artist_links(left, right).collect()))
    assert got == sorted((a, b) for a in names for b in names[:-1] if a == b or holds(a, b) or holds(b, a))
