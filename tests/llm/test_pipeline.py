"""The corpus pipeline, stage by stage, against plain Python on the smallest tables."""

import corpus_pipeline as p
from larkspur.llm import fm
from larkspur.llm.common import crc_mod
from pyspark.sql import functions as F

from tests.llm.test_operators import SF, brute_lines
from tests.llm.test_whole import brute_kept


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    machine = fm.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), crc_mod(F.col("doc_id"), 5) != 0)
    good = {r["doc_id"] for r in fm.classify(docs, machine).where("predicted = 1").collect()}
    stages = dict(p.STAGES)
    one = stages["quality classifier"](spark, docs, SF).persist()
    assert one.columns == names and {r["doc_id"] for r in one.collect()} == good
    two = stages["line dedup"](spark, one, SF).persist()
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    gone = brute_lines(before.items(), 0.9, 1)
    after = {r["doc_id"]: r["text"] for r in two.collect()}
    assert two.columns == names and after == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in before.items()}
    three = stages["near-dedup"](spark, two, SF).persist()
    ids = sorted(after)
    keep = {ids[i] for i in brute_kept([after[d] for d in ids], p.SIMILAR)}
    assert three.columns == names and {r["doc_id"] for r in three.collect()} == keep
    four = stages["mixing"](spark, three, SF).persist()
    times = {}
    for r in four.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert four.columns == names and set(times) <= keep and max(times.values()) <= 3
    five = stages["packing"](spark, four, SF)
    assert {r["doc_id"] for r in five.collect()} == set(times)
    got = p.run(spark, SF).groupBy("doc_id").agg(F.countDistinct("piece"), F.count("*")).collect()
    assert {r["doc_id"] for r in got} == set(times)


def test_stages_keep_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "words of a document without an id", "en", None, 3), (1, "", None, "a", 0), (2, "same text in two rows of one id", "en", "a", 4), (2, "same text in two rows of one id", "en", "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(p.STAGES)
    for name in ("line dedup", "near-dedup"):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns and out.count() == len(rows), name
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.where("doc_id is null and text is null").count() >= 1
    assert stages["packing"](spark, docs, SF).count() == len(rows)
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
