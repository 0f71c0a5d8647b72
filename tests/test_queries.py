"""Every query with SQL against DuckDB on the smallest tables; the entry; the stream."""

import glob
import os

import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
LINKAGE = sorted(k for k in driver.oracle_sql() if k.startswith("q_"))


def canon(rows, names):
    at = [names.index(n) for n in sorted(names)]
    value = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    return sorted(tuple(value(r[i]) for i in at) for r in rows)


def expected(sql, sf_dir=SF):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = c.sql(sql)
    return canon(r.fetchall(), r.columns), sorted(r.columns)


@pytest.mark.parametrize("name", LINKAGE)
def test_against_sql(spark, name):
    df = driver.queries()[name](spark, SF)
    want, names = expected(driver.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert canon([tuple(r) for r in df.collect()], df.columns) == want


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_stream_equals_batch(spark, tmp_path):
    from larkspur.operators import match as m
    from larkspur.streaming.match import match_stream

    schema = "idx int, track_name string, artists array<string>, album string"
    one, two = [(1, "Sky", ["Ann"], "Blue")], [(2, "Sun", ["Bo"], "Red")]
    tracks = m.index_tracks(spark.createDataFrame([("a.mp3", "Sky", ["Ann"], "Blue", "a.mp3")], "path string, title string, artists array<string>, album string, filename string"))
    for rows in (one, two):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    q = match_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), tracks, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r["idx"]: r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "a.mp3", 2: None}
