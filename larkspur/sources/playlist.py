"""Playlist tables from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import fixed
from larkspur.functions.text import seconds, split_artists, utrim


def resolve_headers(header: list[str | None]) -> dict[str, int]:
    """Field -> column place: case-blind, trimmed, by preference; of equal headers the last counts."""
    at = {(h or "").strip().lower(): i for i, h in enumerate(header)}
    found = {field: next((at[n] for n in names if n in at), -1) for field, names in fixed.HEADERS.items()}
    if found["track_name"] < 0:
        raise ValueError("csv header missing track name column")
    return found


def read_playlist(spark: SparkSession, path: str) -> DataFrame:
    """idx, uri, track_name, album, artists, release, duration of a CSV file.

    Quoted fields may hold newlines, rows may be ragged, leading space is dropped, rows without a track
    name are skipped; idx counts the accepted rows from 1 in file order. A file with newlines in quotes
    is one partition (a playlist is small), so its rows have an order.
    """
    raw = spark.read.csv(path, header=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, inferSchema=False)
    head = raw.first()
    if head is None:
        raise ValueError("read csv header: empty file")
    place = resolve_headers(list(head))
    cell = lambda f: utrim(F.coalesce(F.col(raw.columns[place[f]]), F.lit(""))) if place[f] >= 0 else F.lit("")
    rows = raw.withColumn("_line", F.monotonically_increasing_id()).where("_line > 0")
    rows = rows.select("_line", *[cell(f).alias(f) for f in fixed.HEADERS]).where("track_name <> ''")
    return rows.select(
        F.row_number().over(W.orderBy("_line")).alias("idx"), "uri", "track_name", "album", split_artists(F.col("artists")).alias("artists"), "release",
        seconds(F.col("duration")).cast("int").alias("duration"),
    )
