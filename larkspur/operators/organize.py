"""The move plan: where each source file goes, as a table; applying it is a separate step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import primary_artist, sanitize
from larkspur.operators.canonical import resolve
from larkspur.operators.layout import Layout, filename, folder_name


def move_plan(meta: DataFrame, of: Layout, artists: DataFrame, albums: DataFrame, existing: DataFrame, target: str = "", numbers: bool = True) -> DataFrame:
    """src, dest, action for metadata with ``path``.

    Actions: same (it is there already), exists (``existing`` has the path), duplicate (another source
    takes the place; the first by path does), move. ``existing`` has a column path.
    """
    lead = lambda c: F.when(primary_artist(F.col(c)) != "", primary_artist(F.col(c))).otherwise(F.col(c))
    m = meta.withColumns({"artist": lead("artist"), "album_artist": lead("album_artist")}).withColumnRenamed("path", "src")
    parts = of.parts()
    by_kind = {k: (raw, suffix) for k, raw, suffix in parts}
    m = m.withColumn("name", sanitize(filename(of, numbers)))
    names = {k: folder_name(raw, suffix) for k, (raw, suffix) in by_kind.items()}
    for kind, c in names.items():
        m = m.withColumn(f"_{kind}", c)
    if "artist" in by_kind:
        raw, _ = by_kind["artist"]
        album, suffix = by_kind["album"]
        inner = m.withColumns({"_raw": raw, "_alb": album, "suffix": suffix})
        keys = inner.select("src", F.col("_raw").alias("artist"), F.col("_alb").alias("album"), "suffix")
        found = resolve(keys, artists, albums).select("src", "artist_folder", "album_folder")
        m = m.join(found, "src").withColumns({"_artist": F.col("artist_folder"), "_album": F.col("album_folder")})
    dest = F.concat_ws("/", *([F.lit(target.rstrip("/"))] if target else []), *[F.col(f"_{k}") for k, _, _ in parts], "name")
    m = m.select("src", dest.alias("dest"))
    there = existing.select(F.col("path").alias("dest")).distinct().withColumn("_there", F.lit(True))
    first = m.where("src <> dest").groupBy("dest").agg(F.min("src").alias("_first"))
    p = m.join(there, "dest", "left").join(first, "dest", "left")
    action = (
        F.when(F.col("src") == F.col("dest"), F.lit("same")).when(F.col("_there"), F.lit("exists"))
        .when(F.col("src") == F.col("_first"), F.lit("move")).otherwise(F.lit("duplicate"))
    )
    return p.select("src", "dest", action.alias("action"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """total, moved, skipped."""
    moved = F.col("action") == "move"
    return plan.agg(F.count("*").alias("total"), F.count_if(moved).alias("moved"), F.count_if(~moved).alias("skipped"))
