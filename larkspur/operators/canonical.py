"""Canonical folders: one spelling for each key, and where a file's artist and album belong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import album_key, all_caps, normalize, sanitize
from larkspur.operators.lineage import cut


def preference() -> Column:
    """Smallest first: more files, not all capitals, longer in bytes, then by name."""
    return F.struct((-F.col("file_count")).alias("files"), all_caps(F.col("on_disk")).alias("caps"), (-F.octet_length("on_disk")).alias("length"), F.col("on_disk").alias("name"), F.col("dir").alias("at"))


def canonical(folders: DataFrame, *key: str) -> DataFrame:
    """The winner of each key: key..., on_disk, dir, members."""
    best = folders.groupBy(*key).agg(F.min(preference()).alias("b"), F.count("*").alias("members"))
    return best.select(*key, F.col("b.name").alias("on_disk"), F.col("b.at").alias("dir"), "members")


def duplicate_groups(folders: DataFrame, *key: str) -> DataFrame:
    return canonical(folders, *key).where("members > 1")


def resolve(incoming: DataFrame, artists: DataFrame, albums: DataFrame) -> DataFrame:
    """Adds artist_folder and album_folder to (src, artist, album, suffix).

    An artist goes to the canonical folder of its key; a new key takes the spelling of its first file
    by source path. Albums likewise below their artist; a folder registers without its year, a tag is
    looked up as it is. Names without a key keep their own spelling.
    """
    # Normalized names feed several joins: they are computed once.
    own = cut(incoming.withColumn("_ak", normalize(F.col("artist"))))
    known = canonical(artists, "key").select(F.col("key").alias("_ak"), F.col("on_disk").alias("_known"), F.col("dir").alias("_dir"))
    plain = sanitize(F.col("artist"))
    new = own.where("_ak <> ''").groupBy("_ak").agg(F.min(F.struct("src", plain.alias("name"))).alias("f")).select("_ak", F.col("f.name").alias("_new"))
    a = own.join(known, "_ak", "left").join(new, "_ak", "left")
    a = a.withColumn("artist_folder", F.when(F.col("_ak") == "", plain).otherwise(F.coalesce("_known", "_new")))
    a = a.withColumn("_bk", normalize(F.col("album"))).withColumn("_plain", F.concat(sanitize(F.col("album")), F.col("suffix")))
    a = cut(a)
    below = albums.join(known.select(F.col("_dir").alias("artist_dir")).distinct(), "artist_dir", "left_semi")
    kept = canonical(below, "artist_key", "key").select(F.col("artist_key").alias("_ak"), F.col("key").alias("_bk"), F.col("on_disk").alias("_album"))
    first = a.withColumn("_bk", album_key(F.col("_plain"))).where("_bk <> ''").groupBy("_ak", "_bk")
    first = first.agg(F.min(F.struct("src", F.col("_plain").alias("name"))).alias("g")).select("_ak", "_bk", F.col("g.name").alias("_first"), F.col("g.src").alias("_since"))
    a = a.join(kept, ["_ak", "_bk"], "left").join(first, ["_ak", "_bk"], "left")
    registered = F.when(F.col("src") >= F.col("_since"), F.col("_first"))
    album = F.when(F.col("_bk") == "", F.col("_plain")).otherwise(F.coalesce("_album", registered, "_plain"))
    return a.withColumn("album_folder", album).drop("_ak", "_bk", "_known", "_dir", "_new", "_plain", "_album", "_first", "_since")
