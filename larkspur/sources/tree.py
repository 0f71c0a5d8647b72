"""Directory trees as tables.

The driver lists the root alone; executors walk the folders in it, and read what is read of files, heads
and tags. So the file system has to be one that they share.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.paths import is_audio
from larkspur.functions.text import album_key, normalize
from larkspur.operators.lineage import cut


def _walk(root: str, recursive: bool, strict: bool) -> Iterator[tuple[str, str, bool, int]]:
    def failed(e: OSError) -> None:
        if strict:
            raise e

    for at, dirs, names in os.walk(root, onerror=failed):
        dirs.sort()
        rel = os.path.relpath(at, root).replace(os.sep, "/")
        prefix = "" if rel == "." else rel + "/"
        for d in dirs:
            yield prefix + d, os.path.join(at, d), True, 0
        for n in sorted(names):
            path = os.path.join(at, n)
            try:
                size = os.lstat(path).st_size
            except OSError:
                if strict:
                    raise
                continue
            yield prefix + n, path, False, size
        if not recursive:
            dirs.clear()


TREE = "rel string, path string, is_dir boolean, length bigint"


def list_tree(spark: SparkSession, root: str, recursive: bool = True, strict: bool = False) -> DataFrame:
    """rel, path, is_dir, length of all below ``root``, as it is now. ``strict`` raises on the first
    unreadable folder; otherwise it is left out, and a missing root is an empty table. Links to folders
    are not followed."""
    top = list(_walk(root, False, strict))
    here = spark.createDataFrame(top, TREE)
    inner = [(rel, path) for rel, path, is_dir, _ in top if is_dir and not os.path.islink(path)]
    if not recursive or not inner:
        return here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        names = [c.split()[0] for c in TREE.split(", ")]
        for b in batches:
            for rel, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = _walk(path, True, strict)
                while rows := [(f"{rel}/{r}", *rest) for r, *rest in islice(found, 10_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    spread = spark.createDataFrame(inner, "rel string, path string").repartition(min(len(inner), 1_000))
    return cut(here.unionByName(spread.mapInArrow(run, TREE)))


def audio_files(tree: DataFrame) -> DataFrame:
    return tree.where(~F.col("is_dir") & is_audio(F.col("rel")))


def list_audio(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """file, length of the audio files below ``root``, empty ones too; their contents are not read."""
    return audio_files(list_tree(spark, root, recursive)).select(F.col("path").alias("file"), "length")


def folders(files: DataFrame, dirs: DataFrame, artist_depth: int, album_depth: int) -> tuple[DataFrame, DataFrame]:
    """The artist and album folders of a tree, with their keys and audio file counts.

    ``files`` (rel) and ``dirs`` (rel) are relative paths; depths come from the layout, -1 for none.
    A file counts for its artist and its album folder if it lies directly in an album folder or in the
    artist folder itself; deeper ones do not count. Folders whose key is empty are left out.
    Artist folders: key, on_disk, dir, file_count; albums: artist_key, artist_on_disk, artist_dir, key,
    on_disk, dir, file_count.
    """
    parts = F.split("rel", "/", -1)
    head = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    part = lambda n: F.get(parts, F.lit(n))
    depth = F.size(parts) - 1
    artists = dirs.where(depth == artist_depth).select(normalize(part(artist_depth)).alias("key"), part(artist_depth).alias("on_disk"), F.col("rel").alias("dir")).where("key <> ''")
    near = files.where((depth > artist_depth) & (depth <= album_depth + 1))
    # A name that stands under several parents is one artist: its files count for the first folder.
    counted = near.groupBy(part(artist_depth).alias("on_disk")).agg(F.count("*").alias("file_count"))
    first = artists.groupBy("on_disk").agg(F.min("dir").alias("dir")).join(counted, "on_disk")
    artists = artists.join(first, ["on_disk", "dir"], "left").select("key", "on_disk", "dir", F.coalesce("file_count", F.lit(0)).alias("file_count"))
    albums = dirs.where(depth == album_depth).select(
        part(artist_depth).alias("artist_on_disk"), head(artist_depth + 1).alias("artist_dir"), album_key(part(album_depth)).alias("key"), part(album_depth).alias("on_disk"), F.col("rel").alias("dir")
    ).where("key <> ''")
    in_album = files.where(depth == album_depth + 1).groupBy(head(album_depth + 1).alias("dir")).agg(F.count("*").alias("file_count"))
    owner = artists.groupBy("on_disk").agg(F.min("dir").alias("artist_dir_first"), F.min("key").alias("artist_key")).withColumnRenamed("on_disk", "artist_on_disk")
    albums = albums.join(owner, "artist_on_disk").join(in_album, "dir", "left")
    return artists, albums.select("artist_key", "artist_on_disk", F.col("artist_dir_first").alias("artist_dir"), "key", "on_disk", "dir", F.coalesce("file_count", F.lit(0)).alias("file_count"))


def fingerprint(content: Column, sample: int) -> Column:
    """SHA-1 of a content's first ``sample`` bytes."""
    return F.sha1(F.substring(content, 1, sample))


def heads(files: DataFrame, sample: int) -> DataFrame:
    """rel, length, digest of (rel, path, length): executors read the first ``sample`` bytes alone. A file
    that cannot be read has a null digest, so it equals none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests: list[str | None] = []
            for path in b.column(1).to_pylist():
                try:
                    with open(path, "rb") as f:
                        digests.append(hashlib.sha1(f.read(sample)).hexdigest())
                except OSError:
                    digests.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digests, pa.string())], ["rel", "length", "digest"])

    return files.select("rel", "path", "length").mapInArrow(run, "rel string, length bigint, digest string")
