"""The two programs: match a playlist with a library, organize a source tree into a target tree."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import console
from larkspur.config import OrganizeConfig, PlaylistConfig
from larkspur.functions import fixed
from larkspur.operators import match as m
from larkspur.operators.layout import organizer_metadata
from larkspur.operators.merge import album_moves, merge_plan, merge_summary, targets
from larkspur.operators.organize import move_plan, plan_summary
from larkspur.sinks.apply import apply_plan, remove_empty_dirs
from larkspur.sinks.playlist import miss_report, playlist_lines, write_playlist
from larkspur.sources.playlist import read_playlist
from larkspur.sources.tags import read_tags, scan_tags
from larkspur.sources.tree import audio_files, folders, heads, list_audio, list_tree


def match_playlist(spark: SparkSession, config: PlaylistConfig) -> dict:
    """Matches, writes the playlist unless it is a dry run, and returns counts, times and the report."""
    began = time.monotonic()
    console.progress("indexing")
    tracks = m.index_tracks(m.tagged_tracks(scan_tags(spark, config.source, config.recursive))).persist()
    entries = m.index_entries(read_playlist(spark, config.csv)).persist()
    tracks.count()
    indexed = time.monotonic()
    console.progress("matching")
    matched = m.match(entries, tracks).persist()
    counts = m.summary(matched).first().asDict()
    took = time.monotonic()
    if config.verbose:
        for r in matched.select("idx", "track_name", "path", "reason").orderBy("idx").toLocalIterator():
            console.line("MATCH" if r["path"] else "MISS", f"{r['track_name']} -> {r['path'] or 'none'} ({r['reason']})", "green" if r["path"] else "red")
    if not config.dry_run:
        write_playlist(playlist_lines(matched, tracks, config.prefix), config.output)
    report: list[str] = []
    if config.debug and counts["missing"]:
        lost = m.misses(matched)
        report = [r["report"] for r in miss_report(lost, m.near_misses(lost, tracks), tracks).orderBy("idx").toLocalIterator()]
    return counts | {"indexing": indexed - began, "matching": took - indexed, "report": report}


def tree_tables(spark: SparkSession, root: str, artist_depth: int, album_depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artist folders, album folders and all files (rel, length, digest) of a target tree."""
    tree = list_tree(spark, root).persist()
    artists, albums = folders(audio_files(tree), tree.where("is_dir"), artist_depth, album_depth)
    return artists, albums, tree


def contents_of(spark: SparkSession, root: str, tree: DataFrame) -> DataFrame:
    """rel, length, digest of all files; a digest is of the first bytes only."""
    return heads(tree.where("not is_dir").select("rel", "path", "length"), fixed.SAMPLE_BYTES)


def organize(spark: SparkSession, config: OrganizeConfig) -> dict:
    """Consolidates the target, then moves the source's files into it. Returns the counters."""
    of, out = config.layout, {"consolidated": 0, "skipped": 0, "renamed_on_merge": 0}
    artist_depth, album_depth = of.depth("artist"), of.depth("album")
    nested = artist_depth >= 0
    began = time.monotonic()
    if nested and config.consolidate:
        console.progress("consolidating")
        artists, albums, tree = tree_tables(spark, config.target, artist_depth, album_depth)
        lost, to = album_moves(artists, albums)
        files = contents_of(spark, config.target, tree) if tree.limit(1).count() else tree.select("rel", "length", F.lit("").alias("digest"))
        plan = merge_plan(files, targets(files, lost, to, artist_depth, album_depth)).persist()
        out |= merge_summary(lost, to, plan).first().asDict()
        if config.verbose or config.dry_run:
            moves = lost.select(F.lit("artist").alias("level"), "from_dir", "to_dir").unionByName(to.select(F.lit("album").alias("level"), "from_dir", "to_dir"))
            for r in moves.orderBy("from_dir").toLocalIterator():
                console.line(("DRY-RUN " if config.dry_run else "") + "CONSOLIDATE", f"{r['level']}: {r['from_dir']} -> {r['to_dir']}", "cyan")
        apply_plan(plan, config.target, config.dry_run, config.verbose)
        if not config.dry_run:
            for r in lost.select("from_dir").unionByName(to.select("from_dir")).toLocalIterator():
                remove_empty_dirs(f"{config.target}/{r['from_dir']}")
            remove_empty_dirs(config.target)
    tree = list_tree(spark, config.source, config.recursive, strict=True)
    files = audio_files(tree).select("path")
    total = files.count()
    if not total:
        return out | {"total": 0, "moved": 0, "errors": 0}
    consolidated = time.monotonic()
    console.progress("organizing")
    found = list_audio(spark, config.source, config.recursive)
    meta = organizer_metadata(read_tags(found.select(F.col("file").alias("path"), "file")))
    artists, albums, tree = tree_tables(spark, config.target, artist_depth, album_depth)
    existing = tree.where("not is_dir").select("path")
    plan = move_plan(meta, of, artists, albums, existing, config.target, config.track_numbers).persist()
    counts = plan_summary(plan).first().asDict()
    done = apply_plan(plan, "", config.dry_run, config.verbose)
    if not config.dry_run:
        remove_empty_dirs(config.source)
    return out | counts | {"moved": done["moved"], "skipped": out["skipped"] + counts["skipped"], "errors": done["errors"], "consolidating": consolidated - began, "organizing": time.monotonic() - consolidated}
