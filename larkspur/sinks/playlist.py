"""Extended M3U playlists."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import fixed
from larkspur.functions.text import normalize
from larkspur.operators.lineage import joined


def playlist_lines(matched: DataFrame, tracks: DataFrame, prefix: str = "") -> DataFrame:
    """idx, info, location of each match, in no order. ``matched`` has idx, path, track_name, duration."""
    t = tracks.select("path", "title", "artists")
    m = joined(matched.where(F.col("path").isNotNull()).select("idx", "path", "track_name", "duration"), t, "path")
    artist = F.coalesce(F.get("artists", F.lit(0)), F.lit(fixed.UNKNOWN_ARTIST))
    title = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.col("track_name")).otherwise(F.col("title"))
    info = F.concat(F.lit("#EXTINF:"), F.col("duration").cast("string"), F.lit(","), artist, F.lit(" - "), title)
    clean = prefix.rstrip("/")
    return m.select("idx", info.alias("info"), (F.concat(F.lit(f"{clean}/"), "path") if clean else F.col("path")).alias("location"))


def write_playlist(lines: DataFrame, path: str) -> None:
    """Writes the playlist in entry order; on failure no file is left. Rows pass the driver one
    partition at a time."""
    part = f"{path}.part"
    try:
        with open(part, "w", encoding="utf-8") as f:
            f.write("#EXTM3U\n")
            for r in lines.orderBy("idx").toLocalIterator():
                f.write(f"{r['info']}\n{r['location']}\n")
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise


def miss_report(missed: DataFrame, near: DataFrame, tracks: DataFrame) -> DataFrame:
    """idx, report: what was looked up for each miss, and its nearest tracks."""
    t = tracks.select("path", F.col("norm_title").alias("t"), F.array_join("norm_artists", ", ").alias("a"), F.col("norm_album").alias("b"))
    line = F.concat(
        F.lit("      ["), F.format_string("%.2f", F.bround("overlap", 2)), F.lit("] "), "path", F.lit(' | title="'), "t", F.lit('" artist="'), "a", F.lit('" album="'), "b", F.lit('"')
    )
    closest = joined(near, t, "path").groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("c"))
    artist = F.get("artists", F.lit(0))
    own = joined(missed, closest, "idx", "left")
    found = F.concat(F.lit(f"    {fixed.CLOSEST}\n"), F.array_join(F.transform("c", lambda x: x["line"]), "\n"))
    report = F.concat(
        F.lit("- "), "track_name", F.lit(" | "), F.coalesce(artist, F.lit("Unknown")), F.lit(" | "), "album",
        F.lit(f'\n    {fixed.LOOKED_UP} title="'), normalize(F.col("track_name")), F.lit('" artist="'), normalize(artist), F.lit('" album="'), normalize(F.col("album")), F.lit('"\n'),
        F.coalesce(found, F.lit(f"    {fixed.NONE_CLOSE}")),
    )
    return own.select("idx", report.alias("report"))
