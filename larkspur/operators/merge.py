"""Consolidation: a plan that merges folders of one key into the canonical folder.

Artist folders of one key merge into its winner. An album below a loser goes to the winner's album of
its key, or moves as it is (the first such album then stands for its key); album folders of one key
below the winner merge too. A file whose place is taken is dropped if its content is the same, else
renamed to the first free "name (k).ext".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.paths import basename, extension, stem
from larkspur.operators.canonical import canonical, preference
from larkspur.operators.lineage import cut


def album_moves(artists: DataFrame, albums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders to merge: artist (from_dir, to_dir) and album (from_dir, to_dir, counted)."""
    won = canonical(artists, "key").select("key", F.col("dir").alias("to_dir"), F.col("on_disk").alias("winner"))
    both = artists.join(won, "key").select("key", F.col("on_disk").alias("artist"), F.col("dir").alias("from_dir"), "to_dir", "winner")
    lost = both.where("from_dir <> to_dir")
    a = albums.join(both.select(F.col("from_dir").alias("artist_dir"), F.col("key").alias("akey"), "to_dir", F.col("artist").alias("owner")), "artist_dir")
    own = F.col("artist_dir") == F.col("to_dir")
    # The winner's own albums come first; among losers the first folder by name.
    order = F.struct(F.when(own, 0).otherwise(1).alias("o"), F.when(own, F.lit("")).otherwise(F.col("artist_dir")).alias("d"), preference().alias("p"))
    home = a.groupBy("akey", F.col("key").alias("bkey")).agg(F.min(order).alias("h"))
    home = home.select("akey", "bkey", (F.col("h.o") == 0).alias("had"), F.col("h.p.name").alias("name"), F.col("h.p.at").alias("at"))
    m = a.join(home, (a["akey"] == home["akey"]) & (a["key"] == home["bkey"])).drop(home["akey"])
    to = F.concat("to_dir", F.lit("/"), "name")
    albums_to = m.select(F.col("dir").alias("from_dir"), to.alias("to_dir"), ((F.col("dir") != F.col("at")) | F.col("had")).alias("counted"))
    return lost.select("from_dir", "to_dir", "artist", "winner"), albums_to.where("from_dir <> to_dir")


def targets(files: DataFrame, artist_moves: DataFrame, albums_to: DataFrame, artist_depth: int = 0, album_depth: int = 1) -> DataFrame:
    """src, dest of all files (rel, length, digest) that a merge moves, of whatever type."""
    parts = F.split("rel", "/", -1)
    head = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    f = files.withColumns({"_artist": head(artist_depth + 1), "_album": F.when(F.size(parts) > album_depth + 1, head(album_depth + 1))})
    in_album = f.join(albums_to.withColumnRenamed("from_dir", "_album"), "_album")
    rest = lambda at: F.expr(f"substring(rel, char_length({at}) + 1)")
    one = in_album.select("rel", "length", "digest", F.concat("to_dir", rest("_album")).alias("dest"))
    loose = f.where(F.size(parts) == artist_depth + 2).join(artist_moves.withColumnRenamed("from_dir", "_artist"), "_artist")
    return one.unionByName(loose.select("rel", "length", "digest", F.concat("to_dir", rest("_artist")).alias("dest"))).withColumnRenamed("rel", "src")


def unique_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """src, dest, renamed: the j-th file by source that wants a taken name gets the j-th free number.

    ``taken`` has a column path. The numbers start at 2; a name's takers are numbered together.
    """
    split = lambda c: {"_dir": F.regexp_replace(c, r"[^/]*\z", ""), "_stem": stem(basename(c)), "_ext": extension(c)}
    w = wanted.withColumns(split(F.col("dest")))
    t = taken.withColumns(split(F.col("path"))).withColumn("_k", F.regexp_extract("_stem", r" \(([1-9][0-9]{0,8})\)\z", 1))
    t = t.where("_k <> ''").select("_dir", F.regexp_replace("_stem", r" \([1-9][0-9]{0,8}\)\z", "").alias("_stem"), "_ext", F.col("_k").cast("int").alias("_k"))
    used = t.groupBy("_dir", "_stem", "_ext").agg(F.collect_set("_k").alias("_used"))
    n = F.row_number().over(W.partitionBy("_dir", "_stem", "_ext").orderBy("src"))
    j = w.withColumn("_j", n).join(used, ["_dir", "_stem", "_ext"], "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    free = F.element_at(F.array_except(F.sequence(F.lit(2), F.col("_j") + F.size("_used") + 1), F.col("_used")), F.col("_j"))
    return j.select("src", "dest", F.concat("_dir", "_stem", F.lit(" ("), free.cast("string"), F.lit(")"), "_ext").alias("renamed"))


def merge_plan(files: DataFrame, moves: DataFrame) -> DataFrame:
    """src, dest, action (MERGE, DROP, RENAME) for (src, dest, length, digest) against all files.

    The file that stands at a place, or the first source that moves there, keeps it. Equal length and
    digest is the same content. Files that stay count as standing.
    """
    stay = files.select(F.col("rel").alias("dest"), F.col("length").alias("_l"), F.col("digest").alias("_d")).join(moves.select(F.col("src").alias("dest")), "dest", "left_anti")
    first = moves.groupBy("dest").agg(F.min(F.struct("src", "length", "digest")).alias("f"))
    m = moves.join(stay, "dest", "left").join(first, "dest")
    stands = F.col("_l").isNotNull()
    same = F.when(stands, (F.col("length") == F.col("_l")) & (F.col("digest") == F.col("_d"))).otherwise((F.col("length") == F.col("f.length")) & (F.col("digest") == F.col("f.digest")))
    action = F.when(~stands & (F.col("src") == F.col("f.src")), F.lit("MERGE")).when(same, F.lit("DROP")).otherwise(F.lit("RENAME"))
    p = m.select("src", "dest", action.alias("action"))
    names = stay.select(F.col("dest").alias("path")).unionByName(moves.select(F.col("dest").alias("path"))).distinct()
    renamed = unique_names(p.where("action = 'RENAME'").select("src", "dest"), names).select("src", F.col("renamed"))
    return p.join(renamed, "src", "left").select("src", F.coalesce("renamed", "dest").alias("dest"), "action")


def consolidate(artists: DataFrame, albums: DataFrame, files: DataFrame, artist_depth: int = 0, album_depth: int = 1) -> DataFrame:
    """The merge plan of a tree: folders as from sources.tree.folders, all files with rel, length, digest."""
    lost, albums_to = album_moves(artists, albums)
    return merge_plan(files, cut(targets(files, lost, albums_to, artist_depth, album_depth)))


def merge_summary(artist_moves: DataFrame, albums_to: DataFrame, plan: DataFrame) -> DataFrame:
    """consolidated, skipped, renamed_on_merge."""
    n = artist_moves.select(F.lit(1).alias("x")).unionByName(albums_to.where("counted").select(F.lit(1).alias("x"))).agg(F.count("*").alias("consolidated"))
    return n.crossJoin(plan.agg(F.count_if(F.col("action") == "DROP").alias("skipped"), F.count_if(F.col("action") == "RENAME").alias("renamed_on_merge")))  # two single rows


def content_duplicates(files: DataFrame) -> DataFrame:
    """Adds keep (the smallest id of equal length and digest) and is_duplicate to (id, length, digest)."""
    first = files.groupBy("length", "digest").agg(F.min("id").alias("keep"), F.count("*").alias("copies"))
    return files.join(first.where("copies > 1").drop("copies"), ["length", "digest"], "left").withColumn("is_duplicate", F.coalesce(F.col("id") != F.col("keep"), F.lit(False)))
