"""The registered queries of the linkage library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import paths, text
from larkspur.functions.similarity import jaccard, shares_artist, word_aligned
from larkspur.operators import match as m
from larkspur.operators.canonical import canonical, resolve
from larkspur.operators.lineage import cut, joined
from larkspur.operators.layout import LAYOUTS, render
from larkspur.operators.merge import album_moves, consolidate, content_duplicates, merge_plan, merge_summary, targets, unique_names
from larkspur.operators.organize import move_plan, plan_summary
from larkspur.plans.fixtures import catalog, csv_file, library, metadata, playlist, tags, tree
from larkspur.sinks.playlist import miss_report, playlist_lines
from larkspur.sources.playlist import read_playlist
from larkspur.sources.tree import fingerprint, folders

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("id"), F.concat("wanted", F.lit(" - Remastered "), "artist").alias("t"))
    d = _docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("t"))
    return c.unionByName(d).select("id", text.normalize(F.col("t")).alias("norm"))


def split_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return c.select("k", F.array_join(text.split_artists(F.concat("by_artist", F.lit(" feat. "), "artist", F.lit("; "), "p_type")), "|").alias("artists"))


def primary_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("k", text.primary_artist(F.concat("by_artist", F.lit("/"), "p_type")).alias("artist"))


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.sanitize(F.col("url")).alias("name"), text.all_caps(F.col("url")).alias("caps"), text.without_year(F.concat("url", F.lit(" (1999) "))).alias("no_year"))


def tokens_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(_docs(spark, sf_dir).select("doc_id", text.tokens(text.normalize(F.col("text"))).alias("t")))
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return d.join(n, "doc_id").select("doc_id", F.size("t").alias("n_tokens"), F.round(jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"))


def word_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", text.normalize(F.col("text")).alias("a"))
    d = _docs(spark, sf_dir).select("doc_id", text.normalize(F.col("text")).alias("b"))
    return m.link_pairs(cut(b), cut(d), "a", "b").select("item_id", "doc_id")


def shares_artist_(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    own = text.normalize_all(text.split_artists(F.col("by_artist")))
    longer = F.array(text.normalize(F.concat("artist", F.lit(" and friends"))))
    return c.select("k", shares_artist(longer, own).alias("shared"), word_aligned(text.normalize(F.col("title")), text.normalize(F.col("wanted"))).alias("aligned"))


def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).select("path").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path"))).distinct()
    p = F.col("path")
    return c.select("path", paths.extension(p).alias("ext"), paths.is_audio(p).alias("audio"), paths.directory_artist(p).alias("artist"), paths.directory_album(p).alias("album"))


FILENAMES = """
  SELECT k, CASE k % 6 WHEN 0 THEN concat(artist, ' - ', title, '.mp3') WHEN 1 THEN concat(CAST(k % 100 AS STRING), ' - ', title, '.flac') WHEN 2 THEN concat(CAST(k % 100 AS STRING), '. ', title, '.ogg')
    WHEN 3 THEN concat(CAST(k % 100 AS STRING), ' ', title, '.m4a') WHEN 4 THEN concat(title, '.wav') ELSE concat(artist, ' - .mp3') END AS name FROM catalog"""


def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.sql(FILENAMES.replace("FROM catalog", "FROM {catalog}"), catalog=catalog(spark, sf_dir))
    return n.withColumn("p", paths.artist_and_title(F.col("name"))).select("k", "p.artist", "p.title")


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_playlist(spark, csv_file(spark, sf_dir))
    return p.select("idx", "uri", "track_name", "album", F.array_join("artists", "|").alias("artists"), "release", "duration")


def tag_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.tagged_tracks(tags(spark, sf_dir)).withColumn("artists", F.array_join("artists", "|"))


def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("k", text.seconds(F.col("ms")).alias("seconds"))


def _tier(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        entries, tracks = cut(playlist(spark, sf_dir)), cut(library(spark, sf_dir))
        keys = entries.where("norm_title <> ''").select(*m.KEY).distinct()
        won = m.best(m.TIERS[name](keys, tracks))
        return joined(entries, won, m.KEY).select("idx", "path", "score", F.coalesce("place", F.lit(-1)).alias("place"), F.round("overlap", 9).alias("overlap"))

    return run


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries, tracks = cut(playlist(spark, sf_dir)), cut(library(spark, sf_dir))
    return m.match(entries, tracks), tracks


def match_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[0].select("idx", "path", "score", "reason")


def match_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.match_union(cut(playlist(spark, sf_dir)), cut(library(spark, sf_dir))).select("idx", "path", "score", "reason")


def match_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.misses(_matched(spark, sf_dir)[0]).select("idx", "track_name", "reason")


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.summary(_matched(spark, sf_dir)[0])


def near_miss_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, tracks = cut(playlist(spark, sf_dir)), cut(library(spark, sf_dir))
    return m.near_misses(entries, tracks).withColumn("overlap", F.round("overlap", 9))


def miss_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, tracks = _matched(spark, sf_dir)
    lost = m.misses(matched)
    return miss_report(lost, m.near_misses(lost, tracks), tracks)


def m3u_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, tracks = _matched(spark, sf_dir)
    return playlist_lines(matched.withColumn("duration", text.seconds(F.col("ms"))), tracks, "/music/")


def _folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files, dirs = tree(spark, sf_dir)
    files = cut(files)
    artists, albums = folders(files, dirs, 0, 1)
    return cut(artists), cut(albums), files


def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists, albums, _ = _folders(spark, sf_dir)
    return artists.select("dir", "key", "file_count").unionByName(albums.select("dir", "key", "file_count"))


def canonical_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists, albums, _ = _folders(spark, sf_dir)
    a = canonical(artists, "key").select(F.lit("").alias("artist_dir"), "key", "on_disk", "members")
    return a.unionByName(canonical(albums, "artist_dir", "key").select("artist_dir", "key", "on_disk", "members"))


def resolve_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists, albums, _ = _folders(spark, sf_dir)
    known = F.col("key").contains("1")  # artists with a 2 to 5 alone are new
    c = catalog(spark, sf_dir)
    new = c.select(F.concat(F.lit("in/"), F.col("k").cast("string")).alias("src"), "artist", F.concat("p_type", F.when(F.col("k") % 3 == 0, F.lit(" Deluxe")).otherwise(F.lit(""))).alias("album"), F.lit(" (2005)").alias("suffix"))
    out = resolve(new, artists.where(known), albums.where(F.col("artist_key").contains("1")))
    return out.select("src", "artist_folder", "album_folder")


def _layout(name: str) -> Query:
    return lambda spark, sf_dir: render(metadata(spark, sf_dir), LAYOUTS[name]).select("path", "dest")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists, albums, files = _folders(spark, sf_dir)
    meta = metadata(spark, sf_dir)
    there = render(meta.where(F.col("path").contains("7")), LAYOUTS["artist-album-year"]).select(F.col("dest").alias("path"))
    return move_plan(meta, LAYOUTS["artist-album-year"], artists, albums, files.select(F.col("rel").alias("path")).unionByName(there))


def move_plan_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


def move_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_summary(_plan(spark, sf_dir))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = d.select(F.col("doc_id").alias("id"), F.octet_length("text").alias("length"), F.sha1(F.encode("text", "utf-8")).alias("digest"))
    return content_duplicates(own).select("id", "keep", "is_duplicate")


#: Bytes of a text that its fingerprint covers here; files have a longer head.
HEAD = 64


def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal length and head, doubled so that most are longer than the head."""
    d = _docs(spark, sf_dir).select("doc_id", F.encode(F.concat("text", "text"), "utf-8").alias("content"))
    own = d.select(F.col("doc_id").alias("id"), F.octet_length("content").alias("length"), fingerprint(F.col("content"), HEAD).alias("digest"))
    return content_duplicates(own).select("id", "digest", "keep", "is_duplicate")


WANTED = "SELECT concat('in/', CAST(k AS STRING)) AS src, concat('d/', p_brand, '/', p_name, '.mp3') AS dest FROM catalog"
TAKEN = "SELECT concat('d/', p_brand, '/', p_name, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN ' (2)' ELSE ' (4)' END, '.mp3') AS path FROM catalog GROUP BY 1"


def unique_names_(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    sql = lambda s: spark.sql(s.replace("FROM catalog", "FROM {catalog}"), catalog=c)
    return unique_names(sql(WANTED), sql(TAKEN)).select("src", "renamed")


def merge_plan_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(*_folders(spark, sf_dir))


def merge_summary_(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists, albums, files = _folders(spark, sf_dir)
    lost, to = album_moves(artists, albums)
    return merge_summary(lost, to, merge_plan(files, targets(files, lost, to)))


QUERIES: dict[str, Query] = {
    "q_normalize": normalize,
    "q_split_artists": split_artists,
    "q_primary_artist": primary_artist,
    "q_sanitize": sanitize,
    "q_tokens_jaccard": tokens_jaccard,
    "q_word_contains": word_contains,
    "q_shares_artist": shares_artist_,
    "q_path_parse": path_parse,
    "q_filename_parse": filename_parse,
    "q_csv_scan": csv_scan,
    "q_tag_fallbacks": tag_fallbacks,
    "q_duration_parse": duration_parse,
    **{f"q_tier_{t}": _tier(t) for t in m.TIERS},
    "q_match_best": match_best,
    "q_match_union": match_union,
    "q_match_misses": match_misses,
    "q_match_summary": match_summary,
    "q_near_miss_topk": near_miss_topk,
    "q_miss_reports": miss_reports,
    "q_m3u_lines": m3u_lines,
    "q_folder_counts": folder_counts,
    "q_canonical_group": canonical_group,
    "q_resolve_folder": resolve_folder,
    **{f"q_layout_{n.replace('-', '_')}": _layout(n) for n in LAYOUTS},
    "q_move_plan": move_plan_,
    "q_move_summary": move_summary,
    "q_content_dedup": content_dedup,
    "q_fingerprint_dedup": fingerprint_dedup,
    "q_unique_names": unique_names_,
    "q_merge_plan": merge_plan_,
    "q_merge_summary": merge_summary_,
}
