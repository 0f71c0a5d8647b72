"""Catalog tables derived from the driver's part table, all rows of it.

A library file for each part: title from its name, artist from its brand with case and accent
variants, album from its type. A playlist entry for each part, in ten kinds that each reach another
tier. A folder tree in which spellings differ and names collide.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import split_artists
from larkspur.operators.lineage import shared_dir
from larkspur.operators.match import index_entries, index_tracks


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


VIEWS = """
  SELECT p_partkey AS k, p_name, p_brand, p_type, p_size,
    CASE WHEN p_partkey % 10 = 9 THEN 'Untitled' ELSE p_name END AS title,
    CASE WHEN p_partkey % 7 = 3 THEN upper(p_brand) WHEN p_partkey % 7 = 5 THEN replace(p_brand, 'a', 'á') ELSE p_brand END AS artist,
    concat(p_brand, '/', p_type, ' (', CAST(1990 + p_partkey % 30 AS STRING), ')/', CAST(10 + p_partkey % 20 AS STRING), ' - ', p_name, ' part', CAST(p_partkey AS STRING), '.mp3') AS path,
    CASE p_partkey % 10 WHEN 1 THEN concat(p_name, ' (Live)') WHEN 5 THEN concat(p_name, ' tonight')
      WHEN 6 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) WHEN 7 THEN concat(split_part(p_name, ' ', 1), ' lost signal')
      WHEN 8 THEN CASE WHEN p_partkey % 40 = 18 THEN '!!!' ELSE concat('part', CAST(p_partkey AS STRING)) END WHEN 9 THEN 'zzz qqq' ELSE p_name END AS wanted,
    CASE WHEN p_partkey % 10 = 3 THEN 'Nobody Known' WHEN p_partkey % 10 = 4 OR p_partkey % 20 = 8 THEN ''
      WHEN p_partkey % 10 = 2 THEN concat('Guest Star; ', p_brand) ELSE p_brand END AS by_artist,
    CASE WHEN p_partkey % 10 IN (0, 1, 3) THEN p_type WHEN p_partkey % 10 = 4 THEN '' ELSE 'Other Album' END AS on_album,
    CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey * 1000 + 999 AS STRING) WHEN 1 THEN concat(CAST(p_partkey AS STRING), '.0') WHEN 2 THEN ''
      WHEN 3 THEN concat(' ', CAST(p_partkey * 500 AS STRING), ' ') WHEN 4 THEN concat('-', CAST(p_partkey * 700 AS STRING)) ELSE 'abc' END AS ms
  FROM part"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part with the columns of all derived tables (VIEWS is also the oracle's SQL)."""
    return spark.sql(VIEWS.replace("FROM part", "FROM {part}"), part=part(spark, sf_dir))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return index_tracks(c.select("path", "title", F.array("artist").alias("artists"), F.col("p_type").alias("album"), F.substring_index("path", "/", -1).alias("filename")))


def playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    cols = [F.col("k").alias("idx"), F.col("wanted").alias("track_name"), F.col("on_album").alias("album"), split_artists(F.col("by_artist")).alias("artists")]
    return index_entries(c.select(*cols, "ms"))


#: Files in albums, in folders of albums, and beside albums.
TREE = """
  SELECT rel, CAST(min(k) % 5 AS BIGINT) AS length, sha1(CAST(min(k) % 5 AS STRING)) AS digest FROM (
    SELECT k, concat(artist, '/', p_type, CASE WHEN k % 4 < 2 THEN '' ELSE ' (2001)' END, '/', p_name, '.mp3') AS rel FROM catalog
    UNION ALL SELECT k, concat(artist, '/', p_type, CASE WHEN k % 4 < 2 THEN '' ELSE ' (2001)' END, '/disc ', CAST(k % 2 AS STRING), '/', p_name, '.mp3') FROM catalog WHERE k % 6 = 0
    UNION ALL SELECT k, concat(artist, '/', p_name, '.mp3') FROM catalog WHERE k % 5 = 0
    UNION ALL SELECT k, concat(artist, '/', p_type, ' (box)/disc 1/', p_name, '.mp3') FROM catalog WHERE k % 9 = 0) AS t
  GROUP BY rel"""


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files (rel, length, digest) and folders (rel) of a tree with variant spellings."""
    files = spark.sql(TREE.replace("FROM catalog", "FROM {catalog}"), catalog=catalog(spark, sf_dir))
    parts = F.split("rel", "/")
    up_to = lambda n: files.where(F.size(parts) > n).select(F.array_join(F.slice(parts, 1, n), "/").alias("rel"))
    return files, up_to(1).union(up_to(2)).union(up_to(3)).distinct()


TAGS = """
  SELECT CASE k % 4 WHEN 0 THEN path WHEN 1 THEN concat(p_brand, '/', p_brand, ' - ', p_name, ' ', CAST(k AS STRING), '.mp3') WHEN 2 THEN concat(p_name, ' ', CAST(k AS STRING), '.mp3')
      ELSE concat(p_brand, '/', p_type, '/', p_name, ' ', CAST(k AS STRING), '.mp3') END AS path,
    CASE WHEN k % 3 = 0 THEN '' ELSE title END AS title, CASE WHEN k % 2 = 0 THEN p_brand ELSE '' END AS artist,
    CASE WHEN k % 5 = 0 THEN concat(p_brand, '; Guest') ELSE '' END AS album_artist, CASE WHEN k % 7 < 3 THEN '' ELSE p_type END AS album
  FROM catalog"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with gaps, and paths that fill some of them."""
    return spark.sql(TAGS.replace("FROM catalog", "FROM {catalog}"), catalog=catalog(spark, sf_dir))


#: A playlist table as lines of CSV: blanks before cells, quotes and line ends in cells, rows cut short, rows without a name.
CSV_HEADER = '  Track URI,Title, Track Name ,Album Name,Artist Name(s),Artist,Duration (ms),Added'
CSV = """
  SELECT k, concat('u', CAST(k AS STRING), ',none,', CASE WHEN k % 11 = 0 THEN '  ' WHEN k % 4 = 1 THEN concat('  "', p_name, ', ""', p_brand, repeat('"', 3)) WHEN k % 4 = 2 THEN concat('"', p_name, chr(10), 'x"')
    ELSE wanted END, CASE WHEN k % 7 = 0 THEN '' ELSE concat(', ', on_album, ',"', by_artist, '",no,', ms, ',2020') END) AS line FROM catalog"""


def csv_file(spark: SparkSession, sf_dir: str) -> str:
    """Writes the lines, in order of k, below the shared folder; the path."""
    rows = spark.sql(CSV.replace("FROM catalog", "FROM {catalog}"), catalog=catalog(spark, sf_dir))
    lines = rows.unionByName(spark.createDataFrame([(-1, CSV_HEADER)], "k bigint, line string")).coalesce(1).sortWithinPartitions("k")
    path = f"{shared_dir(spark)}/playlist-{uuid.uuid4().hex}"
    lines.select("line").write.text(path)
    return path


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming files with metadata: disc sets, missing genres and album artists in some."""
    k = F.col("k")
    return catalog(spark, sf_dir).select(
        F.concat(F.lit("in/"), k.cast("string"), F.lit(".mp3")).alias("path"), "artist", F.when(k % 3 == 0, F.col("p_brand")).otherwise(F.lit("")).alias("album_artist"),
        F.col("p_type").alias("album"), "title", F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Genre: "), (k % 3).cast("string"))).alias("genre"),
        (F.lit(1990) + k % 3).cast("int").alias("year"), F.col("p_size").cast("int").alias("track_no"), (k % 3).cast("int").alias("disc_no"), (k % 4).cast("int").alias("disc_total"), F.lit(".mp3").alias("ext"),
    )
