"""The corpus pipeline: quality classifier, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
documents. A stage's result is written as Parquet and read again as the next one's docs.

All stages judge rows, not ids: rows that share a doc_id, or have none, are documents of their own; rows
equal in id and text are one document, all of whose rows get its result. A null text counts as empty, and
rows keep their columns, whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import fm, lines, minhash, mixing, packing
from larkspur.llm.common import crc_mod, cut, keyed, shared_ids, table
from larkspur.llm.queries import CAPACITY, tokenizer

#: Per cent of Jaccard similarity from which the near-dedup stage links documents.
SIMILAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score below 0.3). Every row is scored by its own
    text; without labels of both kinds all have one score."""
    machine = fm.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return fm.select_good(docs, machine)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line matches. Rows stay, if need be with an empty text; ties between
    equal lines go to the smaller doc_id (null last), then to the smaller digest of the text."""
    return lines.dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near duplicates. Rows that share an id are
    judged by their own texts; rows without an id, or without words, stay."""
    groups = minhash.near_duplicates(docs, percent=SIMILAR)
    going = cut(groups.where(~F.col("first")).select(F.col("doc_id").alias("_id"), F.col("v").alias("_v")).distinct(), "going")
    _, v, _ = keyed(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), F.col("doc_id").cast("long").alias("_key"), v.alias("_version"))
    left = rows.join(going.hint("shuffle_hash"), (F.col("_key") == F.col("_id")) & (F.col("_version") == F.col("_v")), "left_anti")
    return left.select(*[F.col(f"_d.`{c}`").alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows repeat for sources below their target. Empty texts are
    taken once. Of rows equal in source, id and text, which differ in other columns, any may be taken."""
    shared = shared_ids(docs)
    place = F.monotonically_increasing_id() if shared else F.col("doc_id").cast("long")
    rows = docs.select(place.alias("_place"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    rows = cut(rows, "numbered") if shared else rows  # written, so that a row keeps its number
    mixed = mixing.mix(rows.select("_place", "_d.doc_id", "_d.text", "_d.source"), ["_place"])
    copies = cut(mixed.where("copies > 0").select("_place", F.col("copies").alias("_copies")), "copies")
    # A row for each document: it grows with the input, so it is never broadcast.
    taken = rows.join(copies.hint("shuffle_hash"), "_place").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*[F.col(f"_d.`{c}`").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences; an empty text is one id, a long one is cut into pieces."""
    return packing.pack(docs, tokenizer(), CAPACITY)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]
#: The classifier, signatures and the tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
