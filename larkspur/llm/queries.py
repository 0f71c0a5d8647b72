"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, fm, langid, lines, media, minhash, mixing, packing, rules, substring
from larkspur.llm.common import crc_mod, table

CAPACITY = 2048


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer(), CAPACITY)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.identify(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.media_columns(documents(spark, sf_dir))
    tail = F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)"))
    return m.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.aggregate("tensors", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["rgb"])).alias("tensor_bytes"),
        F.sha2(F.aggregate("tensors", F.lit(b""), lambda a, t: F.concat(a, t["rgb"])), 256).alias("tensor_sha256"),
    )


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(documents(spark, sf_dir), tokenizer(), limit=CAPACITY)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(documents(spark, sf_dir))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(documents(spark, sf_dir))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.array_join(F.transform("_removed", lambda x: x.cast("string")), ",")
    return d.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), removed.alias("removed_lines"), F.sha2("text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), crc_mod(F.col("doc_id"), 5) == 0
    machine = fm.train(docs, table(spark, sf_dir, "labels"), ~held)
    return fm.classify(docs, machine).select("doc_id", held.alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_minhash": op2_minhash,
    "op3_language": op3_language,
    "op4_media": op4_media,
    "op5_tokens": op5_tokens,
    "op6_substring": op6_substring,
    "op7_rules": op7_rules,
    "op8_mix": op8_mix,
    "op9_lines": op9_lines,
    "op10_quality": op10_quality,
    "pipeline": pipeline,
}

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS seen FROM sides UNION SELECT r.id, t.b FROM reach r JOIN sides t ON r.seen = t.a),
c AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
  w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS start, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i + 19], ' ')))) AS h FROM w WHERE len(ws) >= 20
), r AS (SELECT doc_id, start, (doc_id, start) > min((doc_id, start)) OVER (PARTITION BY h) AS again FROM g),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(start, start + 20)))) AS places FROM r WHERE again GROUP BY doc_id),
k AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(len(places), 0) AS n_removed,
    list_transform(list_filter(range(1, len(ws) + 1), lambda i: places IS NULL OR NOT list_contains(places, i)), lambda i: ws[i]) AS kept
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""

# Lines with equal sets of words are one set; another set can match one only from nine words on.
LINES = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i AS line, list_sort(list_distinct({WORDS.format("ls[i + 1]")})) AS ws FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d)
), s AS (
  SELECT row_number() OVER (ORDER BY ws) AS s, ws, len(ws) AS n, since FROM (SELECT ws, min((doc_id, line)) AS since FROM l WHERE len(ws) > 0 GROUP BY ws)
), w AS (SELECT s, n, unnest(ws) AS word FROM s WHERE n >= 9),
f AS (SELECT word, count(*) AS df FROM w GROUP BY word),
r AS (SELECT s, n, word, row_number() OVER (PARTITION BY s ORDER BY df, word) AS place FROM w JOIN f USING (word)),
p AS (SELECT s, n, word FROM r WHERE place <= n - (9 * n + 9) // 10 + 1),
c AS (SELECT DISTINCT a.s AS a, b.s AS b FROM p a JOIN p b ON a.word = b.word AND a.s <> b.s AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n),
m AS (
  SELECT x.s AS s, y.since AS since FROM c JOIN s x ON x.s = c.a JOIN s y ON y.s = c.b
  WHERE 19 * len(list_intersect(x.ws, y.ws)) >= 9 * (x.n + y.n)
  UNION ALL SELECT s, since FROM s
), e AS (SELECT s, min(since) AS since FROM m GROUP BY s),
g AS (
  SELECT doc_id, list_sort(list(line)) AS gone FROM l JOIN s USING (ws) JOIN e ON e.s = s.s WHERE e.since < (l.doc_id, l.line) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed_lines,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(array_to_string(list_transform(list_filter(range(len(ls)), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)), '')) END AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""

SQL: dict[str, str] = {"op2_minhash": NEAR, "op6_substring": SUBSTRING, "op8_mix": mixing.oracle(), "op9_lines": LINES}
