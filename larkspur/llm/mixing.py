"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded digest. Pass k over a source gives a document the
virtual finish time (k * source size + words up to and including it) / target; all sources advance
alike in virtual time. The passes are range-sorted by finish time and cut where the running sum of
words reaches the total budget, the size of the whole input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import cut, keyed, n_words

#: Virtual time per bin of the running sum: 2^-16 of the mix.
BINS = 1 << 16
PASSES = 3
SEED = "larkspur-mix"


def shuffled(doc_id: Column, *more: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")), *[F.concat(F.lit(":"), c.cast("string")) for c in more]))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with _number, 0.. among those of equal (_source, _id, _v): counted by partition, summed over
    partitions, numbered within one, so that equal rows never meet in one task."""
    same = ["_source", "_id", "_v"]
    rows = cut(rows.withColumn("_part", F.spark_partition_id()), "parted")
    before = F.sum("_n").over(W.partitionBy(*same).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = rows.groupBy(*same, "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(before, F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"{c}2") for c in same], F.col("_part").alias("_part2"), "_start")
    inside = rows.withColumn("_at", F.row_number().over(W.partitionBy(*same, "_part").orderBy("size")) - 1)
    match = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in same] + [F.col("_part") == F.col("_part2")]
    return inside.join(starts, match).withColumn("_number", F.col("_start") + F.col("_at")).drop("_part", "_part2", "_start", "_at", *[f"{c}2" for c in same])


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, and the target as the exact quotient num / den.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; they share the sum of all sizes; a target
    stops at PASSES times its source. That is water-filling: with c = PASSES * size / weight, the
    sources below some level of c are full and the rest share what is left by weight. Sources of
    size 0 have target 0.
    """
    every = W.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_level = every.orderBy(F.col("level"), F.col("place")).rowsBetween(W.unboundedPreceding, -1)
    w = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long"))
        .withColumn("level", PASSES * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum(PASSES * F.col("source_size")).over(by_level), F.lit(0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
        .withColumn("holds", (F.col("total") - F.col("full")) <= F.col("level") * F.col("open"))
    )
    first = F.min(F.when(F.col("holds"), F.struct("level", "place", "full", "open"))).over(every)
    w = w.withColumn("cut", first)
    capped = F.struct("level", "place") < F.struct("cut.level", "cut.place")
    num = F.when(capped, PASSES * F.col("source_size")).otherwise((F.col("total") - F.col("cut.full")) * F.col("weight"))
    den = F.when(capped, F.lit(1).cast("long")).otherwise(F.col("cut.open"))
    w = w.withColumn("num", num.cast("long")).withColumn("den", den)
    return w.select("source", "source_size", (F.col("num") / F.col("den")).alias("target"))


def mix(docs: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns ``keep`` with size, source, source_size, target and copies (0 to 3) of every document.

    A null text has size 0. Documents of size 0 are taken once as they cost nothing. Null sources are
    one source, last in order. Rows that share an id, or have none, are documents of their own, shuffled
    by their texts' digests too; rows equal in source, id and text are numbered and shuffled by that
    number, so which of them is taken is open, but not how many. So rerun results agree, however the
    rows are stored. An empty table gives an empty result.
    """
    _, v, shared = keyed(docs)
    doc_id = F.col("doc_id")
    sized = docs.select(*keep, F.col("source").alias("_source"), n_words(F.col("text")).alias("size"), doc_id.alias("_id"), v.alias("_v"))
    key = shuffled(F.col("_id"), F.col("_v"), F.col("_number")) if shared else shuffled(F.col("_id"))
    sized = (numbered(sized) if shared else sized).withColumn("_key", key).drop("_id", "_v", "_number")
    sized = cut(sized.withColumn("_bucket", F.conv(F.substring("_key", 1, 5), 16, 10).cast("int")), "sizes")
    rows = sized.count()
    # Prefix sums over buckets of the digest: a source's rows never meet in one task.
    bits = max(0, min(20, (max(1, rows // 1_000) - 1).bit_length()))
    sized = sized.withColumn("_bucket", F.shiftright("_bucket", 20 - bits))
    parts = sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("n"))
    running = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    to = targets(parts.groupBy(F.col("_source").alias("source")).agg(F.sum("n").alias("source_size")))
    offsets = cut(
        before.join(to, F.col("_source").eqNullSafe(F.col("source"))).select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_before", "source_size", "target"),
        "offsets",
    )
    inside = W.partitionBy("_source", "_bucket").orderBy("_key")
    d = (
        sized.withColumn("_in", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_cum", F.col("_before") + F.col("_in"))
        .drop("_in", "_before", "_s", "_b", "_bucket")
    )
    finish = lambda k: F.try_divide(k * F.col("source_size") + F.col("_cum"), F.col("target"))
    d = cut(d.withColumn("_row", F.monotonically_increasing_id()), "queue")
    # Only passes near the cut need sorting: all sources end their target at time 1.
    queue = d.where("size > 0").select("_row", "_key", "size", F.posexplode(F.array(*[finish(k) for k in range(PASSES)])).alias("pass", "finish"))
    binned = queue.where("finish < 2").withColumn("bin", F.floor(F.col("finish") * BINS))
    bins = binned.groupBy("bin").agg(F.sum("size").alias("n"))
    budget = d.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # At most 2 * BINS rows; the running sum finds the one bin in which the budget runs out.
    at = bins.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    edge = at.where((F.col("before") <= budget) & (F.col("before") + F.col("n") > budget)).orderBy("bin").limit(1).collect()
    if edge:
        edge = edge[0]
        last = binned.where(F.col("bin") == edge["bin"])
        run = F.sum("size").over(W.orderBy("finish", "_key", "_row", "pass").rowsBetween(W.unboundedPreceding, W.currentRow))
        within = last.withColumn("run", run + edge["before"]).where(F.col("run") <= budget)
        extra = within.groupBy(F.col("_row").alias("_x")).agg(F.count("*").alias("_extra"))
        copies = sum((F.floor(finish(k) * BINS) < edge["bin"]).cast("int") for k in range(PASSES))
        d = d.join(extra, F.col("_row") == F.col("_x"), "left")
        copies = F.when(F.col("size") == 0, 1).otherwise(copies + F.coalesce("_extra", F.lit(0)))
    else:
        copies = F.when(F.col("size") == 0, 1).otherwise(sum((finish(k) < 2).cast("int") for k in range(PASSES)))
    return d.select(*keep, F.col("_source").alias("source"), "size", "source_size", "target", copies.cast("int").alias("copies"))


def oracle(copies_as: str = "taken") -> str:
    """The same mix as one DuckDB statement over the documents table."""
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    finish = "(k * source_size + cum) / target"
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST({words} AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sizes
), levels AS (SELECT *, CAST({PASSES} * source_size AS DOUBLE) / weight AS level FROM weighed
), filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum({PASSES} * source_size) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open_
  FROM levels
), cut AS (
  SELECT level AS cl, place AS cp, full_ AS cf, open_ AS co FROM filled WHERE total - full_ <= level * open_ ORDER BY level, place LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN (level, place) < (cl, cp) THEN CAST({PASSES} * source_size AS DOUBLE)
    ELSE CAST((total - cf) * weight AS DOUBLE) / co END AS target FROM filled, cut
), queued AS (
  SELECT s.doc_id, s.source, s.size, s.key, t.source_size, t.target,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT doc_id, key, size, k, CAST(k * source_size + cum AS DOUBLE) / target AS finish FROM queued, range({PASSES}) p(k) WHERE size > 0
), ran AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, key, k ROWS UNBOUNDED PRECEDING) AS run FROM passes
), taken AS (
  SELECT doc_id, count(*) AS n FROM ran WHERE run <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(t.n, 0) AS BIGINT) AS {copies_as}
FROM queued q LEFT JOIN taken t USING (doc_id)"""
