"""Helpers that the training-data operators share.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout. ``bytes.split()`` cuts exactly there, so the Python
stages take texts as UTF-8 bytes and never decode what they only hash.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text in one Arrow batch sent to Python; long texts then come in small batches.
BATCH_BYTES = 8 << 20
#: Entries of a worker's per-word memo. Words met early are the frequent ones; a full memo stays.
MEMO = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that those of very long texts stay small, and lets Spark
    delete a query's shuffle files when that query has ended: each step's result is a written table."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Tables that cut() has written and drop() has not deleted.
_WRITTEN: dict[str, SparkSession] = {}


def cut(df: DataFrame, name: str = "t", dictionary: bool = True) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends, work is not repeated.
    Columns of digests need no ``dictionary``: hardly a value comes twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    _WRITTEN[path] = spark
    return out


#: Rows, and bytes of its (compressed) files, of a side that may be broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 1 << 20


def side(table: DataFrame) -> DataFrame:
    """A table written by cut() as one side of a join: broadcast if its files and a count show that it
    is small, else the built side of a shuffled hash join, which leaves the other side (mostly texts) unsorted."""
    spark = table.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._larkspur_path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    small = size <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS
    return F.broadcast(table) if small else table.hint("shuffle_hash")


#: The place of a null doc_id in the order of documents.
LAST = (1 << 63) - 1


def shared_ids(docs: DataFrame) -> bool:
    """Whether rows share a doc_id or have none. Reads that column alone."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.count("*").alias("n"))
    return ids.where("k is null or n > 1").limit(1).count() > 0


def keyed(docs: DataFrame) -> tuple[Column, Column, bool]:
    """Columns k and v that tell documents apart and give their order, and whether ids are shared.

    k is doc_id, null last. v is 0 where every row has an id of its own; else it is a 64-bit digest of
    the text, so rows of one id (or of none) are documents of their own unless their texts are equal:
    those count as one document and get one result.
    """
    shared = shared_ids(docs)
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return k, (F.xxhash64(F.col("text")) if shared else F.lit(0).cast("long")), shared


def drop(df: DataFrame) -> None:
    """Deletes a table made by cut() that nothing reads any longer."""
    _delete(df.sparkSession, df._larkspur_path)
    _WRITTEN.pop(df._larkspur_path, None)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    """Results read their tables lazily, so what is left goes when the program ends."""
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def release() -> None:
    """Gives memory that a task has freed back to the system: workers live on and share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def tidy_group(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function for applyInArrow that releases memory after each group."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return fn(group)
        finally:
            release()

    return run


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(tidy(run), schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null as b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once, and a random value for each byte.
_SPAN = 1 << 20
_BYTE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_P = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _hash_span(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of some bytes that end in a blank."""
    if not _POWERS or len(_POWERS[0][0]) < len(b):
        _POWERS[:] = [_powers(max(_SPAN + 1, len(b)))]
    up, down = _POWERS[0]
    inside = ~_BLANK[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(b) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    total = np.cumsum(_BYTE[b] * up[: len(b)], dtype=U64)
    before = np.where(start > 0, total[start - 1], U64(0))
    return mix((total[end - 1] - before) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, each word's place in the joined texts, and the
    bounds of each text's words. A word's hash is a polynomial in its bytes' random values, so all are
    computed together. Very long texts are hashed in spans that end at a blank.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(sizes) - sizes
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, places, at = [], [], 0
    while at < len(b):
        end = min(at + _SPAN, len(b))
        if end < len(b):
            blanks = np.flatnonzero(_BLANK[b[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                later = np.flatnonzero(_BLANK[b[end:]])
                end = end + int(later[0]) + 1
        h, start = _hash_span(b[at:end])
        hashes.append(h)
        places.append(start + at)
        at = end
    h, place = (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, U64), np.empty(0, np.int64))
    return h, place, np.searchsorted(place, np.append(first, len(b)))


def per_text(texts: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text."""
    h, _, cuts = word_hashes(texts)
    return [h[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def chunks(texts: list[bytes], size: int = 1 << 20, most: int = 512) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, ``most`` texts at most."""
    lo = n = 0
    for i, t in enumerate(texts):
        if i > lo and (n + len(t) > size or i - lo >= most):
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, in order; empty with fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= _P
        h += words[i : i + n]
    return mix(h)


def rank_within(df: DataFrame, key: str, sizes: dict[int, int], order: list[Column], tie: str, name: str, rows_per_bucket: int = 1_000) -> DataFrame:
    """A rank 0.. within each ``key`` that never gathers a key's rows in one task.

    ``sizes`` has the rows of each key (few keys). A key's rows fall into hash buckets, as many as its
    size asks for; bucket sizes are aggregated, prefix-summed and joined back, and only a bucket's rows
    are numbered together. Rows equal in ``order`` are told apart by ``tie``, a number of the row, so
    that they spread over buckets too.
    """
    from pyspark.sql import Window as W

    spark = df.sparkSession
    many = [(int(k), max(1, -(-n // rows_per_bucket))) for k, n in sizes.items()]
    buckets = spark.createDataFrame(many, "_key long, _m long")  # a row for each key
    b = df.join(F.broadcast(buckets), F.col(key) == F.col("_key")).withColumn("_b", F.pmod(F.xxhash64(*order, F.col(tie)), F.col("_m"))).drop("_key", "_m")
    counts = b.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    start = (F.sum("_n").over(W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).alias("_s")
    starts = counts.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(start, F.lit(0)).alias("_s"))
    inside = F.row_number().over(W.partitionBy(key, "_b").orderBy(*order, tie)) - 1
    return (
        b.withColumn("_r", inside)
        .join(starts, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_kb")))
        .withColumn(name, (F.col("_s") + F.col("_r")).cast("long"))
        .drop("_b", "_r", "_s", "_k", "_kb", tie)
    )
