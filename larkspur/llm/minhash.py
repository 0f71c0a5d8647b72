"""Near-duplicate detection with min-max hashing.

A document's set holds its distinct shingles of five words. Each permutation of a signature keeps its
smallest and its largest value, so 120 values cost 60 hash evaluations; bands of five values (of fewer
for lower thresholds) are candidate keys. Links are confirmed on the full sets.

Documents with equal sets are one node. The members of a band's bucket are first compared with its two
extremes alone, which joins a group of near copies of any size in linear work. Buckets that still hold
several components are then searched in shards, for pairs across components that sizes, signature bits
and shared shingles leave possible: shingles that no other document of these buckets has bound what a
document can share, which rules out most of a group whose copies are edited too much. A bucket too large
for one task is dealt out in blocks, and each pair of blocks is a bucket of its own: the number of steps
does not depend on the size of a bucket. So each candidate pair is compared, ruled out or already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import U64, as_bytes, chunks, cut, drop, keyed, mix, per_text, prepare, side, tidy, tidy_group, window_hashes

WIDTH = 5
PERMUTATIONS = 60
#: Probabilities that a pair at the link threshold shares no band, and that its bits dismiss it.
MISS, DISMISS = 1e-6, 2e-8
#: Members of a bucket that one task may search, and members of a shard.
LIMIT, SHARD = 20_000, 200_000
#: In place of an id: a shingle that its batch has counted. And where ids of sets begin whose document has several.
SEEN, SETS = -(1 << 63), 1 << 62
_R = np.random.Generator(np.random.PCG64(20240601))
A = _R.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * U64(2) + U64(1)
B = _R.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
FLIP = _R.integers(1, 1 << 63, 2 * PERMUTATIONS, dtype=np.uint64) * U64(2) + U64(1)


def band_rows(percent: int) -> int:
    """The most signature values in a band with which a pair at the threshold is missed by MISS at most:
    five at 85 per cent (24 bands), four at 80 (30 bands)."""
    fits = [r for r in (5, 4, 3, 2) if (1 - (percent / 100) ** r) ** (2 * PERMUTATIONS // r) <= MISS]
    return fits[0] if fits else 1


def may_differ(percent: int) -> int:
    """Signature bits (of 120) that may differ before a pair is dismissed without its sets. At 85 per cent
    9 differ on average with a deviation of 2.9, and 28 may."""
    p, n = (1 - percent / 100) / 2, 2 * PERMUTATIONS
    tail, d = 0.0, n
    while d and tail + math.comb(n, d) * p**d * (1 - p) ** (n - d) <= DISMISS:
        tail += math.comb(n, d) * p**d * (1 - p) ** (n - d)
        d -= 1
    return d


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; fewer than WIDTH words are one shingle."""
    return [np.unique(window_hashes(w, min(WIDTH, len(w)))) if len(w) else w for w in per_text([t.lower() for t in texts])]  # bytes: only A-Z change


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest, then the largest values under the permutations."""
    low, high = np.full(PERMUTATIONS, ~U64(0)), np.zeros(PERMUTATIONS, U64)
    for at in range(0, len(s), 4096):
        v = A[:, None] * s[None, at : at + 4096] + B[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of each signature in a matrix; the band's number is part of the key."""
    bands = 2 * PERMUTATIONS // rows
    v = mix(sig).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (len(sig), bands)).copy()
    for k in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + v[:, :, k])
    return key


def bits_of(sig: np.ndarray) -> np.ndarray:
    """Two 64-bit words of one bit for each signature value, 120 in all."""
    one = ((sig * FLIP) >> U64(63)).astype(np.uint8)
    padded = np.zeros((len(sig), 128), np.uint8)
    padded[:, : sig.shape[1]] = one
    return np.packbits(padded, axis=1).view(np.int64)


def signatures(own: DataFrame, rows: int) -> DataFrame:
    """doc_id, v, n, fp (a digest of the set, null if empty), bands of ``rows`` values, s0, s1 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(2))
            for lo, hi in chunks(texts):
                sets = shingles(texts[lo:hi])
                sig = np.stack([signature(s) for s in sets])
                keys, bits = band_keys(sig, rows).view(np.int64), bits_of(sig)
                has = [len(s) > 0 for s in sets]
                bands = pa.array([k if ok else None for k, ok in zip(keys, has, strict=True)], pa.list_(pa.int64()))
                fp = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if ok else None for s, ok in zip(sets, has, strict=True)], pa.binary())
                columns = [b.column(0).slice(lo, len(sets)), b.column(1).slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), fp, bands, pa.array(bits[:, 0]), pa.array(bits[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "v", "n", "fp", "bands", "s0", "s1"])

    return own.select("doc_id", "v", "text").mapInArrow(tidy(run), "doc_id bigint, v bigint, n bigint, fp binary, bands array<bigint>, s0 bigint, s1 bigint")


def full_sets(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, set (sorted 64-bit hashes) of the documents of ``own`` (doc_id, v, text) in ``wanted`` (id, doc_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in chunks(texts):
                some = [x.tobytes() for x in shingles(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(some)), pa.array(some, pa.binary())], ["id", "set"])

    some = own.join(side(cut(wanted, "ids")), ["doc_id", "v"]).select("id", "text")
    return some.mapInArrow(tidy(run), "id bigint, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked))

    one = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a bigint, b bigint")


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """id, label (the smallest id reachable) of every id in ``links`` (a, b).

    Each round takes the smallest label next to a node, then follows labels once, which halves paths.
    ``start`` gives labels that are known to be reachable.
    """
    edges = cut(links.union(links.select("b", "a")).distinct(), "edges")
    ids = edges.select(F.col("a").alias("id")).distinct()
    if start is None:
        labels = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"))
    else:
        labels = ids.join(start, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    labels = cut(labels, "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        step = cut(step, "step")
        hop = step.select(F.col("id").alias("h"), F.col("label").alias("over"))
        new = step.join(hop, step["label"] == hop["h"], "left").select("id", F.least("label", F.coalesce("over", "label")).alias("label"), "was")
        new = cut(new, "labels")
        moved = new.where("label <> was").limit(1).count()
        drop(labels)
        drop(step)
        labels = new.select("id", "label")
        labels._larkspur_path = new._larkspur_path
        if not moved:
            drop(edges)
            return labels


def extremes(members: DataFrame) -> DataFrame:
    """bucket, lo, hi: the members with the smallest and the largest id of each bucket."""
    return members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))


def with_extremes(members: DataFrame, ends: DataFrame) -> DataFrame:
    """a < b: each member of a bucket with its extremes."""
    met = members.select("bucket", "id").join(ends, "bucket").select("id", F.explode(F.array("lo", "hi")).alias("c")).where("id <> c")
    return met.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def plausible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signature bits allow a link."""
    one = facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s0").alias("p0"), F.col("s1").alias("p1"))
    two = facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s0").alias("q0"), F.col("s1").alias("q1"))
    differ = F.bit_count(F.col("p0").bitwiseXOR(F.col("q0"))) + F.bit_count(F.col("p1").bitwiseXOR(F.col("q1")))
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(one, "a").join(two, "b").where(sized & (differ <= may_differ(percent))).select("a", "b")


def shareable(sets: DataFrame) -> DataFrame:
    """id, s: how many of a document's shingles (id, set) another of these documents has as well."""
    total = sets.agg(F.sum(F.octet_length("set"))).first()[0] or 0
    shards = max(1, -(-total // (8 * 4 * SHARD)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [np.frombuffer(x, U64) for x in b.column(1).to_pylist()]
            ids, h = np.repeat(b.column(0).to_numpy(), [len(x) for x in some]), np.concatenate(some)
            order = np.argsort(h)
            ids, h = ids[order], h[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            twin = ~first
            twin[:-1] |= twin[1:]
            # What the batch has twice is counted here; one row of it tells the shard, with id SEEN.
            own, n = np.unique(ids[twin], return_counts=True)
            ids = np.where(twin, SEEN, ids)[first]
            h = h[first]
            shard = (mix(h) % U64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            ids, h, shard = ids[order], h[order], shard[order]
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            parts = [(a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a]
            columns = [[int(shard[a]) for a, _ in parts] + [-1], [h[a:z].tobytes() for a, z in parts] + [n.tobytes()], [np.diff(ids[a:z], prepend=0).tobytes() for a, z in parts] + [np.diff(own, prepend=0).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "hashes", "ids"])

    def count(group: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, U64) for x in group.column("hashes").to_pylist()])
        ids = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in group.column("ids").to_pylist()])
        order = np.argsort(h)
        h, ids = h[order], ids[order]
        twin = np.zeros(len(h), bool)
        twin[1:] = h[1:] == h[:-1]
        twin[:-1] |= twin[1:]
        own, n = np.unique(ids[twin & (ids != SEEN)], return_counts=True)
        return pa.table({"id": pa.array(own, pa.int64()), "s": pa.array(n, pa.int64())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(np.frombuffer(ids, np.int64))), pa.array(np.frombuffer(n, np.int64))], ["id", "s"])

    dealt = cut(sets.mapInArrow(tidy(deal), "shard int, hashes binary, ids binary"), "shingles")
    inside = dealt.where("shard < 0").select("hashes", "ids").mapInArrow(tidy(counted), "id bigint, s bigint")
    over = dealt.where("shard >= 0").groupBy("shard").applyInArrow(tidy_group(count), "id bigint, s bigint")
    return inside.unionByName(over).groupBy("id").agg(F.sum("s").alias("s"))


def in_blocks(members: DataFrame) -> DataFrame:
    """Members (bucket, id, ...) with part: 0 in buckets that one task may search; a larger bucket is dealt
    out in blocks, and each pair of blocks is a bucket, in which only members of different parts are compared."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("_size")).where(F.col("_size") > LIMIT)
    sized = members.join(cut(sizes, "large"), "bucket", "left")
    small = sized.where("_size is null").drop("_size").withColumn("part", F.lit(0))
    blocks = F.ceil(2 * F.col("_size") / LIMIT).cast("int")
    large = sized.where("_size is not null").withColumn("_n", blocks).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    dealt = large.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pair = F.xxhash64("bucket", F.least("_own", "_other"), F.greatest("_own", "_other"))
    # A block paired with itself is a bucket of part 0, whose members are all compared.
    part = F.when(F.col("_own") == F.col("_other"), F.lit(0)).otherwise(F.col("_own") + 1)
    return small.unionByName(dealt.withColumn("part", part).withColumn("bucket", pair).drop("_size", "_n", "_own", "_other"))


def across(members: DataFrame, percent: int) -> DataFrame:
    """a < b: plausible pairs of a bucket's members that lie in different components, from
    (bucket, id, n, s, s0, s1, label, part) by shards of whole buckets."""
    names = ("bucket", "id", "n", "s", "s0", "s1", "label", "part")
    most_bits = may_differ(percent)

    def search(group: pa.Table) -> pa.Table:
        c = {x: group.column(x).to_numpy() for x in names}
        order = np.lexsort((c["n"], c["bucket"]))
        bucket, ids, n, s, s0, s1, label, part = (c[x][order] for x in names)
        found, at, step = [], np.arange(len(ids) - 1), 1
        while len(at):
            # Members are in order of size, so a pair too far apart ends its row.
            at = at[at + step < len(ids)]
            other = at + step
            at = at[(bucket[at] == bucket[other]) & (100 * n[at] >= percent * n[other])]
            other = at + step
            most = np.minimum(s[at], s[other])
            apart = (label[at] != label[other]) & ((part[at] != part[other]) | (part[at] == 0)) & (100 * most >= percent * (n[at] + n[other] - most))
            x, y = at[apart], other[apart]
            close = np.bitwise_count(s0[x] ^ s0[y]).astype(np.int64) + np.bitwise_count(s1[x] ^ s1[y]) <= most_bits
            found.append(np.stack([ids[x[close]], ids[y[close]]]))
            step += 1
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    shards = max(1, -(-members.count() // SHARD))
    sharded = members.withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(tidy_group(search), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, v, n_shingles, component_id, kept and first of every row.

    Documents whose sets have 100 * intersection >= ``percent`` * union are linked; component_id is the
    smallest doc_id reachable, kept marks it. A text without words (or null) has an empty set and is
    linked with nothing. Rows that share a doc_id are documents of their own unless their texts are
    equal (v tells them apart, see ``keyed``): a row of one id may go while another one of it stays. A
    row with a null doc_id is linked with nothing: its component is null and it is kept. first is kept,
    but for one text alone where several of the smallest doc_id are linked. Other columns are ignored;
    an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    _, v, shared = keyed(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), v.alias("v"), "text")
    once = own.dropDuplicates(["doc_id", "v"]) if shared else own
    sigs = cut(signatures(own, band_rows(percent)), "signatures")
    with_set = sigs.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    heads = with_set.groupBy("fp").agg(F.min(F.struct("doc_id", "v")).alias("h")).select("fp", "h.doc_id", "h.v")
    if shared:
        # A set has the number of its document, but where that has several sets.
        many = heads.groupBy("doc_id").agg(F.count("*").alias("_n"))
        number = F.when(F.col("_n") == 1, F.col("doc_id")).otherwise(F.lit(SETS) + F.xxhash64("fp").bitwiseAND(SETS - 1))
        heads = heads.join(many, "doc_id").select("fp", "doc_id", "v", number.alias("id"))
    else:
        heads = heads.withColumn("id", F.col("doc_id"))
    classes = cut(heads, "classes")
    nodes = classes.select("id", "doc_id", "v")
    reps = with_set.drop("doc_id", "v").join(classes.select("fp", "id"), "fp") if shared else with_set.join(classes, ["fp", "doc_id"])
    reps = reps.select("id", "n", "s0", "s1", "bands")
    reps = reps.dropDuplicates(["id"]) if shared else reps
    banded = reps.select("id", F.explode("bands").alias("bucket"))
    ends = cut(extremes(banded).where("lo < hi"), "ends")
    members = cut(banded.join(ends, "bucket", "left_semi").distinct(), "members")
    facts = cut(reps.join(members.select("id").distinct(), "id", "left_semi").select("id", "n", "s0", "s1"), "facts")
    links = labels = None

    def sets_of(ids: DataFrame) -> DataFrame:
        return cut(full_sets(once, ids.distinct().join(nodes, "id")), "sets")

    def link(pairs: DataFrame) -> None:
        nonlocal links, labels
        pairs = cut(pairs, "pairs")
        sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
        new = cut(confirmed(pairs, sets, percent), "links")
        drop(sets)
        drop(pairs)
        links = new if links is None else links.union(new)
        if new.limit(1).count():
            labels = components(links, labels)

    link(plausible(with_extremes(members, ends), facts, percent))
    # The extremes have been compared with all of their bucket. What is left is searched where buckets
    # lie in several components.
    left = members.join(ends, "bucket").where("id <> lo and id <> hi").select("bucket", "id")
    wide = left.withColumn("label", F.col("id")) if labels is None else left.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    wide = cut(wide.select("bucket", "id", "label"), "wide")
    drop(members)
    apart = wide.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
    open_ = cut(wide.join(apart, "bucket"), "open")
    drop(wide)
    sets = sets_of(open_.select("id"))
    shared_by = cut(shareable(sets), "shareable")
    drop(sets)
    could = open_.join(shared_by, "id").join(facts, "id").where(100 * F.col("s") >= percent * F.col("n"))
    link(across(cut(in_blocks(cut(could, "could")), "blocks"), percent))
    head = F.struct(F.col("doc_id").alias("d"), F.col("v").alias("u"))
    if labels is None:
        found = classes.select("fp", head.alias("head"))
    else:
        found = classes.join(labels, "id", "left").select("fp", F.coalesce("label", "id").alias("label"), head.alias("head"))
        found = found.join(found.groupBy("label").agg(F.min("head").alias("least")), "label").select("fp", F.col("least").alias("head"))
    out = sigs.select("doc_id", "v", "n", "fp").join(found, "fp", "left")
    known = F.col("doc_id").isNotNull()
    component = F.coalesce("head.d", "doc_id")
    first = ~known | F.col("head").isNull() | ((F.col("head.d") == F.col("doc_id")) & (F.col("head.u") == F.col("v")))
    return out.select("doc_id", "v", F.col("n").alias("n_shingles"), F.when(known, component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), first.alias("first"))
