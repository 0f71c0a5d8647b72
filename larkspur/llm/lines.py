"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity, estimated by one hashed counter array of
fixed size (any one order gives exact results). A line's prefix is the shortest head of that order
that any line with Jaccard similarity ``threshold`` or more must meet with its own prefix. Lines that
share a prefix word are candidates; length and positional filters thin them, their full sets decide.
A line goes if an earlier line is similar enough.

Equal sets are settled by grouping first, for lines of every length. A line so short that one word
more or less takes it below the threshold (fewer than nine words at 0.9) can only match an equal set, so
it has no prefix. The prefix words of the others are dealt out by shards, as arrays: a
line is first compared with the earliest line of each of its prefix words alone, which settles groups
of near copies of any size in linear work; lines still there are compared with all earlier lines that
the filters leave. A very frequent prefix word is dealt out by line length as well, since similar lines
have similar lengths, and lines of up to PAIRED words by a second word of their prefix: similar lines
share two words of prefixes that are one word longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import U64, as_bytes, chunks, cut, drop, keyed, mix, per_text, prepare, side, tidy, tidy_group, word_hashes

COUNTERS, BLOCK = 1 << 20, 1 << 12
#: Bytes of texts whose words are hashed and sorted at once; their arrays stay in a core's cache.
AT_ONCE = 1 << 18
THRESHOLD, MIN_WORDS = 0.9, 1
#: Prefix words of a shard; and occurrences from which a word is dealt out by length too.
SHARD, FREQUENT = 300_000, 100_000
#: Distinct words of lines that are dealt out by pairs of prefix words; longer ones are by one.
PAIRED = 64
#: Counter arrays of tasks that one task adds up.
STAGED = 200
LOG = 20

#: Words of more bytes are hashed by word_hashes; and masks of the first 0 to 8 bytes of a number.
BLOCKS = 64
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, each word's place in the texts joined by \\n, and
    the places of all \\n there, one after the last text included. A word is hashed eight bytes at a time,
    so the work goes by words, not by bytes."""
    size = sum(map(len, texts)) + len(texts)
    joined = b"\n".join(texts) + b"\n" * (16 + -size % 8)  # whole numbers, also behind the last word
    b = np.frombuffer(joined, np.uint8)
    inside = (b != 0x20) & (b - np.uint8(0x09) > 0x0D - 0x09)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, length = edge[::2], edge[1::2] - edge[::2]
    numbers = np.frombuffer(joined, "<u8", len(joined) // 8)

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The bytes from ``at``, of which ``left`` are the word's, as a number of eight at most."""
        i, shift = at >> 3, (at & 7).astype(U64) << U64(3)
        return (numbers[i] >> shift | numbers[i + 1] << U64(1) << (U64(63) - shift)) & _HEAD[np.minimum(left, 8)]

    h = mix(eight(start, length) + length.astype(U64) * U64(0xD6E8FEB86659FD93))
    done, more = 8, np.flatnonzero((length > 8) & (length <= BLOCKS))
    while len(more):
        h[more] = mix(h[more] ^ eight(start[more] + done, length[more] - done))
        done += 8
        more = more[length[more] > done]
    long = np.flatnonzero(length > BLOCKS)
    if len(long):
        h[long] = word_hashes([joined[a:z] for a, z in zip(start[long].tolist(), (start + length)[long].tolist(), strict=True)])[0]
    return h, start, np.flatnonzero(b[:size] == 0x0A)


def rarity(docs: DataFrame) -> np.ndarray:
    """Logarithms of the counters of hashed words over all texts: COUNTERS numbers for any corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            texts = as_bytes(b.column(0))
            at = [(words_of(texts[lo:hi])[0] & U64(COUNTERS - 1)).astype(np.int64) for lo, hi in chunks(texts, AT_ONCE, 10_000)]
            if at:  # once a batch: each count goes through all counters
                total += np.bincount(np.concatenate(at), minlength=COUNTERS)
        rows = [[], [], []]
        for block in range(COUNTERS // BLOCK):
            own = total[block * BLOCK : (block + 1) * BLOCK]
            at = np.flatnonzero(own)
            if len(at):
                for column, v in zip(rows, (block, at.astype(np.uint16).tobytes(), own[at].tobytes()), strict=True):
                    column.append(v)
        if rows[0]:
            columns = [pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.binary(), pa.binary()), strict=True)]
            some = pa.array([TaskContext.get().partitionId() // STAGED] * len(rows[0]), pa.int32())
            yield pa.RecordBatch.from_arrays([some, *columns], ["some", "block", "at", "n"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for at, n in zip(group.column("at").to_pylist(), group.column("n").to_pylist(), strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        at = np.flatnonzero(total).astype(np.uint16)
        return pa.table({"block": group.column("block").slice(0, 1), "at": pa.array([at.tobytes()], pa.binary()), "n": pa.array([total[at].tobytes()], pa.binary())})

    schema = "block int, at binary, n binary"
    parts = docs.select("text").mapInArrow(tidy(run), f"some int, {schema}").groupBy("some", "block").applyInArrow(tidy_group(merge), schema)
    out = np.zeros(COUNTERS, np.int64)
    for r in parts.groupBy("block").applyInArrow(tidy_group(merge), schema).collect():  # COUNTERS / BLOCK rows at most
        out[r["block"] * BLOCK + np.frombuffer(r["at"], np.uint16).astype(np.int64)] = np.frombuffer(r["n"], np.int64)
    return np.minimum(np.log2(out + 1.0) * LOG, 1023).astype(np.uint16)


def prefix_sizes(n: np.ndarray, threshold: float) -> np.ndarray:
    """Words in the prefix of a line of n; 0 where no other set than an equal one is similar enough."""
    size = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    return np.where(n >= threshold * (n + 1) - 1e-9, size, 0)


def longer(size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Prefixes of one word more where there is one, for pairs of words."""
    return np.where(size > 0, np.minimum(size + 1, n), 0)


def line_sets(texts: list[bytes], rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line with a word its text and its place there; the lines' distinct words' hashes,
    rarest first, and each line's bounds in them."""
    h, place, breaks = words_of(texts)
    line = np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(place, breaks), prepend=0))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.searchsorted(breaks, np.cumsum(sizes) - sizes)
    key = rare[(h & U64(COUNTERS - 1)).astype(np.int64)].astype(U64) << U64(34) | h >> U64(30)
    # One sort where a line's number fits beside its words' order, else two.
    order = np.argsort(line.astype(U64) << U64(44) | key) if len(breaks) < 1 << 20 else np.lexsort((key, line))
    h, line = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[new], line[new]
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
    lines = line[starts]
    text = np.searchsorted(first, lines, side="right") - 1
    return text, lines - first[text], h, np.append(starts, len(h))


def line_table(own: DataFrame, rare: object, threshold: float, min_words: int) -> DataFrame:
    """k, v, line, n, hi, lo (a digest of the set), sig, prefix: a row for each line of ``min_words`` or more
    distinct words; the prefix, one word longer than single words need, is null where the same text has an equal set before, and empty where only
    equal sets can match. sig and gis count the
    words in 32 hashed classes, four bits each: two lines share no more words than the classes allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, versions, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), as_bytes(b.column(2))
            for lo, hi in chunks(texts, AT_ONCE):
                text, line, h, bounds = line_sets(texts[lo:hi], rare.value)
                n = np.diff(bounds)
                pick = np.flatnonzero(n >= min_words)
                if not len(pick):
                    continue
                one, two = (np.add.reduceat(mix(h ^ U64(x)), bounds[:-1])[pick].view(np.int64) for x in (0x243F6A8885A308D3, 0x13198A2E03707344))
                classes = np.bincount(np.repeat(np.arange(len(n)), n) * 32 + (h >> U64(20) & U64(31)).astype(np.int64), minlength=32 * len(n))
                classes = np.minimum(classes.reshape(-1, 32)[pick], 15).astype(np.uint8)
                sig, gis = (classes[:, ::2] | classes[:, 1::2] << 4).copy().view(np.int64).T
                text, line, n, start = text[pick], line[pick], n[pick], bounds[:-1][pick]
                order = np.lexsort((line, two, one, text))
                again = np.zeros(len(pick), bool)
                again[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
                size = np.where(again, 0, longer(prefix_sizes(n, threshold), n))
                offsets = np.concatenate([[0], np.cumsum(size)])
                values = h[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
                prefix = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)), mask=pa.array(again))
                columns = [pa.array(keys[lo:hi][text]), pa.array(versions[lo:hi][text]), pa.array(line.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(one), pa.array(two), pa.array(sig), pa.array(gis), prefix]
                yield pa.RecordBatch.from_arrays(columns, ["k", "v", "line", "n", "hi", "lo", "sig", "gis", "prefix"])

    return own.select("k", "v", "text").mapInArrow(tidy(run), "k bigint, v bigint, line int, n int, hi bigint, lo bigint, sig bigint, gis bigint, prefix array<bigint>")


PACKED = ["word", "k", "v", "line", "n", "pos", "open", "sig", "gis"]
TYPES = [U64, np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8, np.int64, np.int64]


def dealt(lines: DataFrame, rare: object, shards: int, threshold: float) -> DataFrame:
    """shard and packed arrays of prefix words, from (k, v, line, n, prefix, open, sig, gis)."""
    often = int(np.log2(FREQUENT) * LOG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            sizes = np.diff(lists.offsets.to_numpy())
            word = lists.flatten().to_numpy().view(U64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = b.column(3).to_numpy()
            single = pos < prefix_sizes(n.astype(np.int64), threshold)[of]
            frequent = rare.value[(word & U64(COUNTERS - 1)).astype(np.int64)] >= often
            # Places of single words, and pairs of which a word is frequent (the first place is the pair's).
            alone = single & (~frequent | (n[of] >= threshold * PAIRED) | (n[of] <= 1 / threshold**2))
            keys, at, hot = [word[alone]], [np.flatnonzero(alone)], [frequent[alone]]
            left, step = np.flatnonzero(n[of] <= PAIRED), 1
            while len(left):
                left = left[left + step < len(word)]
                left = left[of[left] == of[left + step]]
                some = left[(frequent[left] & single[left]) | (frequent[left + step] & single[left + step])]
                keys.append(mix(word[some] * U64(0x9E3779B97F4A7C15) + word[some + step]))
                at.append(some)
                hot.append(np.ones(len(some), bool))
                step += 1
            word, at, hot = np.concatenate(keys), np.concatenate(at), np.concatenate(hot)
            of, pos = of[at], pos[at]
            n = n[of]
            step = np.where(hot, np.floor(np.log(np.maximum(n, 1)) / -np.log(threshold)).astype(np.int64) + 1, 0).astype(U64)
            extra = np.flatnonzero(hot)
            rows = np.concatenate([np.arange(len(word)), extra])
            salt = np.concatenate([step, step[extra] + U64(1)])
            # From here a frequent word or pair is another one for each range of lengths.
            word, of, pos, n = mix(word[rows] + salt * U64(0xA0761D6478BD642F)), of[rows], pos[rows], n[rows]
            shard = (word % U64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            k, v, line, is_open, sig, gis = (b.column(c).to_numpy(zero_copy_only=False)[of] for c in (0, 1, 2, 5, 6, 7))
            values = [x.astype(t)[order] for x, t in zip((word, k, v, line, n, pos, is_open, sig, gis), TYPES, strict=True)]
            shard = shard[order]
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            parts = [(a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a]
            columns = [pa.array([int(shard[a]) for a, _ in parts], pa.int32())]
            columns += [pa.array([x[a:z].tobytes() for a, z in parts], pa.binary()) for x in values]
            yield pa.RecordBatch.from_arrays(columns, ["shard", *PACKED])

    schema = "shard int, " + ", ".join(f"{c} binary" for c in PACKED)
    return lines.select("k", "v", "line", "n", "prefix", "open", "sig", "gis").mapInArrow(tidy(run), schema)


def similar_enough(n: np.ndarray, pos: np.ndarray, sigs: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """The length, positional and class filters for pairs of places whose lines share a word."""
    nx, ny = n[x].astype(np.int64), n[y].astype(np.int64)
    need = np.ceil(threshold / (1 + threshold) * (nx + ny) - 1e-9)
    bound = 1 + np.minimum(pos[x], pos[y]) + np.minimum(nx - pos[x] - 1, ny - pos[y] - 1)
    ok = (np.minimum(nx, ny) >= threshold * np.maximum(nx, ny) - 1e-9) & (bound >= need)
    at = np.flatnonzero(ok)
    most, full = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for sig in sigs:
        bx, by = (sig[v[at]].copy().view(np.uint8).reshape(-1, 8) for v in (x, y))
        for cx, cy in ((bx & 15, by & 15), (bx >> 4, by >> 4)):
            full |= ((cx == 15) & (cy == 15)).any(axis=1)  # counts end at 15
            most += np.minimum(cx, cy).sum(axis=1, dtype=np.int64)
    ok[at] = full | (most >= need[at])
    return ok


PAIR = {"xk": pa.int64(), "xv": pa.int64(), "xl": pa.int32(), "yk": pa.int64(), "yv": pa.int64(), "yl": pa.int32()}


def paired(shards: DataFrame, threshold: float, heads: bool) -> DataFrame:
    """x (xk, xv, xl) and an earlier y (yk, yv, yl): with ``heads`` each line and the earliest of a
    prefix word, else each open line and all earlier lines."""

    def search(group: pa.Table) -> pa.Table:
        word, k, v, line, n, pos, is_open, *sigs = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in zip(PACKED, TYPES, strict=True))
        order = np.lexsort((line, v, k, word) if heads else (n, word))
        word, k, v, line, n, pos, is_open, *sigs = (x[order] for x in (word, k, v, line, n, pos, is_open, *sigs))
        same = np.ones(len(word), bool)
        same[1:] = word[1:] != word[:-1]
        if heads:
            head = np.flatnonzero(same)[np.cumsum(same) - 1]
            x = np.flatnonzero(head != np.arange(len(word)))
            x = x[similar_enough(n, pos, sigs, x, head[x], threshold)]
            pairs = [(x, head[x])]
        else:
            pairs, at, step = [], np.arange(len(word) - 1), 1
            while len(at):
                at = at[at + step < len(word)]
                at = at[(word[at] == word[at + step]) & (n[at] >= threshold * n[at + step] - 1e-9)]
                a, z = at, at + step
                later = (k[a] > k[z]) | ((k[a] == k[z]) & ((v[a] > v[z]) | ((v[a] == v[z]) & (line[a] > line[z]))))
                x, y = np.where(later, a, z), np.where(later, z, a)
                ok = np.flatnonzero(is_open[x] == 1)
                ok = ok[similar_enough(n, pos, sigs, x[ok], y[ok], threshold)]
                pairs.append((x[ok], y[ok]))
                step += 1
        x, y = (np.concatenate([p[i] for p in pairs]) if pairs else np.empty(0, np.int64) for i in (0, 1))
        ok = (k[x] != k[y]) | (v[x] != v[y]) | (line[x] != line[y])
        x, y = x[ok], y[ok]
        both = np.unique(np.stack([k[x], v[x], line[x].astype(np.int64), k[y], v[y], line[y].astype(np.int64)]), axis=1) if len(x) else np.empty((6, 0), np.int64)
        return pa.table({name: pa.array(row, pa.int64()).cast(t) for (name, t), row in zip(PAIR.items(), both, strict=True)})

    return shards.groupBy("shard").applyInArrow(tidy_group(search), "xk bigint, xv bigint, xl int, yk bigint, yv bigint, yl int").distinct()


def verified(own: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """k, v, line of the x whose full set is similar enough to that of its y."""
    ids = pairs.select(F.col("xk").alias("k"), F.col("xv").alias("v"), F.col("xl").alias("line")).union(pairs.select("yk", "yv", "yl")).distinct()
    wanted = cut(ids.groupBy("k", "v").agg(F.collect_list("line").alias("w")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, versions, texts, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist()
            for lo, hi in chunks(texts):
                rows = []
                for k, v, t, want in zip(keys[lo:hi], versions[lo:hi], texts[lo:hi], lists[lo:hi], strict=True):
                    cut_ = t.split(b"\n")
                    rows += [(k, v, j, cut_[j]) for j in want]
                sets = [np.unique(h).tobytes() for h in per_text([r[3] for r in rows])]
                types = (pa.int64(), pa.int64(), pa.int32())
                columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], ["k", "v", "line", "set"])

    some = own.join(side(wanted), ["k", "v"]).select("k", "v", "text", "w")
    sets = cut(some.mapInArrow(tidy(run), "k bigint, v bigint, line int, set binary"), "line-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(p, U64), np.frombuffer(q, U64)])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(same >= threshold * (len(both) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in range(3)], ["k", "v", "line"]).filter(pa.array(ok, pa.bool_()))

    px = sets.select(F.col("k").alias("xk"), F.col("v").alias("xv"), F.col("line").alias("xl"), F.col("set").alias("p"))
    py = sets.select(F.col("k").alias("yk"), F.col("v").alias("yv"), F.col("line").alias("yl"), F.col("set").alias("q"))
    both = pairs.join(px, ["xk", "xv", "xl"]).join(py, ["yk", "yv", "yl"]).select("xk", "xv", "xl", "p", "q")
    out = cut(both.mapInArrow(tidy(check), "k bigint, v bigint, line int").distinct(), "hit")
    drop(sets)
    drop(wanted)
    return out


def distinct_sets(table: DataFrame, shared: bool) -> tuple[DataFrame, DataFrame]:
    """The earliest line of each set (k, v, line, n, sig, gis, prefix), and k, v, line of all other lines,
    from line_table's rows. Where no ids are shared (v is one value), k alone tells documents apart."""
    # A text has one row with a prefix for each set, so the least document is the least line.
    place = F.struct("k", "v") if shared else F.col("k")
    own = table.where(F.col("prefix").isNotNull())
    # Written, so that the join deals both sides out itself and can split those of a very common line.
    least = cut(own.groupBy("hi", "lo").agg(F.min(place).alias("least")), "least", dictionary=False)
    first = F.col("first")
    rows = own.join(side(least), ["hi", "lo"]).withColumn("first", place == F.col("least"))
    # What only the first line of a set needs is null in the others.
    sets = cut(rows.select("k", "v", "line", "first", *[F.when(first, F.col(c)).alias(c) for c in ("n", "sig", "gis", "prefix")]), "sets", dictionary=False)
    drop(least)
    again = table.where(F.col("prefix").isNull()).select("k", "v", "line")
    gone = cut(again.unionByName(sets.where(~first).select("k", "v", "line")), "equal")
    return sets, gone


def later_matches(own: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, shared: bool = True) -> DataFrame:
    """k, v, line of every line that an earlier line matches; ``own`` has k and v (the document) and text,
    one row for each document; ``shared`` is whether documents may have the same k."""
    spark: SparkSession = own.sparkSession
    rare = spark.sparkContext.broadcast(rarity(own))  # COUNTERS numbers
    table = cut(line_table(own, rare, threshold, min_words), "lines", dictionary=False)
    reps, gone = distinct_sets(table, shared)
    drop(table)
    joined = reps.where(F.col("first") & (F.size("prefix") > 0)).drop("first")
    shards = max(1, -(-(joined.agg(F.sum(F.size("prefix"))).first()[0] or 0) // SHARD))
    star = cut(paired(dealt(joined.withColumn("open", F.lit(1)), rare, shards, threshold), threshold, heads=True), "star")
    hit = verified(own, star, threshold)
    drop(star)
    settled = side(hit).withColumn("_hit", F.lit(True))
    left = joined.join(settled, ["k", "v", "line"], "left").withColumn("open", F.col("_hit").isNull().cast("int"))
    rest = cut(paired(dealt(left, rare, shards, threshold), threshold, heads=False), "rest")
    drop(reps)
    again = verified(own, rest, threshold)
    drop(rest)
    return gone.unionByName(hit).unionByName(again).distinct()


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines numbered in ``removed``."""

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    # A lambda's variable is computed once; written out, the text would be split again for every line.
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), kept), F.lit(0))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text's later matches gone, and _n_lines, _n_removed, _removed.

    A line (cut at \\n) goes if an earlier line, in a document of smaller id or before it in its own,
    has a set of words with Jaccard similarity of ``threshold`` or more. Lines are judged on the input.
    Lines without words, or of fewer than ``min_words`` distinct ones, stay and match nothing. A null
    text stays null; a text that loses all lines becomes empty. Null ids count as the largest. Rows that
    share an id, or have none, are documents of their own, in the order of their texts' digests; rows of
    equal id and text are one document, and each gets its result. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    k, v, shared = keyed(docs)
    own = docs.select(k.alias("k"), v.alias("v"), "text").where(F.col("text").isNotNull())
    gone = later_matches(own.dropDuplicates(["k", "v"]) if shared else own, threshold, min_words, shared)
    lists = cut(gone.groupBy(F.col("k").alias("_k"), F.col("v").alias("_v")).agg(F.collect_set("line").alias("_removed")), "gone")
    # The row travels as one struct, so that no column of docs can clash with those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), k.alias("_key"), v.alias("_version"))
    # A row for each document that loses lines: it grows with the input, so it is never broadcast.
    out = rows.join(lists.hint("shuffle_hash"), (F.col("_key") == F.col("_k")) & (F.col("_version") == F.col("_v")), "left")
    old = F.col("_d.text")
    new = F.when(F.col("_removed").isNull(), old).otherwise(without_lines(old, F.col("_removed")))
    n_lines = F.coalesce(F.octet_length(old) - F.octet_length(F.replace(old, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    same = [new.alias(c) if c == "text" else F.col(f"_d.`{c}`").alias(c) for c in docs.columns]
    removed = F.coalesce(F.array_sort("_removed"), F.array().cast("array<int>"))
    return out.select(*same, n_lines.alias("_n_lines"), F.size(removed).alias("_n_removed"), removed.alias("_removed"))
