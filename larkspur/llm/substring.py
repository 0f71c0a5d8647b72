"""Removal of repeated passages: windows of 20 words that occur earlier in the corpus.

Every window has an anchor, the smallest hash among its eight-word parts; equal windows have equal
anchors at the same offset, and neighbouring windows mostly share theirs, so a text has about one
anchor for seven words. Equal windows at different places have anchors at different places, so the
count of an anchor's places is never below that of a window that has it.

The prefilter is a count-min sketch of anchors, of DEPTH rows. It is cut into blocks by the anchor's
hash; a block's rows are WIDTH counters wide, and there are as many blocks as the input's size asks for.
Each task sketches batches of documents: a batch's sketch of a block lists the cells that it touches in
both rows, with counts. A block adds up the sketches of all batches and answers each batch which of its
anchors have two or more in every row. The estimate is never too low, so no repeat is lost; and since a
batch asks once for an anchor, a passage that every document has is no larger group than another.

The second pass hashes only the windows that may repeat, to 96 bits. A task first settles repeats among
the windows of a batch, then sends one earliest place for each distinct window to the shard of its
anchor, which neighbouring windows share, or of its own hash where the sketch puts the anchor at OFTEN or
more, since a very common phrase may stand in as many different windows. Shards find the earliest place
of all. All steps sort arrays, no row is made for a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import U64, as_bytes, chunks, cut, drop, keyed, mix, per_text, prepare, tidy, tidy_group, window_hashes

WINDOW, PART = 20, 8
#: Counters in a row of a block, rows, and anchors for which a block is made (an eighth of a row's counters).
WIDTH, DEPTH, LOAD = 1 << 20, 2, 1 << 17
#: Bytes of text that have one anchor, about; it sizes the sketch and no result depends on it.
BYTES_PER_ANCHOR = 30
#: Anchors that a batch of documents gathers before it is sketched.
SKETCHED = 400_000
#: Windows that a task gathers before it settles and sends them; and windows of a shard.
FLUSH, SHARD = 600_000, 1_000_000
#: Places of an anchor from which its windows are dealt out by their own hashes.
OFTEN = 100_000


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor, and the place of the anchor in the text."""
    parts = window_hashes(words, PART)
    wide = WINDOW - PART + 1
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    # The leftmost minimum of each stretch, by doubling: a stretch of 13 is two overlapping ones of 8.
    best, at = parts, np.arange(len(parts))
    size = 1
    while size < wide:
        step = min(size, wide - size)
        m = len(best) - step
        right = best[step:] < best[:m]
        best, at = np.where(right, best[step:], best[:m]), np.where(right, at[step:], at[:m])
        size += step
    return best, at


def cells_of(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's counters in the two rows of its block. The block comes from other bits."""
    return (anchor & U64(WIDTH - 1)).astype(np.uint32), (mix(anchor ^ U64(0xA4093822299F31D0)) & U64(WIDTH - 1)).astype(np.uint32)


def sketches(own: DataFrame, blocks: int) -> DataFrame:
    """The sketches of batches, (batch, block, one, two, n: cells in both rows and counts), and beside
    them rows (batch, k, v, anchors) with the distinct anchors of each document of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32  # and the batch's place in the task
        docs: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def sketched() -> Iterator[pa.RecordBatch]:
            nonlocal docs, held, task
            every = np.sort(np.concatenate([a for _, _, a in docs]))
            new = np.ones(len(every), bool)
            new[1:] = every[1:] != every[:-1]
            at = np.flatnonzero(new)
            n = np.minimum(np.diff(np.append(at, len(every))), (1 << 16) - 1).astype(np.uint16)
            anchor = every[at]
            block = block_of(anchor, blocks)
            order = np.argsort(block, kind="stable")
            n, block = n[order], block[order]
            one, two = cells_of(anchor[order])
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            parts = list(zip(cuts[:-1], cuts[1:], strict=True))
            columns = [[task] * len(parts), [int(block[a]) for a, _ in parts], *[[x[a:z].tobytes() for a, z in parts] for x in (one, two, n)]]
            none = [None] * len(parts)
            yield made_sketch([*columns, none, none, none])
            for lo in range(0, len(docs), 5_000):
                some = docs[lo : lo + 5_000]
                none = [None] * len(some)
                yield made_sketch([[task] * len(some), *[none] * 4, [x[0] for x in some], [x[1] for x in some], [np.unique(x[2]).tobytes() for x in some]])
            docs, held, task = [], 0, task + 1

        for b in batches:
            keys, versions, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))
            for lo, hi in chunks(texts):
                for k, v, words in zip(keys[lo:hi], versions[lo:hi], per_text(texts[lo:hi]), strict=True):
                    anchor, at = anchors(words)
                    if len(anchor):
                        first = np.ones(len(at), bool)
                        first[1:] = at[1:] != at[:-1]
                        docs.append((k, v, anchor[first]))
                        held += int(first.sum())
                if held > SKETCHED:
                    yield from sketched()
        if docs:
            yield from sketched()

    return own.select("k", "v", "text").mapInArrow(tidy(run), SKETCH)


SKETCH = "batch bigint, block bigint, one binary, two binary, n binary, k bigint, v bigint, anchors binary"
SKETCH_TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64(), pa.binary()]


def made_sketch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SKETCH_TYPES, strict=True)], [x.split()[0] for x in SKETCH.split(", ")])


def block_of(anchor: np.ndarray, blocks: int) -> np.ndarray:
    return ((anchor >> U64(20)) % U64(blocks)).astype(np.int64)


def cell_keys(block: np.ndarray | int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A number for the cells of an anchor: anchors with the same cells have the same estimate."""
    return np.asarray(block).astype(U64) << U64(40) | one.astype(U64) << U64(20) | two.astype(U64)


def estimated(parts: DataFrame) -> DataFrame:
    """batch, hot, often: the cells of a batch that the merged sketch puts at two or more in both rows, and
    whether at OFTEN or more."""

    def merge(group: pa.Table) -> pa.Table:
        cells = [[np.frombuffer(x, np.uint32) for x in group.column(c).to_pylist()] for c in ("one", "two")]
        rows = np.zeros((DEPTH, WIDTH), np.int64)
        for k, m in enumerate(group.column("n").to_pylist()):
            for row, touched in zip(rows, cells, strict=True):
                np.add.at(row, touched[k], np.frombuffer(m, np.uint16))
        batch, hot, often = [], [], []
        for key, block, a, b in zip(group.column("batch").to_pylist(), group.column("block").to_pylist(), *cells, strict=True):
            n = np.minimum(rows[0][a], rows[1][b])
            some = np.flatnonzero(n >= 2)
            if len(some):
                batch.append(key)
                hot.append(cell_keys(block, a[some], b[some]).tobytes())
                often.append((n[some] >= OFTEN).astype(np.uint8).tobytes())
        return pa.table({"batch": pa.array(batch, pa.int64()), "hot": pa.array(hot, pa.binary()), "often": pa.array(often, pa.binary())})

    return parts.groupBy("block").applyInArrow(tidy_group(merge), "batch bigint, hot binary, often binary")


def repeated_anchors(owners: DataFrame, hot: DataFrame, blocks: int) -> DataFrame:
    """k, v, cells, often: the anchors of each document that may repeat. A batch's rows are bounded by SKETCHED."""

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        known, often, out = np.empty(0, U64), np.empty(0, np.uint8), ([], [], [], [])
        if right.num_rows:
            known = np.concatenate([np.frombuffer(x, U64) for x in right.column("hot").to_pylist()])
            often = np.concatenate([np.frombuffer(x, np.uint8) for x in right.column("often").to_pylist()])
            order = np.argsort(known)
            known, often = known[order], often[order]
        if len(known):
            for k, v, x in zip(left.column("k").to_pylist(), left.column("v").to_pylist(), left.column("anchors").to_pylist(), strict=True):
                own = np.frombuffer(x, U64)
                key = cell_keys(block_of(own, blocks), *cells_of(own))
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                mine = known[at] == key
                if mine.any():
                    for column, value in zip(out, (k, v, own[mine].tobytes(), often[at[mine]].tobytes()), strict=True):
                        column.append(value)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("k", "v", "cells", "often"), out, types, strict=True)})

    return owners.groupBy("batch").cogroup(hot.groupBy("batch")).applyInArrow(pick, "k bigint, v bigint, cells binary, often binary")


class Batch:
    """Windows on their way: what deals them out, their two hashes, document (k, v) and start."""

    def __init__(self, shards: int):
        self.shards, self.n = shards, 0
        self.lists: tuple[list, ...] = ([], [], [], [], [], [])

    def add(self, k: int, v: int, dealt: np.ndarray, hashes: np.ndarray, checks: np.ndarray, starts: np.ndarray) -> None:
        for column, x in zip(self.lists, (dealt, hashes, checks, np.full(len(starts), k), np.full(len(starts), v), starts), strict=True):
            column.append(x)
        self.n += len(starts)

    def settled(self) -> Iterator[tuple]:
        """Rows of SCHEMA: repeats within the batch have shard -1."""
        dealt, hashes, checks, k, v, starts = map(np.concatenate, self.lists)
        self.lists, self.n = ([], [], [], [], [], []), 0
        keep, again = earliest(hashes, checks, k, v, starts)
        yield from repeats(k[again], v[again], starts[again])
        shard = (mix(dealt[keep]) % U64(self.shards)).astype(np.int64)
        order = np.lexsort((starts[keep], v[keep], k[keep], shard))
        keep, shard = keep[order], shard[order]
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z > a:
                part = keep[a:z]
                yield int(shard[a]), None, None, hashes[part].tobytes(), checks[part].tobytes(), deltas(k[part]), deltas(v[part]), deltas(starts[part])


def deltas(x: np.ndarray) -> bytes:
    """Differences compress well: documents and starts come in runs."""
    return np.diff(x, prepend=0).astype(np.int64).tobytes()


def undo(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.int64))


def earliest(hashes: np.ndarray, checks: np.ndarray, k: np.ndarray, v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one earliest window for each pair of hashes, and of all windows that have an earlier equal."""
    order = np.lexsort((starts, v, k, checks, hashes))
    h, c = hashes[order], checks[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    later = (k[order] != k[head]) | (v[order] != v[head]) | (starts[order] != starts[head])
    return order[first], order[later]


def repeats(k: np.ndarray, v: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
    """Rows of shard -1 for windows to remove, one for each document."""
    if len(k):
        order = np.lexsort((starts, v, k))
        k, v, starts = k[order], v[order], starts[order]
        for part in np.split(np.arange(len(k)), np.flatnonzero((np.diff(k) != 0) | (np.diff(v) != 0)) + 1):
            yield -1, int(k[part[0]]), int(v[part[0]]), None, None, None, None, deltas(starts[part])


NAMES = ["shard", "k", "v", "hashes", "checks", "ks", "vs", "starts"]
SCHEMA = "shard int, k bigint, v bigint, hashes binary, checks binary, ks binary, vs binary, starts binary"
TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]


def made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


def candidates(texts: DataFrame, shards: int) -> DataFrame:
    """Windows whose anchors may repeat, from (k, v, text, cells, often), settled batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Batch(shards)
        for b in batches:
            keys, versions, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))
            hashed = (w for lo, hi in chunks(texts) for w in per_text(texts[lo:hi]))
            for k, v, words, cells, often in zip(keys, versions, hashed, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                anchor, _ = anchors(words)
                known = np.frombuffer(cells, U64)
                at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
                starts = np.flatnonzero(known[at] == anchor)
                if len(starts):
                    hashes = window_hashes(words, WINDOW)[starts]
                    dealt = np.where(np.frombuffer(often, np.uint8)[at[starts]] > 0, hashes, anchor[starts])
                    got.add(k, v, dealt, hashes, (window_hashes(mix(words), WINDOW)[starts] >> U64(32)).astype(np.uint32), starts)
                if got.n > FLUSH:
                    yield made(list(got.settled()))
        if got.n:
            yield made(list(got.settled()))

    return texts.select("k", "v", "text", "cells", "often").mapInArrow(tidy(run), SCHEMA)


def across(rows: DataFrame) -> DataFrame:
    """Windows that have an earlier equal in another batch: k, v, starts."""

    def merge(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_pylist() for c in ("hashes", "checks", "ks", "vs", "starts")}
        hashes, checks = (np.concatenate([np.frombuffer(x, t) for x in cols[c]]) for c, t in (("hashes", U64), ("checks", np.uint32)))
        k, v, starts = (np.concatenate([undo(x) for x in cols[c]]) for c in ("ks", "vs", "starts"))
        _, again = earliest(hashes, checks, k, v, starts)
        found = list(repeats(k[again], v[again], starts[again]))
        return pa.table({"k": pa.array([r[1] for r in found], pa.int64()), "v": pa.array([r[2] for r in found], pa.int64()), "starts": pa.array([r[7] for r in found], pa.binary())})

    return rows.select("shard", "hashes", "checks", "ks", "vs", "starts").groupBy("shard").applyInArrow(tidy_group(merge), "k bigint, v bigint, starts binary")


def removed_windows(own: DataFrame) -> DataFrame:
    """k, v, lists (of start deltas): the windows of each document of (k, v, text) that start earlier elsewhere."""
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (BYTES_PER_ANCHOR * LOAD)))
    parts = cut(sketches(own, blocks), "sketches")
    hot = estimated(parts.where(F.col("block").isNotNull()).select("batch", "block", "one", "two", "n"))
    mine = cut(repeated_anchors(parts.where(F.col("anchors").isNotNull()).select("batch", "k", "v", "anchors"), hot, blocks), "cells")
    drop(parts)
    # An anchor stands for about seven windows; shards are sized by that estimate.
    windows = 7 * (mine.agg(F.sum(F.octet_length("cells") / 8)).first()[0] or 0)
    found = cut(candidates(own.join(mine.hint("shuffle_hash"), ["k", "v"]), max(1, -int(-windows // SHARD))), "windows")
    drop(mine)
    inside = found.where("shard = -1").select("k", "v", "starts")
    both = inside.unionByName(across(found.where("shard >= 0")))
    out = cut(both.groupBy("k", "v").agg(F.collect_list("starts").alias("lists")), "repeats")
    drop(found)
    return out


def remaining(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept from (doc_id, text, list of starts or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [], [])
            for t, lists in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = t.split()
                n, gone, left = len(words), 0, words
                if lists:
                    mark = np.zeros(n + WINDOW + 1, np.int32)
                    for starts in map(undo, lists):
                        starts = np.unique(starts)
                        mark[starts] += 1
                        mark[starts + WINDOW] -= 1
                    off = np.cumsum(mark)[:n] > 0
                    gone, left = int(off.sum()), [w for w, x in zip(words, off.tolist(), strict=True) if not x]
                kept = b" ".join(left)
                for column, v in zip(out, (n, gone, hashlib.sha256(kept).hexdigest(), kept if gone else None), strict=True):
                    column.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns[:3], columns[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(tidy(run), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the new text where words went, else null).

    A word goes if a window of 20 words of its document covers it and also starts earlier: in a
    document of smaller id, or earlier in the same one. Windows are judged on the input. A null text
    has no words; texts of fewer than 20 words lose none. Null ids count as the largest. Rows that
    share an id, or have none, are documents of their own, in the order of their texts' digests; rows
    of equal id and text are one document, and each gets its result. Other columns are ignored; an
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    k, v, shared = keyed(docs)
    own = docs.select(k.alias("k"), v.alias("v"), "text").where(F.col("text").isNotNull())
    lists = removed_windows(own.dropDuplicates(["k", "v"]) if shared else own)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k.alias("k"), v.alias("v"), "text")
    # A row for each document that loses words: it grows with the input, so it is never broadcast.
    return remaining(rows.join(lists.hint("shuffle_hash"), ["k", "v"], "left").select("doc_id", "text", "lists"))
