"""Best-fit packing after Martello-Toth dominance reduction.

Only lengths matter to a packing, and there are at most ``capacity`` of them. So the driver gets the
histogram of piece lengths (at most ``capacity`` rows, whatever the input), solves the instance with
multiplicities, and gets a plan of runs: "the pieces of length L ranked a to b go to sequences
f, f+1, ..., m in each, from offset o". Executors then place every piece by its rank within its length.

The plan: lengths are tried once, from the longest on, as the first piece of a sequence, and fixed as
long as one set beside it dominates every other that fits: nothing where nothing fits; the largest
piece that fits, if it fills the sequence, if no two pieces fit, or if no three fit and it is as long as
the longest two that fit; those two, if no three fit, the larger of them is the largest piece that fits
and no other two both exceed the smaller one. A length for which none dominates is left; what is not
fixed goes by best fit, longest first. Sequences with equal content are kept as one group with a
count, so the plan's size depends on ``capacity``.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.bpe import MEMO, ODD, PRE, byte_symbols
from larkspur.llm.common import by_batch, cut, prepare, rank_within


class Encoder(dict):
    """word -> its ids as little-endian 32-bit bytes, a memo of bounded size.

    A pre-tokenized word by itself has the ids that it has in a text, so texts are cut into words by
    the tokenizer's pattern and only new words go through its model. Texts with characters or strings
    beyond that pattern's plain range go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.table = byte_symbols()

    def __missing__(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isprintable() else "".join(self.table[b] for b in word.encode())
        ids = array("I", [t.id for t in self.tokenize(mapped)]).tobytes()
        if len(self) < MEMO and len(word) <= 64:
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return self.whole(text) if ODD.search(text) else b"".join(map(self.__getitem__, PRE.findall(text.lower())))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids plus one id 0, cut at ``capacity``."""
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        e, out = encoder(tokenizer), ([], [], [], [], [])
        ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
        for doc_id, text in zip(ids, texts, strict=True):
            packed = e.ids(text) + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                piece = packed[at : at + 4 * capacity]
                for column, v in zip(out, (doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                    column.append(v)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return by_batch(both, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass
class Group:
    """``count`` sequences of equal content from ``first`` on, with ``room`` left in each."""

    first: int
    count: int
    room: int


@dataclass
class Plan:
    capacity: int
    #: (length, rank from, rank to, first sequence, pieces in each sequence, offset of the first piece)
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0


def dominant(length: int, left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """The lengths to put beside one piece of ``length`` so that no packing needs others, if there are such."""
    rest, room = {k: n - (k == length) for k, n in left.items() if n > (k == length)}, capacity - length
    fits = sorted(k for k in rest if k <= room)
    if not fits:
        return ()
    mate = fits[-1]
    least: list[int] = []
    for k in fits:
        least += [k] * min(rest[k], 3 - len(least))
    if mate == room or sum(least[:2]) > room or len(least) == 1:
        return (mate,)
    if len(least) == 3 and sum(least) <= room:
        return None
    # Two fit, three do not: the longest two.
    best, hi = (0, 0, 0), len(fits) - 1
    for low in fits:
        while hi >= 0 and (fits[hi] + low > room or (fits[hi] == low and rest[low] < 2)):
            hi -= 1
        if hi < 0 or fits[hi] < low:
            break
        best = max(best, (fits[hi] + low, fits[hi], low))
    _, a, b = best
    if mate >= a + b:
        return (mate,)
    if mate != a:
        return None
    between: list[int] = []
    for k in fits:
        if k > b and len(between) < 2:
            between += [k] * min(rest[k] - (k == a), 2 - len(between))
    return (a, b) if len(between) < 2 or sum(between) > room else None


def reduction(histogram: dict[int, int], capacity: int) -> Iterator[tuple[Counter, int]]:
    """Contents of sequences to fix, each with how many sequences get it."""
    left = dict(histogram)
    for length in sorted(histogram, reverse=True):
        while left[length] and (beside := dominant(length, left, capacity)) is not None:
            parts = Counter([length, *beside])
            n = min(left[k] // m for k, m in parts.items())
            for k, m in parts.items():
                left[k] -= n * m
            yield parts, n


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """Packs pieces given as {length: count} into sequences of ``capacity``."""
    plan, left, used = Plan(capacity), dict(histogram), dict.fromkeys(histogram, 0)

    def take(length: int, n: int, first: int, each: int, offset: int) -> None:
        plan.runs.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n
        left[length] -= n

    def opened(n: int) -> int:
        plan.sequences += n
        return plan.sequences - n

    for parts, n in reduction(histogram, capacity):
        first, offset = opened(n), 0
        for k, m in parts.items():
            take(k, n * m, first, m, offset)
            offset += k * m
        plan.fixed += n
    # Best fit, longest first, over groups of equal sequences keyed by their room.
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def add(g: Group) -> None:
        if g.count and g.room:
            if g.room not in by_room:
                by_room[g.room] = []
                bisect.insort(rooms, g.room)
            by_room[g.room].append(g)

    for length in sorted((k for k, n in left.items() if n), reverse=True):
        while left[length]:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, over = divmod(left[length], each)
                n = full + (over > 0)
                add(Group(opened(n), n, capacity))
                continue
            room = rooms[at]
            g = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            each = room // length
            full = min(g.count, left[length] // each)
            if full:
                take(length, full * each, g.first, each, capacity - room)
                add(Group(g.first, full, room - each * length))
            over = min(left[length], each - 1) if full < g.count else 0
            if over:
                take(length, over, g.first + full, over, capacity - room)
                add(Group(g.first + full, 1, room - over * length))
            add(Group(g.first + full + (over > 0), g.count - full - (over > 0), room))
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Packs the pieces of all documents into as few sequences of ``capacity`` ids as it can.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is a
    piece of one id (the final 0). Repeated rows and ids are packed as often as they occur, a null
    doc_id is kept, other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = cut(pieces(docs, tokenizer, capacity).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in own.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = solve(histogram, capacity)
    lengths = {k: ([], []) for k in histogram}
    for length, a, _, first, each, offset in plan.runs:
        lengths[length][0].append(a)
        lengths[length][1].append((first, each, offset))
    table = {k: (np.array(a, dtype=np.int64), np.array(v, dtype=np.int64)) for k, (a, v) in lengths.items()}
    shared = spark.sparkContext.broadcast(table)  # one row for a run; bounded by capacity, not by rows

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, cuts):
            n = int(length[rows[0]])
            starts, what = shared.value[n]
            run = np.searchsorted(starts, rank[rows], side="right") - 1
            q, (first, each, offset) = rank[rows] - starts[run], what[run].T
            seq[rows], off[rows] = first + q // each, offset + q % each * n
        return pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    ranked = rank_within(own, "length", histogram, [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_row", "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return by_batch(ranked, place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
