"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1, a function of its code point alone. A trigram is the
element-wise product of its letters' vectors, the earlier ones rotated by 2 and 1 places; a text is
the sum of its trigrams; a language's prototype is the sum of its training texts. A text gets the
language whose prototype has the largest cosine with it.

Sums are exact integers, so neither order nor partitioning changes a prototype.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import mix, prepare, tidy

#: Texts handled at once, and code points at once; a longer text goes alone, slice by slice.
GROUP, SLICE = 256, 1 << 20


class Letters:
    """Symbols of a worker: 0 is any run of non-letters, others are letters met so far."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.reset()

    def reset(self) -> None:
        self.index = np.full(0x110000, -1, dtype=np.int32)
        self.vectors = [self.vector(0)]

    def vector(self, code: int) -> np.ndarray:
        words = np.arange(self.dim // 64, dtype=np.uint64) + np.uint64((code << 20) + self.seed * 7919)
        bits = np.unpackbits(mix(mix(words + np.uint64(1))).view(np.uint8))
        return bits.astype(np.int8) * 2 - 1

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        s = self.index[codes]
        if s.size and s.min() < 0:
            for c in np.unique(codes[s < 0]):
                if chr(c).isalpha():
                    self.index[c] = len(self.vectors)
                    self.vectors.append(self.vector(int(c)))
                else:
                    self.index[c] = 0
            s = self.index[codes]
        return s

    def grams(self, codes: np.ndarray, size: int) -> np.ndarray:
        """The vectors of trigrams given as numbers in base ``size``."""
        table = np.stack(self.vectors)
        a, b, c = codes // (size * size), codes // size % size, codes % size
        return np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]


def padded(text: str) -> str:
    """Each text stands between two gaps, so a single letter has a trigram too."""
    return f"\n{text.lower()}\n"


def solid(letters: Letters, low: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, code points and text of each place of padded texts, with one place for a run of gaps."""
    if len(letters.vectors) > 20_000:
        letters.reset()
    codes = np.frombuffer("".join(low).encode("utf-32-le"), dtype=np.uint32)
    s = letters.symbols(codes)
    row = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (row[1:] != row[:-1])
    return s[keep].astype(np.int64), codes[keep], row[keep]


def counted(letters: Letters, s: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A texts x trigrams matrix of counts, and the trigrams' vectors."""
    size = len(letters.vectors)
    gram = (s[:-2] * size + s[1:-1]) * size + s[2:]
    whole = (row[:-2] == row[2:]) if len(s) > 2 else np.zeros(0, bool)
    gram, row = gram[whole], row[:-2][whole]
    if size**3 <= 4_000_000:
        present = np.flatnonzero(np.bincount(gram, minlength=size**3))
        rank = np.zeros(size**3, np.int32)
        rank[present] = np.arange(len(present))
        at = rank[gram]
    else:
        present, at = np.unique(gram, return_inverse=True)
    counts = np.bincount(row * max(1, len(present)) + at, minlength=rows * len(present))
    return counts.reshape(rows, len(present)), letters.grams(present, size)


def slices(letters: Letters, low: str) -> Iterator[np.ndarray]:
    """The symbols of a long padded text, slice by slice: each begins with the last two places of the one
    before, so that every trigram is in one slice."""
    carried = ""
    for at in range(0, len(low), SLICE):
        s, codes, _ = solid(letters, [carried + low[at : at + SLICE]])
        yield s
        carried = codes[-2:].tobytes().decode("utf-32-le")


def bundled(letters: Letters, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of texts with the vectors of each, as exact integers."""
    for lo, hi in groups(texts):
        low = [padded(t) for t in texts[lo:hi]]
        if hi - lo == 1 and len(low[0]) > SLICE:
            total = np.zeros((1, letters.dim))
            for s in slices(letters, low[0]):
                c, v = counted(letters, s, np.zeros(len(s), np.int64), 1)
                total += c @ v.astype(np.float64)
            yield lo, hi, total
        else:
            s, _, row = solid(letters, low)
            c, v = counted(letters, s, row, hi - lo)
            # A text's sum is below 2^24 in a group, so single precision is exact.
            yield lo, hi, (c.astype(np.float32) @ v.astype(np.float32)).astype(np.float64)


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most GROUP texts and SLICE code points (or one text)."""
    lo = n = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= GROUP or n + len(t) > SLICE):
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def bundles(letters: Letters, texts: list[str]) -> np.ndarray:
    """The vector of every text, as float64 integers."""
    out = np.zeros((len(texts), letters.dim))
    for lo, hi, v in bundled(letters, texts):
        out[lo:hi] = v
    return out


def prototypes(docs: DataFrame, train: Column, dim: int, seed: int) -> DataFrame:
    """lang, vector: the exact sum of the training texts' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = Letters(dim, seed), {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for _, _, v in bundled(letters, own):
                    total[lang] = total.get(lang, 0) + v.sum(axis=0).astype(np.int64)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(v)], ["lang", "place", "v"])

    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = rows.mapInArrow(tidy(run), "lang string, place int, v bigint")
    sums = parts.groupBy("lang", "place").agg(F.sum("v").alias("v"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("vector"))


def identify(docs: DataFrame, train: Column, dim: int = 1024, seed: int = 1, max_languages: int = 10_000) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 at least) of every document.

    Learns from rows where ``train`` holds and lang and text are not null; predicts from text alone.
    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was
    learned. Ties go to the language first in order. Repeated rows give
    repeated results. ``max_languages`` bounds what is broadcast (dim numbers for each).
    """
    spark = docs.sparkSession
    prepare(spark)
    learned = sorted(prototypes(docs, train, dim, seed).limit(max_languages + 1).collect(), key=lambda r: r["lang"])
    if len(learned) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = [r["lang"] for r in learned]
    unit = np.array([r["vector"] for r in learned], dtype=np.float64).reshape(len(names), dim)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    shared = spark.sparkContext.broadcast((names, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = shared.value
        letters = Letters(dim, seed)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            v = bundles(letters, texts)
            size = np.linalg.norm(v, axis=1)
            cos = v @ unit.T / np.maximum(size, 1e-9)[:, None] if names else np.zeros((len(texts), 1))
            best = cos.argmax(axis=1)
            score = np.clip(cos[np.arange(len(texts)), best], 0, 1)
            known = size > 0
            pred = [names[k] if ok and names else "und" for k, ok in zip(best, known, strict=True)]
            out = [b.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, lang_pred string, score double")
