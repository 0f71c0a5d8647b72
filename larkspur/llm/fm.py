"""A quality classifier: factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairs of
features interact through low-rank factors, in time linear in the features present.

Features: each distinct word, lower-cased and hashed (its weight falls with the number of distinct
words), and STATS numbers about the text's shape and its n_chars column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import as_bytes, cut, prepare, tidy, word_hashes

SPACE, RANK, STATS = 1 << 16, 8, 14
#: Labelled rows the model is fitted on: those with the smallest digest of doc_id. The only sample here.
#: And the bytes of hashed words that they may have together, in the same order.
FIT_ROWS, FIT_BYTES = 16_384, 64 << 20
BLANK = b" \t\n\x0b\x0c\r"


def stats(text: bytes, words: list[bytes], n_chars: int | None) -> list[float]:
    """Ratios and logarithms about a text's shape, and its n_chars (its own length if null)."""
    s = text.decode()
    n, distinct, chars = len(words), len(set(words)), max(1, len(s))
    share = lambda cut: (len(text) - len(text.translate(None, cut))) / max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    solid = max(1, chars - s.count(" "))
    upper = sum(w.isupper() for w in s.split(" "))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(n), distinct / max(1, n), pairs / max(1, n - 1), solid / max(1, n) / 10, upper / max(1, n),
        share(b"#*$%&|<>") * 10, share(b"0123456789") * 10, share(b".,;:!?") * 10, share(b"!") * 10, share(b"|") * 10,
        (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), np.log1p(chars), np.log1p(max(0, chars if n_chars is None else n_chars)),
    ]


def row_of(text: bytes, n_chars: int | None) -> tuple[np.ndarray, list[float]]:
    """The hashed words of a text, without repeats, and its statistics."""
    words = text.split()
    return np.unique((word_hashes([text.lower()])[0] >> np.uint64(20)).astype(np.int64) % SPACE).astype(np.int32), stats(text, words, n_chars)


class Machine:
    """Weights w0, w and factors v; features 0..STATS-1 are the statistics, standardised."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.w0 = mean, scale, 0.0
        self.w = np.zeros(SPACE + STATS)
        self.v = r.normal(0, 0.01, (SPACE + STATS, RANK))

    def batch(self, rows: list[tuple[np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature places, their values and the first place of each row."""
        sizes = np.array([len(h) + STATS for h, _ in rows])
        starts = np.cumsum(sizes) - sizes
        place, value = np.empty(sizes.sum(), np.int64), np.empty(sizes.sum())
        dense = np.clip((np.array([s for _, s in rows]) - self.mean) / self.scale, -4, 4) / 2
        for k, (h, _) in enumerate(rows):
            a = starts[k]
            place[a : a + STATS], value[a : a + STATS] = np.arange(STATS), dense[k]
            place[a + STATS : a + sizes[k]], value[a + STATS : a + sizes[k]] = h + STATS, 1 / np.sqrt(len(h) + 1)
        return place, value, starts

    def raw(self, place: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[place] * value[:, None]
        total = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        return self.w0 + np.add.reduceat(self.w[place] * value, starts) + 0.5 * (total**2 - squares).sum(axis=1), total

    def fit(self, rows: list, labels: np.ndarray, epochs: int = 6, size: int = 256, rate: float = 0.08, decay: float = 1e-5) -> None:
        r = np.random.default_rng(3)
        gw, gv, g0 = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for lo in range(0, len(rows), size):
                pick = order[lo : lo + size]
                place, value, starts = self.batch([rows[k] for k in pick])
                out, total = self.raw(place, value, starts)
                off = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[pick]) / len(pick)
                own = np.repeat(np.arange(len(pick)), np.diff([*starts, len(place)]))
                at, back = np.unique(place, return_inverse=True)
                e = off[own] * value
                dw = np.bincount(back, weights=e, minlength=len(at)) + decay * self.w[at]
                cross = total[own] - self.v[place] * value[:, None]
                dv = np.stack([np.bincount(back, weights=e * cross[:, f], minlength=len(at)) for f in range(RANK)], axis=1) + decay * self.v[at]
                gw[at] += dw**2
                gv[at] += dv**2
                g0 += off.sum() ** 2
                self.w[at] -= rate * dw / np.sqrt(gw[at])
                self.v[at] -= rate / 4 * dv / np.sqrt(gv[at])
                self.w0 -= rate * off.sum() / np.sqrt(g0)

    def score(self, rows: list) -> np.ndarray:
        out, _ = self.raw(*self.batch(rows))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> Machine | float:
    """Fits a machine on at most ``fit_rows`` labelled documents where ``learn`` holds, as far as their
    features fit in FIT_BYTES; without both labels among them, the share of label 1 (0.5 without a label)
    takes its place. Of rows that share a doc_id that of the smallest text digest is taken, and of labels
    that share one the largest."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn).select("doc_id", "quality")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(fit_rows)
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_chars.alias("n_chars"), "text")
    rows = own.join(F.broadcast(known), "doc_id")  # fit_rows rows at most
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("v"), "n_chars", "text")).alias("r")).select("doc_id", "quality", "r.n_chars", "r.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [row_of(t, n) for t, n in zip(as_bytes(b.column(3)), b.column(2).to_pylist(), strict=True)]
            columns = [pa.array([h.tobytes() for h, _ in made], pa.binary()), pa.array([s for _, s in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), *columns], ["doc_id", "quality", "words", "stats"])

    made = rows.mapInArrow(tidy(run), "doc_id bigint, quality bigint, words binary, stats array<double>")
    held = F.sum(F.octet_length("words")).over(W.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    got = cut(made, "features").withColumn("held", held).where(F.col("held") <= FIT_BYTES).drop("held").collect()  # fit_rows rows, FIT_BYTES
    got.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in got], dtype=float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    features = [(np.frombuffer(r["words"], np.int32), r["stats"]) for r in got]
    dense = np.array([s for _, s in features])
    machine = Machine(dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3))
    machine.fit(features, y)
    return machine


def classify(docs: DataFrame, machine: Machine | float, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold`` on).

    A null text counts as empty, and empty texts have a score too. Rows are independent: repeated rows
    give repeated results; lang, source and labels play no part. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # (SPACE + STATS) * (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, n = as_bytes(b.column(2)), b.column(1).to_pylist()
            scores = []
            for lo in range(0, len(texts), 256):
                some = [row_of(t, k) for t, k in zip(texts[lo : lo + 256], n[lo : lo + 256], strict=True)]
                scores.append(np.full(len(some), m) if isinstance(m, float) else m.score(some))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_chars.alias("n_chars"), "text")
    return own.mapInArrow(tidy(run), "doc_id bigint, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def select_good(docs: DataFrame, machine: Machine | float, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns unchanged. The score is
    computed beside each row, so rows with null or repeated ids are judged by their own text."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series, n_chars: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for lo in range(0, len(texts), 256):
            n = [None if pd.isna(k) else int(k) for k in n_chars[lo : lo + 256]]
            some = [row_of((t or "").encode(), k) for t, k in zip(texts[lo : lo + 256], n, strict=True)]
            out.append(np.full(len(some), m) if isinstance(m, float) else m.score(some))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.where(score(F.col("text"), n_chars) >= threshold)
