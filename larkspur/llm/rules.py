"""Quality rules with an n-gram perplexity band for each language.

Base rules count words, symbols, repeated lines and repeated three-word windows. The method's verdict
comes from a modified Kneser-Ney model of each language: 5-grams of characters that run across words, so
that word order counts. Spark counts, over the whole corpus, the documents that have a 5-gram (a text
that repeats itself does not make itself likely); the lower orders' continuation counts, discounts and
interpolated probabilities follow by aggregations and joins on the grams themselves, so the model grows
with the corpus.

Nothing of the model is collected or broadcast. Texts are dealt out in groups of bounded size. A group
asks once for each of its distinct 5-grams, in one packed row for each shard of the model. A shard holds
its grams' probabilities in an array sorted by the grams' 64-bit hashes, and answers row by row; a group
looks its texts' grams up in its answers, sorted in the same way. A document is rejected where its
perplexity leaves its language's band, which is set by the quartiles of all its documents, separately
below and above.

Characters are code points as they are; digits are one symbol, other control characters too, and a
stretch of blanks is one blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.llm.common import U64, as_bytes, chunks, cut, drop, mix, per_text, prepare, shared_ids, tidy_group, window_hashes

ORDER = 5
#: Symbols that no text has: before its first character and after its last.
START, END = 2, 3
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\x0c\r"
#: How far a document's log-perplexity may fall below, or rise above, the quartiles of its language, in
#: spreads between them.
BELOW, ABOVE = 4.0, 2.0
#: Bytes of text in a group, and groups whose distinct grams are answered by one shard of the model.
GROUP, SHARED = 24 << 20, 8
#: Distinct grams of a group's megabytes that are held before they are merged.
HELD = 1_000_000
#: Texts are shuffled in so many rounds, so that only a part of them lies on disk beside the input.
ROUNDS = 2
_P = U64(0x9E3779B97F4A7C15)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts, each between ORDER - 1 starts and an end, and each one's text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).copy()
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes[codes < 32] = 26
    codes[blank] = 32
    codes[(codes >= 48) & (codes <= 57)] = 48
    keep = ~blank
    keep[:1] = True
    keep[1:] |= ~blank[:-1] | (of[1:] != of[:-1])
    codes, of = codes[keep], of[keep]
    sizes = np.bincount(of, minlength=len(texts)) + ORDER
    out = np.full(int(sizes.sum()), START, np.uint32)
    ends = np.cumsum(sizes)
    out[ends - 1] = END
    out[np.arange(len(codes)) + ORDER * of + ORDER - 1] = codes
    return out, np.repeat(np.arange(len(texts)), sizes)


def hashed(codes: np.ndarray) -> np.ndarray:
    """A hash of every ORDER symbols in a row."""
    n = len(codes) - ORDER + 1
    m = mix(codes.astype(U64) + U64(1))
    h = m[:n].copy()
    for k in range(1, ORDER):
        h *= _P
        h += m[k : k + n]
    return mix(h)


def by_language(group: pa.Table) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """Languages of a group, with their texts that are not blank, about a megabyte at once."""
    langs, texts = group.column("lang").to_pylist(), as_bytes(group.column("text").combine_chunks())
    for lang in sorted(set(langs)):
        own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t.strip(BLANK)]
        yield lang, ([t.decode() for t in own[lo:hi]] for lo, hi in chunks(own, 1 << 20, 100_000))


def base(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    chars = len(text.decode()) - (len(text) - len(text.translate(None, BLANK)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    n, repeated = len(words), 0
    if n > 3:
        h = window_hashes(hashes, 3)
        _, at, found = np.unique(h, return_inverse=True, return_counts=True)
        twice = found[at] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, numbers of texts and symbols (a row for each) of the distinct grams of some texts."""
    codes, of = symbols(texts)
    h = hashed(codes)
    at = np.flatnonzero(of[: len(h)] == of[ORDER - 1 :])
    h = h[at]
    order = np.argsort(h)
    h = h[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(new)
    pairs = np.sort((np.cumsum(new) - 1) << 24 | of[at[order]])  # a chunk has fewer texts than 2^24
    n = np.bincount(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] >> 24)
    return h[first], n, codes[at[order[first]][:, None] + np.arange(ORDER)]


def merged(h: np.ndarray, n: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of grams that may repeat."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n[order], first), codes[order[first]]


def packed(codes: np.ndarray) -> bytes:
    return codes.astype("<u4").tobytes().decode("utf-32-le").encode()


def unpacked(grams: bytes) -> np.ndarray:
    return np.frombuffer(grams.decode().encode("utf-32-le"), np.uint32).reshape(-1, ORDER)


def row_hashes(codes: np.ndarray) -> np.ndarray:
    """The hash of each row of symbols, as ``hashed`` gives it."""
    m = mix(codes.astype(U64) + U64(1))
    h = m[:, 0].copy()
    for k in range(1, ORDER):
        h *= _P
        h += m[:, k]
    return mix(h)


ASKED = "batch bigint, lang string, shard bigint, grams binary, n binary"


def asked(dealt: DataFrame, shards: int) -> DataFrame:
    """ASKED: the distinct grams of each group of texts, by language and shard, with the texts that have them."""

    def count(group: pa.Table) -> pa.Table:
        batch = group.column("batch")[0].as_py()
        rows: list[tuple] = []
        for lang, texts in by_language(group):
            parts, held = [], 0
            for own in texts:
                parts.append(distinct(own))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [merged(*map(np.concatenate, zip(*parts, strict=True)))]
                    held = 0
            if not parts:
                continue
            h, n, codes = merged(*map(np.concatenate, zip(*parts, strict=True)))
            shard = (h % U64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1)) if shards < len(h) else np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(h))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if z > a:
                    some = order[a:z]
                    rows.append((batch, lang, int(shard[some[0]]), packed(codes[some]), n[some].astype(np.uint32).tobytes()))
        types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table({c.split()[0]: pa.array(x, t) for c, x, t in zip(ASKED.split(", "), columns, types, strict=True)})

    return dealt.select("batch", "lang", "text").groupBy("batch").applyInArrow(tidy_group(count), ASKED)


def counted(asks: DataFrame) -> DataFrame:
    """lang, shard, gram, n over all groups."""

    def add(group: pa.Table) -> pa.Table:
        langs = group.column("lang").to_pylist()
        out = {"lang": [], "gram": [], "n": []}
        for lang in sorted(set(langs)):
            rows = [i for i, x in enumerate(langs) if x == lang]
            codes = np.concatenate([unpacked(group.column("grams")[i].as_py()) for i in rows])
            n = np.concatenate([np.frombuffer(group.column("n")[i].as_py(), np.uint32) for i in rows]).astype(np.int64)
            _, n, codes = merged(row_hashes(codes), n, codes)
            flat = codes.astype("<u4").tobytes().decode("utf-32-le")
            out["lang"] += [lang] * len(n)
            out["gram"] += [flat[k : k + ORDER] for k in range(0, len(flat), ORDER)]
            out["n"].append(n)
        shard = np.full(len(out["lang"]), group.column("shard")[0].as_py())
        return pa.table({"lang": pa.array(out["lang"], pa.string()), "shard": pa.array(shard), "gram": pa.array(out["gram"], pa.string()), "n": pa.array(np.concatenate(out["n"]))})

    return asks.select("shard", "lang", "grams", "n").groupBy("shard").applyInArrow(tidy_group(add), "lang string, shard bigint, gram string, n bigint")


ANSWERED = "batch bigint, lang string, grams binary, log_p binary"


def answered(asks: DataFrame, known: DataFrame) -> DataFrame:
    """ANSWERED: each row of grams with the log-probabilities of its last characters."""

    def look_up(rows: pa.Table, shard: pa.Table) -> pa.Table:
        tables = sorted_tables(shard.column("lang").to_pylist(), np.frombuffer("".join(shard.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER), shard.column("log_p").to_numpy())
        log_p = []
        for lang, grams in zip(rows.column("lang").to_pylist(), rows.column("grams").to_pylist(), strict=True):
            keys, values = tables[lang]
            log_p.append(values[np.searchsorted(keys, row_hashes(unpacked(grams)))].astype(np.float32).tobytes())
        return pa.table({"batch": rows.column("batch"), "lang": rows.column("lang"), "grams": rows.column("grams"), "log_p": pa.array(log_p, pa.binary())})

    left = asks.select("batch", "lang", "shard", "grams").groupBy("shard")
    return left.cogroup(known.groupBy("shard")).applyInArrow(look_up, ANSWERED)


def sorted_tables(langs: list[str], codes: np.ndarray, log_p: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and log-probabilities of each language's grams."""
    out, h = {}, row_hashes(codes)
    names, of = np.unique(np.array(langs, dtype=object), return_inverse=True) if langs else ([], np.empty(0, np.int64))
    for i, lang in enumerate(names):
        m = np.flatnonzero(of == i)
        m = m[np.argsort(h[m])]
        out[lang] = h[m], log_p[m]
    return out


def suffix(gram: str = "gram") -> Column:
    return F.expr(f"substring({gram}, 2)")


def orders(counts: DataFrame) -> DataFrame:
    """lang, k, shard, gram, p, back of the grams of k characters, from the counts (lang, shard, gram, n) of
    the longest: the discounted probability before interpolation, and what the context hands to the order below."""
    level = counts.select("lang", "gram", "n")
    every = counts.select("lang", F.lit(ORDER).alias("k"), "shard", "gram", "n")
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", suffix().alias("gram")).agg(F.count("*").alias("n"))
        every = every.unionByName(level.select("lang", F.lit(k).alias("k"), F.lit(None).cast("long").alias("shard"), "gram", "n"))
    every = cut(every, "grams")
    of = lambda i: F.count_if(F.col("n") == i).cast("double")
    c = every.groupBy("lang", "k").agg(*[of(i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    discount = lambda i: F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}"), F.lit(i / 2))))
    c = c.select("lang", "k", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
    g = every.join(c, ["lang", "k"])
    g = g.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    # A context has at most as many grams as there are characters.
    context = W.partitionBy("lang", "k", F.expr("substring(gram, 1, k - 1)"))
    g = g.withColumn("all", F.sum("n").over(context)).withColumn("off", F.sum("d").over(context))
    return g.select("lang", "k", "shard", "gram", ((F.col("n") - F.col("d")) / F.col("all")).alias("p"), (F.col("off") / F.col("all")).alias("back"))


def model(each: DataFrame) -> DataFrame:
    """lang, shard, gram, log_p: the interpolated log-probability of the last character of each of the longest
    grams, from ``orders``."""
    size = each.where("k = 1").groupBy("lang").agg((F.lit(1.0) / (F.count("*") + 1)).alias("uniform"))
    p = each.where("k = 1").join(size, "lang").select("lang", "shard", "gram", (F.col("p") + F.col("back") * F.col("uniform")).alias("p"))
    for k in range(2, ORDER + 1):
        below = p.select("lang", F.col("gram").alias("rest"), F.col("p").alias("low"))
        own = each.where(F.col("k") == k).withColumn("rest", suffix())
        p = own.join(below, ["lang", "rest"]).select("lang", "shard", "gram", (F.col("p") + F.col("back") * F.col("low")).alias("p"))
    return p.select("lang", "shard", "gram", F.log("p").alias("log_p"))


ROW = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, log_ppl double"


def scored(dealt: DataFrame, answers: DataFrame) -> DataFrame:
    """ROW of each text: the base counts and the mean negative log-probability of its symbols."""

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        grams = [unpacked(x) for x in known.column("grams").to_pylist()]
        langs = [x for x, g in zip(known.column("lang").to_pylist(), grams, strict=True) for _ in range(len(g))]
        log_p = [np.frombuffer(x, np.float32) for x in known.column("log_p").to_pylist()]
        tables = sorted_tables(langs, np.concatenate(grams) if grams else np.empty((0, ORDER), np.uint32), np.concatenate(log_p).astype(np.float64) if log_p else np.empty(0))
        all_langs, raw = texts.column("lang").to_pylist(), as_bytes(texts.column("text").combine_chunks())
        found: list[tuple] = [()] * len(raw)
        for lo, hi in chunks(raw, 1 << 20, 100_000):
            for i, (t, x) in enumerate(zip(raw[lo:hi], per_text(raw[lo:hi]), strict=True), lo):
                found[i] = (*base(t, t.split(), x), None)
            for lang in set(all_langs[lo:hi]):
                some = [i for i in range(lo, hi) if all_langs[i] == lang and found[i][0] + len(raw[i].strip(BLANK))]
                if not some:
                    continue
                codes, of = symbols([raw[i].decode() for i in some])
                h = hashed(codes)
                at = np.flatnonzero(of[: len(h)] == of[ORDER - 1 :])
                h, of = h[at], of[at]
                order = np.argsort(h)
                h = h[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                keys, values = tables[lang]
                each = np.repeat(values[np.searchsorted(keys, h[first])], np.diff(np.append(first, len(h))))
                mean = np.bincount(of[order], weights=each, minlength=len(some)) / np.bincount(of, minlength=len(some))
                for i, v in zip(some, mean.tolist(), strict=True):
                    found[i] = (*found[i][:5], -v)
        types = [pa.int64()] * 5 + [pa.float64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 6, types, strict=True)]
        same = {c: texts.column(c) for c in ("doc_id", "lang")}
        return pa.table(same | dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl"), columns, strict=True)))

    return dealt.select("batch", "doc_id", "lang", "text").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, ROW)


def assess(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """The base counts, perplexity, its band, base_failed and kept of every document.

    A null text has no words; it and every text with fewer than ``min_words`` words, or with more than
    ``max_repeat`` per cent of them in repeated windows, fails the base rules. Every lang value has a
    model of its own, null too. Rows that share an id, or are equal, count as often as they occur. Extra
    columns are ignored. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    # A text of null language is one of the language '', others have a letter before their name.
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    if shared_ids(docs):
        own = cut(own.withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so that a row keeps its number
    else:
        own = own.withColumn("row", F.col("doc_id"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP))
    dealt = own.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    parts = [F.col("batch") % ROUNDS == r for r in range(min(ROUNDS, groups))]
    asked_parts = [cut(asked(dealt.where(part), -(-groups // SHARED)), "asked") for part in parts]
    asks = reduce(DataFrame.unionByName, asked_parts)
    counts = cut(counted(asks), "counts")
    each = cut(orders(counts), "orders")
    drop(counts)
    known = cut(model(each), "model")
    drop(each)
    answers = cut(answered(asks, known), "answers")
    for table in (*asked_parts, known):
        drop(table)
    rows = reduce(DataFrame.unionByName, [cut(scored(dealt.where(part), answers.where(part)), "scored") for part in parts])
    drop(answers)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    q = rows.where(~failed).groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.75], 10_000).alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.01))
    bands = q.select("lang", (F.col("q")[0] - below * spread).alias("low"), (F.col("q")[1] + above * spread).alias("high"))
    out = rows.join(bands, "lang", "left")
    verdict = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & verdict).alias("kept"), F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("band_low"), F.exp("high").alias("band_high"),
    )
