"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds its adjacent pairs that the vocabulary can
merge, keyed by (rank, position). The lowest is popped again and again; stale entries are skipped.
The count is the number of initial symbols minus the number of merges: no identifier is made.

Pre-tokenizing follows the tokenizer file. For texts below U+0300 without special strings that is a
lower-casing and one regular expression (NFC changes nothing there); all others pass through the
library's own normalizer and pre-tokenizer, so its Unicode tables decide.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import MEMO, by_batch, prepare

PLAIN_BELOW = 0x300


def char_class(major: str) -> str:
    """A regex class body: code points below PLAIN_BELOW of a general category."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if unicodedata.category(chr(c))[0] == major)


L, N = char_class("L"), char_class("N")
SPACE = "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F))
PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{SPACE}{L}{N}]+")
ODD = re.compile(f"[^\x00-{chr(PLAIN_BELOW - 1)}]|<\\|")


def byte_symbols() -> dict[int, str]:
    """Byte -> printable stand-in: printable bytes are themselves, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger(dict):
    """word -> number of tokens; a memo of bounded size over the heap algorithm."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.known = model["vocab"].keys()
        self.symbol = byte_symbols()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.library = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> int:
        n = self.merge(word)
        if len(self) < MEMO and len(word) <= 64:
            self[word] = n
        return n

    def merge(self, word: str) -> int:
        return self.merge_symbols([self.symbol[b] for b in word.encode()])

    def merge_symbols(self, s: list[str]) -> int:
        if not s:
            return 0
        s[-1] += self.suffix
        s = [x for x in s if x in self.known]  # without an unknown token the model drops the rest
        n, rank = len(s), self.rank
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], n
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := rank.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if s[i] == a else -1
            if j < 0 or s[j] != b:
                continue
            s[i], s[j], right[i] = a + b, "", right[j]
            alive -= 1
            if right[i] >= 0:
                left[right[i]] = i
                if (r := rank.get((s[i], s[right[i]]))) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[right[i]]))
            if left[i] >= 0 and (r := rank.get((s[left[i]], s[i]))) is not None:
                heapq.heappush(heap, (r, left[i], s[left[i]], s[i]))
        return alive

    def count(self, text: str) -> int:
        if not ODD.search(text):
            return sum(map(self.__getitem__, PRE.findall(text.lower())))
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])

    def plain(self, text: str) -> int:
        """A piece without special strings, by the library's normalizer and pre-tokenizer."""
        pre = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return sum(self.merge_symbols(list(w)) for w, _ in pre)


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    ``tokenizer`` is the path of a BPE file with word ends, the same on every executor. A null or
    empty text has 0 bytes and 0 tokens. Each row is counted by itself: repeated rows and ids give
    repeated results, other columns are ignored, an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = merger(tokenizer)
        texts = [t or "" for t in b.column(1).to_pylist()]
        counts = [m.count(t) for t in texts]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sized = both.select(F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("k"), "text")
    out = by_batch(sized, run, "doc_id struct<doc_id: bigint, n_bytes: bigint>, n_tokens bigint")
    return out.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
