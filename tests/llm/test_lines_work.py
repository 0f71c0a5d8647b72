"""Line dedup does no work twice that it need not: words, sets of lines, and what is left of a text."""

import random
import re

import numpy as np
import pytest
from larkspur.llm import lines
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_lines


def test_words_are_hashed_by_their_bytes_alone():
    r = random.Random(5)
    of_word, of_hash = {}, {}
    for _ in range(300):
        texts = [bytes(r.choice(b"ab\x00\xc3\xa9\xff\x08\x0e! \t\n\x0b\r") for _ in range(r.choice([0, 1, 9, 40]))) for _ in range(r.randint(1, 4))]
        texts += [bytes(r.choice(b"xyz") for _ in range(n)) for n in (7, 8, 9, 16, 63, 64, 65, 200)]
        r.shuffle(texts)
        joined = b"\n".join(texts) + b"\n"
        words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", joined)]
        h, place, breaks = lines.words_of(texts)
        assert place.tolist() == [at for at, _ in words] and breaks.tolist() == [i for i, c in enumerate(joined) if c == 10]
        for (_, w), x in zip(words, h.tolist(), strict=True):
            assert of_word.setdefault(w, x) == x and of_hash.setdefault(x, w) == w
    assert len(of_word) > 3000


def test_a_text_without_lines(spark):
    r = random.Random(6)
    rows = [("", [0]), ("\n", [0]), ("\n", [1]), ("\n\n", [0, 1, 2]), ("a", [0]), ("é\r\n\x00 b\n", [1]), (None, [0])]
    for _ in range(200):
        parts = [r.choice(["", "a", " b ", "ß€😀", "$1\\n"]) for _ in range(r.randint(1, 9))]
        rows.append(("\n".join(parts), r.sample(range(len(parts)), r.randint(1, len(parts)))))
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, text string, gone array<int>")
    got = {x["i"]: x["out"] for x in t.select("i", lines.without_lines(F.col("text"), F.col("gone")).alias("out")).collect()}
    for i, (text, gone) in enumerate(rows):
        assert got[i] == (None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone))


@pytest.mark.parametrize("shared", [False, True])
def test_sets_are_grouped_unsorted_and_texts_stay_out_of_python(spark, monkeypatch, shared):
    docs = [(i, f"one line of document {i} with words a b c d e f\nmenu\nmenu") for i in range(20)] + [(None if shared else 20, "menu\nlast")]
    plans, cut = [], lines.cut

    def spy(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *args, **kwargs)

    monkeypatch.setattr(lines, "cut", spy)
    out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {x["doc_id"]: list(x["_removed"]) for x in out.collect()} == brute_lines(docs, 0.9, 1)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    # Rows travel whole to no grouping: it takes a set's digest and its document, sorted only if that is a pair.
    assert not any("min(struct(k" in x and "prefix" in x.split("min(struct(k", 1)[1].split(")", 1)[0] for x in plans)
    assert shared or not any("SortAggregate" in x for x in plans)


def test_chunks_have_the_words_of_the_whole():
    texts = [f"w{i} w{i % 7} again".encode() for i in range(4000)]
    h = lines.words_of(texts)[0]
    parts = [lines.words_of(texts[a:z])[0] for a, z in lines.chunks(texts, 1 << 10, 10_000)]
    assert len(parts) > 10 and np.array_equal(np.concatenate(parts), h)
