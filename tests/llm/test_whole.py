"""What a stage or an operator would leave undone with a narrower threshold or a least length."""

import random

import corpus_pipeline as p
import pytest
from larkspur.llm import lines, minhash

from tests.llm.test_operators import SF, WORD, brute_lines, copies, table


def brute_kept(texts, percent):
    """Places of the texts that are the first of their component, by all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {i for i, x in enumerate(label) if i == x}


def test_near_dedup_stage_links_from_80(spark):
    words = [f"p{i}" for i in range(100)]
    pair = [*words[:30], "other", *words[31:60], "another", *words[61:]]  # 86 of 106 shingles: 0.81
    texts = [*copies(random.Random(8), 90), " ".join(words), " ".join(pair)]
    kept = {r["doc_id"] for r in p.near_dedup(spark, table(spark, texts), SF).collect()}
    assert kept == brute_kept(texts, 80) and len(texts) - 1 not in kept
    assert len(kept) < len(brute_kept(texts, 85)) - 1


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_banding_fits_the_threshold(percent):
    rows = minhash.band_rows(percent)
    assert 2 * minhash.PERMUTATIONS % rows == 0 and (1 - (percent / 100) ** rows) ** (2 * minhash.PERMUTATIONS // rows) <= 1e-6
    assert minhash.band_rows(85) == 5 and minhash.may_differ(85) == 28 and minhash.may_differ(80) > 31


@pytest.mark.parametrize("threshold", [0.9, 0.8])
def test_lines_of_every_length_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(lines, "SHARD", 100)
    r = random.Random(4)
    base = [[f"w{r.randrange(60)}" for _ in range(r.randint(1, 14))] for _ in range(60)]
    docs = []
    for d in range(100):
        made = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(base))
            if r.random() < 0.4:
                line[r.randrange(len(line))] = f"w{r.randrange(60)}"
            if r.random() < 0.3:
                line.append(f"w{r.randrange(60)}")
            made.append(" ".join(line))
        docs.append((d, "\n".join(made)))
    docs += [(200, "All rights reserved.\n\n版权所有。\n "), (201, "first\n\nrights All reserved.\n版权所有。\n \nfirst"), (None, "版权所有。"), (202, None), (203, "")]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), threshold).collect()
    removed = {x["doc_id"]: list(x["_removed"]) for x in got}
    assert removed == brute_lines(docs, threshold, 1) and removed[201] == [2, 3, 5] and removed[None] == [0]


def test_line_dedup_stage_removes_short_lines(spark):
    docs = table(spark, ["menu\nsome text of this page only", "menu\nand quite another text"])
    out = {r["doc_id"]: r["text"] for r in p.line_dedup(spark, docs, SF).collect()}
    assert out == {0: "menu\nsome text of this page only", 1: "and quite another text"}
