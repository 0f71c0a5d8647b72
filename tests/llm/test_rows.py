"""Rows that share an id, have none, or are equal: results by brute force, texts compared, however the rows are stored."""

import hashlib
import random
from collections import Counter

import corpus_pipeline as p
import pytest
from larkspur.llm import lines, minhash, mixing, substring
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, SF, WORD

PASSAGE = " ".join(f"p{i}" for i in range(30))
NONE = 10**9


def made():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(80)]
    base = ["\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 5))) for _ in range(14)]
    rows = []
    for i in range(70):
        t = r.choice(base) if r.random() < 0.7 else " ".join(r.choice(vocabulary) for _ in range(30))
        if r.random() < 0.3:
            t += "\n" + PASSAGE
        rows.append((r.choice([None, r.randrange(25), r.randrange(25)]), t, "en", r.choice(["a", "b", None]), len(t)))
    own = " ".join(f"own{i}" for i in range(25))
    again = " ".join(f"again{i}" for i in range(25))
    rows += [(101, again, "en", "a", 1), (102, again, "en", "a", 1), (102, own, "en", "a", 1), (None, again, "en", "b", 1), (None, own + " here", "en", "b", 1)]
    rows += [(103, "equal rows " * 15, "en", "a", 1)] * 4 + [(None, None, None, None, None)] * 2 + [(104, None, "en", "a", 0), (104, "", "en", "a", 0)]
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    """The same rows, stored in two ways."""
    rows = made()
    other = rows[:]
    random.Random(3).shuffle(other)
    return [spark.createDataFrame(x, SCHEMA).withColumn("k", F.lit(7)).repartition(n) for x, n in ((rows, 1), (other, 5))]


def documents(df):
    """Distinct (id, text) in the order that the operators give documents: by id, null last, then by the text's digest."""
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("v")).distinct().collect()
    return [(r["doc_id"], r["text"], r["v"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["v"]))]


def test_substring_rows(tables):
    seen, want = set(), {}
    for d, t, _ in documents(tables[0]):
        w = WORD.findall(t or "")
        gone = {i + k for i in range(len(w) - 19) if tuple(w[i : i + 20]) in seen or tuple(w[i : i + 20]) in {tuple(w[j : j + 20]) for j in range(i)} for k in range(20)}
        seen |= {tuple(w[i : i + 20]) for i in range(len(w) - 19)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    for table in tables:
        expected = Counter((r["doc_id"], *want[r["doc_id"], r["text"]]) for r in table.collect())
        got = substring.remove_repeats(table).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == expected
    assert want[102, " ".join(f"own{i}" for i in range(25))][1] == 0 and any(n for _, n, _ in want.values())


def test_lines_rows(tables):
    seen, want = [], {}
    for d, t, _ in documents(tables[0]):
        kept = []
        for line in (t or "").split("\n"):
            s = frozenset(WORD.findall(line))
            if not s or not any(len(s & o) >= 0.9 * len(s | o) - 1e-9 for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want[d, t] = None if t is None else "\n".join(kept)
    for table in tables:
        expected = Counter((r["doc_id"], want[r["doc_id"], r["text"]], r["source"]) for r in table.collect())
        for out in (lines.dedup_lines(table), p.line_dedup(table.sparkSession, table, SF)):
            assert Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect()) == expected
    assert want[102, " ".join(f"own{i}" for i in range(25))] != ""


def brute_groups(docs, percent):
    """The document (place) that stays of the group of each document."""
    sets = []
    for d, t, _ in docs:
        w = WORD.findall((t or "").lower())
        sets.append(({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}) if d is not None else set())
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_near_duplicate_rows(tables):
    docs = documents(tables[0])
    label = brute_groups(docs, 85)
    want = {(d, v): (docs[g][0], docs[g][0] == d) for (d, _, v), g in zip(docs, label, strict=True)}
    stay = {(d, t) for i, ((d, t, _), g) in enumerate(zip(docs, brute_groups(docs, 80), strict=True)) if i == g}
    for table in tables:
        got = minhash.near_duplicates(table).collect()
        assert all((r["component_id"], r["kept"]) == want[r["doc_id"], r["v"]] for r in got if r["doc_id"] is not None) and len(got) == table.count()
        assert all(r["component_id"] is None and r["kept"] and r["first"] for r in got if r["doc_id"] is None)
        out = p.near_dedup(table.sparkSession, table, SF)
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        assert out.columns == table.columns and Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(x for x in rows if x in stay)
    assert (102, " ".join(f"own{i}" for i in range(25))) in stay and (102, " ".join(f"again{i}" for i in range(25))) not in stay


def brute_mix(rows):
    """(source, id, text) -> copies of all its rows together."""
    numbers, queue = Counter(), []
    for source, d, t, v in rows:
        at = numbers[source, d, v]
        numbers[source, d, v] += 1
        key = hashlib.md5(f"{mixing.SEED}:{'' if d is None else d}:{v}:{at}".encode()).hexdigest()
        queue.append((source, key, len(WORD.findall(t or "")), (source, d, t)))
    sizes = Counter()
    for source, _, n, _ in queue:
        sizes[source] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    passes, copies = [], Counter()
    for s in names:
        cum = 0
        for _, key, n, doc in sorted((x for x in queue if x[0] == s), key=lambda x: x[1]):
            cum += n
            if not n:
                copies[doc] += 1
            else:
                passes += [((k * sizes[s] + cum) / target[s], key, k, n, doc) for k in range(3)]
    run = 0
    for _, _, _, n, doc in sorted(passes, key=lambda x: x[:3]):
        run += n
        if run > total:
            break
        copies[doc] += 1
    return +copies


def test_mix_rows(tables):
    rows = [(r["source"], r["doc_id"], r["text"], r["v"]) for r in tables[0].select("*", F.xxhash64("text").alias("v")).collect()]
    want = brute_mix(rows)
    for table in tables:
        got = Counter()
        for r in mixing.mix(table, ["doc_id", "text"]).collect():
            got[r["source"], r["doc_id"], r["text"]] += r["copies"]
        assert +got == want
        out = p.mix_sources(table.sparkSession, table, SF)
        assert out.columns == table.columns and Counter((r["source"], r["doc_id"], r["text"]) for r in out.collect()) == want


def test_lines_of_a_text_with_many_lines():
    import numpy as np

    text = b"a b c" + b"\n" * (1 << 20) + b"c d e"
    at, line, h, bounds = lines.line_sets([text], np.zeros(lines.COUNTERS, np.uint16))
    assert at.tolist() == [0, 0] and line.tolist() == [0, 1 << 20] and np.diff(bounds).tolist() == [3, 3]
