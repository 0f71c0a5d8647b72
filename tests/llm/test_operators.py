"""Each training-data operator against brute force, round trips or held-out labels, and on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import bpe, fm, langid, lines, media, minhash, mixing, packing, rules, substring
from larkspur.llm.common import crc_mod, per_text, word_hashes
from larkspur.llm.queries import QUERIES, SQL, tokenizer
from tests.test_queries import canon, expected

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", {}).get(i, "en"), columns.get("source", {}).get(i, "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, "one two", "en", None, 7), (5, long, "de", "b", len(long)), (5, long, "de", "b", len(long)),
        (None, "no id here at all but some words", "en", "a", 10), (None, None, None, None, None), (6, "x" * 200_000, "en", "b", 1), (7, "one two", None, "a", None), (8, long + " tail", "de", "b", 3),
        (9, "ÀÉ ñ 日本語 \U0001f600 <|endoftext|> '' İ", "en", "a", 4), (-3, "negative id", "en", "a", 11),
    ]
    extra = [(*r, i, "e", 0.5, i, "z") for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, SCHEMA + ", k long, label string, score double, size long, _key string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_cut_like_the_pattern():
    texts = ["a b\x0bc\x1cd\xa0e", "", " \n", "x" * 5000, "b a"]
    h, place, bounds = word_hashes([t.encode() for t in texts])
    assert np.diff(bounds).tolist() == [len(WORD.findall(t)) for t in texts]
    assert len(place) == len(h) and h[0] == h[bounds[4] + 1]


# 1: packing


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12), st.sampled_from([40, 41, 64]))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_piece_without_gaps(histogram, capacity):
    plan, seqs = packing.solve(histogram, capacity), {}
    for length, a, b, first, each, offset in plan.runs:
        for q in range(b - a):
            seqs.setdefault(first + q // each, []).append((offset + q % each * length, length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(map(len, seqs.values())) == sum(histogram.values()) and len(seqs) == plan.sequences
    total = sum(k * n for k, n in histogram.items())
    assert plan.sequences <= 1 + 2 * total // capacity or max(histogram) * 2 > capacity


def test_reduction_reaches_the_optimum_of_perfect_pairs():
    plan = packing.solve({30: 5, 10: 5, 25: 4, 15: 4}, 40)
    assert plan.sequences == 9 and plan.fixed == 9


def test_pack_ids_and_offsets(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    got = packing.pack(odd, tokenizer(), 64).collect()
    whole = {}
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            whole.setdefault((r["doc_id"], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), []).append(1)
    assert len(got) == sum(map(len, whole.values()))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == set(whole)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    assert packing.pack(none, tokenizer()).count() == 0


# 2: near duplicates


def brute_components(texts):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def copies(r, n, words=60, edits=6):
    base = [[f"t{r.randrange(400)}" for _ in range(words)] for _ in range(6)]
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, edits)):
            t[r.randrange(len(t))] = f"E{r.randrange(10**6)}"
        out.append(" ".join(t))
    return [*out, None, "", "Solo", "solo", "two Words", out[0].upper()]


@pytest.mark.parametrize("limit", [20_000, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(minhash, "LIMIT", limit)
    monkeypatch.setattr(minhash, "SHARD", 300)
    texts = copies(random.Random(5), 90)
    got = minhash.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minmax_signature_estimates_jaccard():
    r = random.Random(2)
    a = [f"w{r.randrange(10**6)}" for _ in range(900)]
    b = a[:800] + [f"v{i}" for i in range(100)]
    x, y = minhash.shingles([" ".join(a).encode(), " ".join(b).encode()])
    truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs(np.mean(minhash.signature(x) == minhash.signature(y)) - truth) < 0.12


def test_near_duplicates_odd(odd, none):
    got = minhash.near_duplicates(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[4] == [(1, 4, True)] and by[7] == [(1, 4, False)] and by[8][0][1] == 5 and len(by[5]) == 2
    assert sorted(by[None])[0] == (0, None, True) and by[2] == [(0, 2, True)] and by[1] == [(0, 1, True)]
    assert minhash.near_duplicates(none).count() == 0


# 3: language


def test_bundle_is_the_sum_of_bound_trigrams():
    letters = langid.Letters(128, 1)
    got = langid.bundles(letters, ["Ab c"])[0]
    v = {x: letters.vectors[letters.index[ord(x)]].astype(int) if x != " " else letters.vectors[0].astype(int) for x in "abc "}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in (" ab", "ab ", "b c", " c "))
    assert np.array_equal(got, want)


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(d, crc_mod(F.col("doc_id"), 4) != 2).join(d.select("doc_id", "lang"), "doc_id").where(crc_mod(F.col("doc_id"), 4) == 2)
    good, all_ = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert good >= 0.97 * all_ and out.where("score < 0 or score > 1").count() == 0


def test_language_odd(spark, odd, none):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, F.lit(True)).collect()}
    assert (1, "und") in got and (2, "und") in got and (3, "und") in got and (5, "de") in got and (6, "en") in got
    one = spark.createDataFrame([(1, "a"), (2, "7 ?"), (3, "\u00e9")], "doc_id bigint, text string").withColumn("lang", F.lit("xx"))
    assert [r["lang_pred"] for r in langid.identify(one, F.lit(True)).orderBy("doc_id").collect()] == ["xx", "und", "xx"]
    assert langid.identify(none, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}


# 4: media


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(data):
    read = list(media.frames(media.encode(media.padded(data))))
    assert b"".join(d.payload() for d in read) == media.padded(data)


def test_media_frames_runs_and_slow_paths(monkeypatch):
    data = media.padded(random.Random(1).randbytes(9000))
    fast = media.encode(data)
    want = [d.rgb() for d in media.frames(fast)]
    # A second code in the tables leaves the stream as it is but rules the array paths out.
    slow = fast.replace(media.huffman(0, 0, {1: [8]}), media.huffman(0, 0, {1: [8], 2: [0]})).replace(media.huffman(1, 0, {1: [8]}), media.huffman(1, 0, {1: [8], 2: [0]}))
    read = list(media.frames(slow))
    assert b"".join(d.payload() for d in read) == data and all(np.array_equal(a.rgb(), b) for a, b in zip(read, want, strict=True))
    monkeypatch.setattr(media, "FRAME", 2048)
    monkeypatch.setattr(media, "RUN", 7)
    read = list(media.frames(media.encode(data)))
    assert len(read) == 5 and b"".join(d.payload() for d in read) == data


def test_inverse_transform_of_a_flat_block():
    assert np.allclose(np.eye(64, dtype=np.float32)[0] * 80 @ media.IDCT, 10) and np.allclose(media.IDCT @ media.IDCT.T, np.eye(64), atol=1e-5)


def test_media_odd(odd, none):
    got = media.media_columns(odd).collect()
    for r in got:
        t = r["payload"][: r["n_bytes"]]
        assert len(r["payload"]) % 64 == 0 and len(r["payload"]) >= 64 and not any(r["payload"][r["n_bytes"] :])
        assert all(len(x["rgb"]) == x["height"] * x["width"] * 3 for x in r["tensors"])
        assert t.decode() is not None
    same = {(r["payload"], r["media"], r["feature"]) for r in got if r["doc_id"] == 5}
    assert len(same) == 1 and media.media_columns(none).count() == 0


# 5: token counts


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_heap_counts_equal_the_library(text):
    from tokenizers import Tokenizer

    m = bpe.merger(tokenizer())
    assert m.count(text) == len(Tokenizer.from_file(tokenizer()).encode(text, add_special_tokens=False).ids) if text else m.count(text) == 0


def test_token_counts_odd(odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    texts = {(r["doc_id"], len((r["text"] or "").encode())): len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect()}
    got = bpe.count_tokens(odd, tokenizer(), 20).collect()
    assert len(got) == odd.count() and {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in got} == texts
    assert all(r["over_limit"] == (r["n_tokens"] > 20) for r in got) and bpe.count_tokens(none, tokenizer()).count() == 0


# 6: substring dedup


def brute_repeats(texts):
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def test_substring_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH", 500)
    monkeypatch.setattr(substring, "SHARD", 200)
    r = random.Random(9)
    passages = [[f"p{r.randrange(50)}" for _ in range(r.randint(19, 60))] for _ in range(5)]
    texts = []
    for _ in range(60):
        t = [f"u{r.randrange(10**5)}" for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            t += r.choice(passages) + [f"u{r.randrange(10**5)}"]
        texts.append(" ".join(t))
    texts += ["the " * 50, "a b " * 30, None, "", texts[3]]
    got = substring.remove_repeats(table(spark, texts)).orderBy("doc_id").collect()
    assert [(x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got] == brute_repeats(texts)


def test_substring_odd(odd, none):
    got = substring.remove_repeats(odd).collect()
    assert len(got) == odd.count() and {r["n_removed"] for r in got if r["doc_id"] in (1, 2, 4, 6)} == {0}
    assert {r["n_removed"] for r in got if r["doc_id"] == 8} == {30_000} and substring.remove_repeats(none).count() == 0


# 7: quality rules


def brute_base(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_base_rules_equal_brute_force():
    texts = ["a b c a b c d", "x\nx\n\n \nx", "é# ç$ |\x1f|", "", "one", "a a a a", "q " * 40]
    encoded = [t.encode() for t in texts]
    assert [rules.base(b, b.split(), h) for b, h in zip(encoded, per_text(encoded), strict=True)] == [brute_base(t) for t in texts]


def test_rules_reject_what_no_language_has(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**6, " ".join("qxzj%04d" % i for i in range(200)), "en", "s", 1)], SCHEMA)
    got = {r["doc_id"]: r for r in rules.assess(d.unionByName(junk)).collect()}
    assert not got[10**6]["kept"] and not got[10**6]["base_failed"]
    fine = [r for r in got.values() if not r["base_failed"] and r["doc_id"] != 10**6]
    assert sum(r["kept"] for r in fine) >= 0.8 * len(fine)


def test_rules_odd(odd, none):
    got = rules.assess(odd).collect()
    assert len(got) == odd.count() and all(not r["kept"] for r in got if r["n_words"] < 50)
    assert rules.assess(none).count() == 0


# 8: mixing


def test_mix_targets_and_limits(spark):
    r = random.Random(4)
    texts = [" ".join(["w"] * r.randint(0, 30)) for _ in range(400)]
    source = {i: "abcd"[min(3, i * 17 % 40 // 10 if i % 3 else 0)] if i % 11 else None for i in range(400)}
    got = mixing.mix(table(spark, texts, source=source)).collect()
    by = {}
    for x in got:
        s = by.setdefault(x["source"], [x["target"], x["source_size"], 0])
        s[2] += x["size"] * x["copies"]
        assert 0 <= x["copies"] <= 3
    total = sum(s[1] for s in by.values())
    assert abs(sum(s[0] for s in by.values()) - total) < 1e-6 * total and all(s[0] <= 3 * s[1] + 1e-9 for s in by.values())
    assert all(abs(s[2] - s[0]) <= 60 for s in by.values()) and sum(s[2] for s in by.values()) <= total


def test_mix_odd(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and mixing.mix(none).count() == 0
    assert sorted((str(r["doc_id"]), r["copies"]) for r in got) == sorted((str(r["doc_id"]), r["copies"]) for r in mixing.mix(odd.repartition(3)).collect())


# 9: line dedup


def brute_lines(docs, threshold, least):
    seen, out = [], {}
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        out[d] = []
        for i, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if len(s) >= least:
                if any(len(s & o) >= threshold * len(s | o) - 1e-9 for o in seen):
                    out[d].append(i)
                seen.append(s)
    return out


@pytest.mark.parametrize(("threshold", "frequent"), [(0.9, 100_000), (0.8, 3)])
def test_lines_equal_brute_force(spark, monkeypatch, threshold, frequent):
    monkeypatch.setattr(lines, "FREQUENT", frequent)
    monkeypatch.setattr(lines, "SHARD", 100)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 24))] for _ in range(40)]
    docs = []
    for d in range(120):
        made = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            made.append(" ".join(line))
        docs.append((d, "\n".join(made)))
    docs += [(500, None), (501, ""), (None, docs[5][1]), (502, "\n\n" + "x" * 10)]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), threshold, 5).collect()
    want = brute_lines(docs, threshold, 5)
    assert {x["doc_id"]: list(x["_removed"]) for x in got} == want and sum(map(len, want.values())) > 50
    texts = dict(docs)
    for x in got:
        t = texts[x["doc_id"]]
        assert x["text"] == (t if t is None else "\n".join(y for i, y in enumerate(t.split("\n")) if i not in want[x["doc_id"]]))


def test_lines_odd(odd, none):
    out = lines.dedup_lines(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == odd.count() and lines.dedup_lines(none).count() == 0


# 10: quality classifier


def test_sum_of_squares_equals_all_pairs():
    m = fm.Machine(np.zeros(fm.STATS), np.ones(fm.STATS))
    m.v = np.random.default_rng(0).normal(size=m.v.shape)
    m.w = np.random.default_rng(1).normal(size=m.w.shape)
    place, value, starts = m.batch([(np.array([3, 9, 70], np.int32), [0.5] * fm.STATS)])
    out, _ = m.raw(place, value, starts)
    pairs = sum(m.v[place[i]] @ m.v[place[j]] * value[i] * value[j] for i in range(len(place)) for j in range(i))
    assert np.isclose(out[0], m.w0 + m.w[place] @ value + pairs)


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, all_ = got.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert right >= 0.9 * all_


def test_classifier_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    m = fm.train(odd, labels, F.lit(True))
    got = fm.classify(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got) and fm.classify(none, m).count() == 0
    assert fm.select_good(odd, m, 0.0).count() == odd.count()
    assert fm.train(none, labels, F.lit(True)) == 0.5


# Registered queries


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    want, names = expected(SQL[name])
    assert sorted(df.columns) == names and canon([tuple(r) for r in df.collect()], df.columns) == want


def test_query_columns(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, fn in QUERIES.items():
        if name.startswith("op") and name != "op1_pack":
            assert fn(spark, SF).count() == d.count(), name
