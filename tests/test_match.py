"""The tier ladder, gates, ties, near misses; cascade = union."""

import pytest

from larkspur.operators import match as m
from larkspur.plans.fixtures import library, playlist

SF = "/root/testdata/sf0.001"


def tracks(spark, rows):
    return m.index_tracks(spark.createDataFrame(rows, "path string, title string, artists array<string>, album string, filename string"))


def entries(spark, rows):
    return m.index_entries(spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "idx int, track_name string, artists array<string>, album string"))


LIBRARY = [
    ("b/1.mp3", "Silver Rain", ["Dora"], "Clouds", "1.mp3"),
    ("a/1.mp3", "Silver Rain", ["Dora"], "Clouds", "1.mp3"),
    ("c/1.mp3", "Long Silver Rain Again", ["Dora"], "Other", "1.mp3"),
    ("d/1.mp3", "Time", ["Nobody"], "Hours", "x.mp3"),
    ("e/1.mp3", "Untitled", ["Evan"], "Mix", "Evan - Hidden Gem.mp3"),
    ("f/1.mp3", "One Two Three Four", ["Fay and the Foxes"], "Nums", "y.mp3"),
]
CASES = [
    (("Silver Rain", ["Dora"], "Clouds"), "a/1.mp3", "title+artist+album[0]"),
    (("Silver Rain", ["Guest", "Dora"], "Nope"), "a/1.mp3", "title+artist[1]"),
    (("Silver Rain", ["Else"], "Clouds"), "a/1.mp3", "title+album"),
    (("Silver Rain", [], ""), "a/1.mp3", "title"),
    (("Long Silver Rain", ["Dora"], "None"), "a/1.mp3", "title-substring"),
    (("Time", ["Someone Else"], ""), None, "no match"),
    (("Three Two One Four", ["Foxes"], ""), "f/1.mp3", "token-similarity(1.00)"),
    (("Silver Lining", ["Dora"], ""), "a/1.mp3", "artist[0]"),
    (("Hidden Gem", ["Evan"], ""), "e/1.mp3", "filename"),
    (("!!!", ["Dora"], ""), None, "empty track name"),
    (("zzz", ["Dora"], ""), None, "no match"),
]


@pytest.mark.parametrize("how", [m.match, m.match_union])
def test_tiers(spark, how):
    got = how(entries(spark, [c[0] for c in CASES]), tracks(spark, LIBRARY)).orderBy("idx").collect()
    assert [(r["path"], r["reason"]) for r in got] == [c[1:] for c in CASES]


def test_near_misses(spark):
    e, t = entries(spark, [("Silver Rain Dance", [], ""), ("nothing here", [], "")]), tracks(spark, LIBRARY)
    got = m.near_misses(e, t).orderBy("idx", "rank").collect()
    assert [(r["idx"], r["rank"], r["path"]) for r in got] == [(1, 1, "a/1.mp3"), (1, 2, "b/1.mp3"), (1, 3, "c/1.mp3")]


def test_cascade_equals_union_on_derived_tables(spark):
    e, t = playlist(spark, SF).persist(), library(spark, SF).persist()
    cols = ["idx", "path", "score", "reason"]
    a, b = m.match(e, t).select(*cols), m.match_union(e, t).select(*cols)
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    s = m.summary(a).first()
    assert s["total"] == 200 and s["matched"] + s["missing"] == 200


def test_similarity_tiers_use_no_nested_loop(spark):
    e, t = playlist(spark, SF), library(spark, SF)
    plan = m.candidates(e, t)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fallbacks_of_untagged_tracks(spark):
    rows = [("Ann/Blue (1999)/Ann - Sky.mp3", "", "", "", ""), ("Ann/Blue (1999)/03 - Sky.mp3", "", "", "", ""), ("Sky.mp3", "", "", "", ""), ("x/y.mp3", "T", "B feat. C", "A; b", "")]
    tags = spark.createDataFrame(rows, "path string, title string, artist string, album_artist string, album string")
    got = m.tagged_tracks(tags).collect()
    assert [(r["title"], r["artists"], r["album"]) for r in got] == [("Sky", ["Ann"], "Blue"), ("Sky", ["Ann"], "Blue"), ("Sky", ["Unknown Artist"], "Unknown Album"), ("T", ["A", "b", "C"], "Unknown Album")]


def common_word_tables(spark, n=240):
    """Titles of which most have one word; entries that share it with all of them."""
    import random

    r = random.Random(5)
    title = lambda: " ".join((["the"] if r.random() < 0.8 else []) + [f"w{r.randrange(60)}" for _ in range(r.randint(1, 4))])
    rows = [(f"{i}.mp3", title(), [f"Artist Number{i % 7}"], "A", f"{i}.mp3") for i in range(n)]
    wanted = [(title(), [f"Number{i % 9}"] if i % 3 else [], "B") for i in range(n // 2)] + [("the", [], ""), ("The", ["Number1"], "")]
    return entries(spark, wanted), tracks(spark, rows)


def test_common_words_equal_brute_force(spark):
    e, t = common_word_tables(spark)
    left, right = e.collect(), t.collect()
    same = lambda a, b: a == b or any(len(x) >= 5 and len(y) > len(x) and f" {x} " in f" {y} " for x, y in ((a, b), (b, a)))
    gate = lambda x, y: not any(x["artist_norms"]) or any(same(a, b) for a in x["artist_norms"] for b in y["norm_artists"] if a)
    words = lambda s: set(s.split())
    overlap = lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b))
    holds = lambda a, b: min(len(a), len(b)) >= 4 and (f" {a} " in f" {b} " or f" {b} " in f" {a} ")
    keys = e.where("norm_title <> ''").select(*m.KEY).distinct()
    near = {(r["norm_title"], tuple(r["artist_norms"]), r["path"], round(r["overlap"], 9)) for r in m.overlapping_pairs(keys, t).collect()}
    held = {(r["norm_title"], tuple(r["artist_norms"]), r["text"]) for r in m.holding_pairs(keys, t, "norm_title").collect()}
    first = {}
    for y in right:
        for a in y["norm_artists"]:
            first[y["norm_title"], a] = min(y["path"], first.get((y["norm_title"], a), "~"))
        first[y["norm_title"], None] = min(y["path"], first.get((y["norm_title"], None), "~"))
    want_near, want_held = set(), set()
    for x in left:
        for y in right:
            if gate(x, y):
                named = any(x["artist_norms"])
                path = min(first[y["norm_title"], a] for a in y["norm_artists"]) if named else first[y["norm_title"], None]
                if overlap(x["norm_title"], y["norm_title"]) >= 0.6:
                    want_near.add((x["norm_title"], tuple(x["artist_norms"]), path, round(overlap(x["norm_title"], y["norm_title"]), 9)))
                if holds(x["norm_title"], y["norm_title"]):
                    want_held.add((x["norm_title"], tuple(x["artist_norms"]), y["norm_title"]))
    assert want_near <= near and held == want_held and {(a, b, d) for a, b, _, d in near} == {(a, b, d) for a, b, _, d in want_near}


@pytest.mark.parametrize("frequent", [0, 3, 20, 1000])
def test_near_misses_equal_brute_force(spark, frequent):
    e, t = common_word_tables(spark)
    got = {}
    for r in m.near_misses(e, t, 3, frequent).collect():
        got.setdefault(r["idx"], []).append((r["rank"], r["path"], round(r["overlap"], 9)))
    right = t.collect()
    paths = {}
    for y in sorted(right, key=lambda y: y["path"]):
        paths.setdefault(y["norm_title"], []).append(y["path"])
    for x in e.collect():
        own, found = set(x["norm_title"].split()), []
        for title, some in paths.items():
            both = set(title.split())
            if own & both:
                found += [(-len(own & both) / len(own | both), p) for p in some[:3]]
        assert sorted(got.get(x["idx"], [])) == [(i + 1, p, round(-o, 9)) for i, (o, p) in enumerate(sorted(found)[:3])]


def test_a_common_word_makes_no_pairs(spark):
    """Join keys of the similarity tiers stay as many as titles, though every title has one word."""
    from pyspark.sql import functions as F

    rows = [(f"the song{i} of{i}",) for i in range(500)]
    order = m.rare_first(spark.createDataFrame(rows, "text string"), spark.createDataFrame(rows[:100], "text string")).collect()
    assert len(order) == 500 and all(r["words"][-1] == "the" and len(r["words"]) == 3 for r in order)
    e, t = entries(spark, [(x[0], [], "") for x in rows]), tracks(spark, [(f"{i}.mp3", x[0], ["A"], "", "f") for i, x in enumerate(rows)])
    assert m.overlapping_pairs(e.select(*m.KEY), t).count() == 500
    joined = m.rare_first(e.select(F.col("norm_title").alias("text")), t.select(F.col("norm_title").alias("text")))
    keys = joined.select(F.explode(F.slice("words", 1, 2)).alias("word")).groupBy("word").count()
    assert keys.agg(F.sum(F.col("count") * F.col("count"))).first()[0] <= 2 * 500
