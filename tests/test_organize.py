"""Layouts, canonical folders, plans and programs, on tables and on real folders."""

import os

import pytest

from larkspur.config import OrganizeConfig, PlaylistConfig
from larkspur.operators.canonical import canonical
from larkspur.operators.layout import LAYOUTS, layout, render
from larkspur.operators.merge import content_duplicates, unique_names
from larkspur.plans.programs import match_playlist, organize
from larkspur.sources.playlist import read_playlist, resolve_headers
from larkspur.sources.tags import parse

META = "artist string, album_artist string, album string, title string, genre string, year int, track_no int, disc_no int, disc_total int, ext string"


def id3(**tags):
    names = {"title": b"TIT2", "artist": b"TPE1", "album_artist": b"TPE2", "album": b"TALB", "year": b"TYER", "track": b"TRCK", "disc": b"TPOS", "genre": b"TCON"}
    frames = b""
    for k, v in tags.items():
        body = b"\x01" + v.encode("utf-16")
        frames += names[k] + len(body).to_bytes(4, "big") + b"\0\0" + body
    n = len(frames)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frames + b"audio"


def put(root, rel, data=b"x"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_layouts(spark):
    full = ("Ann", "Various", "Blue/Green", "Sky?", "Pop", 2001, 3, 2, 2, ".mp3")
    bare = ("Ann", "", "", "Sky", "", 0, 0, 0, 0, ".ogg")
    df = spark.createDataFrame([full, bare], META)
    got = {n: [r["dest"] for r in render(df, x).collect()] for n, x in LAYOUTS.items()}
    assert got["artist-album-year"] == ["Ann/Blue_Green (2001)/2-03 - Ann - Sky_.mp3", "Ann/Unknown Album/Ann - Sky.ogg"]
    assert got["artist-album"][0] == "Ann/Blue_Green/2-03 - Ann - Sky_.mp3"
    assert got["albumartist-album-year"] == ["Various/Blue_Green (2001)/2-03 - Ann - Sky_.mp3", "Ann/Unknown Album/Ann - Sky.ogg"]
    assert got["flat"][0] == "2-03 - Ann - Blue_Green - Sky_.mp3"
    assert got["genre-artist-album-year"][1] == "Unknown Genre/Ann/Unknown Album/Ann - Sky.ogg"
    assert [r["dest"] for r in render(df, LAYOUTS["artist-album"], numbers=False).collect()][0] == "Ann/Blue_Green/Ann - Sky_.mp3"
    with pytest.raises(ValueError, match="artist-album-year, artist-album"):
        layout("nope")


def test_canonical(spark):
    rows = [("k", "LOUD", "LOUD", 2), ("k", "Loud", "Loud", 2), ("k", "loud", "loud", 1), ("m", "Blue", "Blue", 1), ("m", "Blue (Deluxe)", "Blue (Deluxe)", 1)]
    df = spark.createDataFrame(rows, "key string, on_disk string, dir string, file_count int")
    assert {r["key"]: (r["on_disk"], r["members"]) for r in canonical(df, "key").collect()} == {"k": ("Loud", 3), "m": ("Blue (Deluxe)", 2)}


def test_unique_names_and_content(spark):
    wanted = spark.createDataFrame([("a", "d/x.mp3"), ("b", "d/x.mp3"), ("c", "d/x.mp3"), ("e", "d/y")], "src string, dest string")
    taken = spark.createDataFrame([("d/x.mp3",), ("d/x (3).mp3",), ("d/x (02).mp3",)], "path string")
    got = {r["src"]: r["renamed"] for r in unique_names(wanted, taken).collect()}
    assert got == {"a": "d/x (2).mp3", "b": "d/x (4).mp3", "c": "d/x (5).mp3", "e": "d/y (2)"}
    files = spark.createDataFrame([(3, 5, "h"), (1, 5, "h"), (2, 6, "h")], "id int, length int, digest string")
    assert {r["id"]: (r["keep"], r["is_duplicate"]) for r in content_duplicates(files).collect()} == {3: (1, True), 1: (1, False), 2: (None, False)}


def test_playlist_csv(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text('Track URI,Title, Track Name ,Artist Name(s),Artist,Duration (ms)\nu1,t," Sky, ""Blue""\nX",Ann; Bo,no,261600\nu2,t,  ,A,b,1\nu3,t,Short\n', encoding="utf-8")
    got = read_playlist(spark, str(p)).orderBy("idx").collect()
    assert [(r["idx"], r["uri"], r["track_name"], r["artists"], r["duration"]) for r in got] == [(1, "u1", 'Sky, "Blue"\nX', ["Ann", "Bo"], 261), (2, "u3", "Short", [], 0)]
    assert resolve_headers(["x", "TITLE", "title"])["track_name"] == 2
    with pytest.raises(ValueError, match="track name"):
        resolve_headers(["x"])


def test_tags():
    assert parse(id3(title="Sky", artist="Ann", year="2001", track="3/9", disc="1/2")) == {"title": "Sky", "artist": "Ann", "year": 2001, "track_no": 3, "disc_no": 1, "disc_total": 2}
    comments = b"".join(len(c).to_bytes(4, "little") + c for c in (b"TITLE=Sky", b"ALBUMARTIST=Ann", b"DATE=2001-05-01", b"TRACKNUMBER=4"))
    block = (1).to_bytes(4, "little") + b"v" + (4).to_bytes(4, "little") + comments
    flac = b"fLaC" + b"\x84" + len(block).to_bytes(3, "big") + block
    assert parse(flac) == {"title": "Sky", "album_artist": "Ann", "year": 2001, "track_no": 4}
    packet = b"OpusTags" + block
    page = lambda d: b"OggS" + bytes(22) + bytes([1, len(d)]) + d
    assert parse(page(b"OpusHead") + page(packet))["title"] == "Sky"
    atom = lambda n, b: (len(b) + 8).to_bytes(4, "big") + n + b
    data = lambda b: atom(b"data", bytes(8) + b)
    ilst = atom(b"ilst", atom(b"\xa9nam", data(b"Sky")) + atom(b"trkn", data(bytes([0, 0, 0, 7, 0, 9, 0, 0]))))
    assert parse(atom(b"ftyp", b"M4A ") + atom(b"moov", atom(b"udta", atom(b"meta", bytes(4) + ilst)))) == {"title": "Sky", "track_no": 7}
    assert parse(bytes(200) + b"TAG" + b"Sky".ljust(30, b"\0") + bytes(90) + bytes(5))["title"] == "Sky"
    assert parse(b"") == {} and parse(b"ID3") == {} and parse(b"fLaC\x84") == {}


def test_match_program(spark, tmp_path):
    lib = tmp_path / "lib"
    put(lib, "Ann/Blue (1999)/01 - Sky.mp3", id3(title="Sky", artist="Ann", album="Blue"))
    put(lib, "Bo/Red/Bo - Sun.mp3")
    put(lib, "notes.txt")
    csv = tmp_path / "p.csv"
    csv.write_text("Track Name,Artist,Album,Duration (ms)\nSun,Bo,Red,2000\nSky (Live),Ann,Blue,1999\nLost Sky,Cy,,\n", encoding="utf-8")
    out = tmp_path / "o.m3u"
    got = match_playlist(spark, PlaylistConfig(str(csv), str(lib), str(out), "/sd/", recursive=True, debug=True))
    assert (got["total"], got["matched"], got["missing"]) == (3, 2, 1)
    assert out.read_text() == "#EXTM3U\n#EXTINF:2,Bo - Sun\n/sd/Bo/Red/Bo - Sun.mp3\n#EXTINF:1,Ann - Sky\n/sd/Ann/Blue (1999)/01 - Sky.mp3\n"
    assert "[0.50] Ann/Blue" in got["report"][0]


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def seed(tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    put(dst, "Loud/Blue (1999)/a.mp3", b"same")
    put(dst, "Loud/Blue (1999)/b.mp3", b"one")
    put(dst, "Loud/Blue (1999)/d.mp3", b"kept")
    put(dst, "LOUD/Blue/a.mp3", b"same")
    put(dst, "LOUD/Blue/b.mp3", b"two")
    put(dst, "LOUD/Red/c.mp3", b"c")
    put(src, "x.mp3", id3(title="New", artist="loud/Guest", album="Blue", year="1999", track="7"))
    put(src, "y.mp3", id3(title="New", artist="loud", album="blue", year="1999", track="7"))
    return src, dst


def test_organize_program(spark, tmp_path):
    src, dst = seed(tmp_path)
    got = organize(spark, OrganizeConfig(src, dst))
    assert tree(dst) == ["Loud/Blue (1999)/07 - loud - New.mp3", "Loud/Blue (1999)/a.mp3", "Loud/Blue (1999)/b (2).mp3", "Loud/Blue (1999)/b.mp3", "Loud/Blue (1999)/d.mp3", "Loud/Red/c.mp3"]
    assert open(os.path.join(dst, "Loud/Blue (1999)/b (2).mp3"), "rb").read() == b"two"
    assert not os.path.exists(os.path.join(dst, "LOUD")) and tree(src) == ["y.mp3"]
    assert (got["consolidated"], got["renamed_on_merge"], got["moved"], got["errors"]) == (2, 1, 1, 0)


def test_organize_dry_run_changes_nothing(spark, tmp_path):
    src, dst = seed(tmp_path)
    before = tree(tmp_path)
    got = organize(spark, OrganizeConfig(src, dst, dry_run=True))
    assert tree(tmp_path) == before and got["moved"] == 1
    assert organize(spark, OrganizeConfig(str(tmp_path / "none"), dst, consolidate=False, dry_run=True))["total"] == 0 if os.path.isdir(tmp_path / "none") else True
