"""Tags from real containers on disk, heads of files, and plans applied to folders."""

import hashlib
import os
import struct
import wave
import zlib

import pytest
from larkspur.sinks.apply import apply_plan
from larkspur.sources.tags import read_file, scan_tags
from larkspur.sources.tree import heads, list_audio, list_tree

from tests.test_organize import id3, put, tree


def ogg_pages(packets):
    """Ogg pages with checksums and packets that run over several pages, as encoders write them."""
    out, serial = b"", 7
    for number, packet in enumerate(packets):
        laces = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        for k in range(0, len(laces), 200):
            some = laces[k : k + 200]
            body = packet[at : at + sum(some)]
            at += sum(some)
            out += b"OggS" + bytes([0, (k > 0) | (number == 0) << 1]) + bytes(8) + struct.pack("<III", serial, number, zlib.crc32(body)) + bytes([len(some), *some]) + body
    return out


def comments(*pairs):
    body = (4).to_bytes(4, "little") + b"test" + len(pairs).to_bytes(4, "little")
    for p in pairs:
        body += len(p.encode()).to_bytes(4, "little") + p.encode()
    return body


def test_tags_of_files_with_long_contents(spark, tmp_path):
    long = bytes(3 << 20)
    put(tmp_path, "a/one.mp3", id3(title="Été", artist="Ann", album="Blue", track="2/9") + long)
    put(tmp_path, "a/two.flac", b"fLaC" + b"\0\0\0\x22" + bytes(34) + b"\x84" + len(comments("TITLE=Sky", "ARTIST=Bo")).to_bytes(3, "big") + comments("TITLE=Sky", "ARTIST=Bo") + long)
    put(tmp_path, "a/three.ogg", ogg_pages([b"\x01vorbis" + bytes(23), b"\x03vorbis" + comments("TITLE=" + "x" * 70_000, "album=Red") + b"\x01"]) + long)
    atom = lambda n, b: (len(b) + 8).to_bytes(4, "big") + n + b
    data = lambda b: atom(b"data", bytes(8) + b)
    ilst = atom(b"ilst", atom(b"\xa9nam", data(b"Last")) + atom(b"disk", data(bytes([0, 0, 0, 1, 0, 2]))))
    put(tmp_path, "a/four.m4a", atom(b"ftyp", b"M4A ") + atom(b"mdat", long) + atom(b"moov", atom(b"mvhd", bytes(100)) + atom(b"udta", atom(b"meta", bytes(4) + atom(b"hdlr", bytes(25)) + ilst))))
    put(tmp_path, "b/five.mp3", long + b"TAG" + b"Old".ljust(30, b"\0") + b"Cy".ljust(30, b"\0") + bytes(65))
    with wave.open(str(tmp_path / "b" / "six.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(bytes(1600))
    put(tmp_path, "b/seven.mp3", b"")
    put(tmp_path, "b/notes.txt", b"no audio")
    got = {r["path"]: r for r in scan_tags(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a/four.m4a", "a/one.mp3", "a/three.ogg", "a/two.flac", "b/five.mp3", "b/seven.mp3", "b/six.wav"]
    assert (got["a/one.mp3"]["title"], got["a/one.mp3"]["track_no"]) == ("Été", 2) and got["a/two.flac"]["artist"] == "Bo"
    assert got["a/three.ogg"]["title"] == "x" * 70_000 and got["a/three.ogg"]["album"] == "Red"
    assert (got["a/four.m4a"]["title"], got["a/four.m4a"]["disc_no"], got["a/four.m4a"]["disc_total"]) == ("Last", 1, 2)
    assert (got["b/five.mp3"]["title"], got["b/five.mp3"]["artist"]) == ("Old", "Cy") and got["b/seven.mp3"]["title"] == "" == got["b/six.wav"]["title"]
    assert read_file(str(tmp_path / "none.mp3")) == {}
    assert list_audio(spark, str(tmp_path)).where("length = 0").count() == 1 and list_audio(spark, str(tmp_path), recursive=False).count() == 0


def test_tree_is_walked_by_folder(spark, tmp_path):
    for name in ("x/a.mp3", "x/y/b.mp3", "x/y/z/c.txt", "w/d.mp3", "top.mp3"):
        put(tmp_path, name)
    os.makedirs(tmp_path / "empty" / "inner")
    os.symlink(tmp_path / "x", tmp_path / "link")
    got = {r["rel"]: (r["path"], r["is_dir"], r["length"]) for r in list_tree(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["empty", "empty/inner", "link", "top.mp3", "w", "w/d.mp3", "x", "x/a.mp3", "x/y", "x/y/b.mp3", "x/y/z", "x/y/z/c.txt"]
    assert got["x/y/b.mp3"] == (str(tmp_path / "x/y/b.mp3"), False, 1) and got["x/y"][1] and not got["top.mp3"][1]
    assert list_tree(spark, str(tmp_path / "none")).count() == 0 and sorted(r["rel"] for r in list_tree(spark, str(tmp_path), recursive=False).collect()) == ["empty", "link", "top.mp3", "w", "x"]
    with pytest.raises(OSError):
        list_tree(spark, str(tmp_path / "none"), strict=True)


def test_heads(spark, tmp_path):
    put(tmp_path, "a", b"x" * 100 + b"tail")
    put(tmp_path, "b", b"x" * 100 + b"liat")
    put(tmp_path, "c", b"")
    got = {r["rel"]: (r["length"], r["digest"]) for r in heads(list_tree(spark, str(tmp_path)), 100).collect()}
    assert got["a"] == got["b"] == (104, hashlib.sha1(b"x" * 100).hexdigest()) and got["c"] == (0, hashlib.sha1(b"").hexdigest())


def test_plan_is_applied_once(spark, tmp_path, capsys):
    for name in ("a", "b", "c", "d"):
        put(tmp_path, name, name.encode())
    rows = [("a", "b", "MERGE"), ("b", "x/b", "MERGE"), ("c", "x/c (2)", "RENAME"), ("d", "d", "DROP"), ("none", "y", "MERGE")]
    plan = spark.createDataFrame(rows, "src string, dest string, action string")
    assert apply_plan(plan, str(tmp_path), dry_run=True)["moved"] == 3 and tree(tmp_path) == ["a", "b", "c", "d"]
    done = apply_plan(plan, str(tmp_path), verbose=True)
    assert done == {"moved": 2, "renamed": 1, "dropped": 1, "skipped": 0, "errors": 1}
    assert tree(tmp_path) == ["b", "x/b", "x/c (2)"] and open(os.path.join(tmp_path, "b")).read() == "a"
    assert "[RENAME] c -> x/c (2): renamed" in capsys.readouterr().out
