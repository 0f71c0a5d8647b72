"""Audio tags from file heads: ID3v2 and ID3v1, Vorbis comments (FLAC, Ogg, Opus), MP4 atoms.

Tags are binary structures, so Python reads them on executors, each file through a memory map: only the
pages that a tag lies in are read, however long the file is. An unreadable tag is an empty one.
"""

from __future__ import annotations

import contextlib
import mmap
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["title", "artist", "album_artist", "album", "genre"]
NUMBERS = ["year", "track_no", "disc_no", "disc_total"]
SCHEMA = "path string, " + ", ".join(f"{f} string" for f in FIELDS) + ", " + ", ".join(f"{n} int" for n in NUMBERS)
ID3 = {"TIT2": "title", "TT2": "title", "TPE1": "artist", "TP1": "artist", "TPE2": "album_artist", "TP2": "album_artist", "TALB": "album", "TAL": "album", "TCON": "genre", "TCO": "genre"}
ID3_NUMBERS = {"TYER": "year", "TYE": "year", "TDRC": "year", "TRCK": "track", "TRK": "track", "TPOS": "disc", "TPA": "disc"}
VORBIS = {"title": "title", "artist": "artist", "albumartist": "album_artist", "album artist": "album_artist", "album": "album", "genre": "genre"}
VORBIS_NUMBERS = {"date": "year", "year": "year", "tracknumber": "track", "discnumber": "disc", "disctotal": "of", "totaldiscs": "of"}
MP4 = {b"\xa9nam": "title", b"\xa9ART": "artist", b"aART": "album_artist", b"\xa9alb": "album", b"\xa9gen": "genre"}


def number(tag: dict, kind: str, text: str) -> None:
    """Takes a year, or "n" or "n/total" of a track or disc."""
    if kind == "year":
        m = re.search(r"\d{4}", text)
        tag.setdefault("year", int(m[0]) if m else 0)
    elif kind == "of":
        tag["disc_total"] = int(text) if text.strip().isdigit() else 0
    elif m := re.match(r"\s*(\d{1,9})(?:\s*/\s*(\d{1,9}))?", text):
        tag[f"{kind}_no"] = int(m[1])
        if kind == "disc" and m[2]:
            tag["disc_total"] = int(m[2])


def synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3_text(body: bytes) -> str:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
    return body[1:].decode(kind, "replace").split("\0")[0].strip("﻿")


def id3v2(data: bytes) -> dict:
    major, flags, size = data[3], data[5], synchsafe(data[6:10])
    body, at, tag = data[10 : 10 + size], 0, {}
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and major > 2:
        at = synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    head, wide = (6, 3) if major == 2 else (10, 4)
    while at + head <= len(body) and body[at]:
        name = body[at : at + wide].decode("latin-1")
        raw = body[at + wide : at + 2 * wide]
        n = synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        frame = body[at + head : at + head + n]
        if name in ID3:
            tag.setdefault(ID3[name], id3_text(frame))
        elif name in ID3_NUMBERS:
            number(tag, ID3_NUMBERS[name], id3_text(frame))
        at += head + n
    return tag


def id3v1(data: bytes) -> dict:
    t = data[-128:]
    text = lambda a, b: t[a:b].split(b"\0")[0].decode("latin-1").strip()
    tag = {"title": text(3, 33), "artist": text(33, 63), "album": text(63, 93)}
    number(tag, "year", text(93, 97))
    if t[125] == 0 and t[126]:
        tag["track_no"] = t[126]
    return tag


def vorbis(data: bytes) -> dict:
    at = 4 + struct.unpack_from("<I", data)[0]
    (n,) = struct.unpack_from("<I", data, at)
    at, tag = at + 4, {}
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        name, _, value = data[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        at += 4 + size
        if (name := name.lower()) in VORBIS:
            tag.setdefault(VORBIS[name], value)
        elif name in VORBIS_NUMBERS:
            number(tag, VORBIS_NUMBERS[name], value)
    return tag


def flac(data: bytes) -> dict:
    at = 4
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 127 == 4:
            return vorbis(data[at + 4 : at + 4 + size])
        if kind & 128:
            break
        at += 4 + size
    return {}


def ogg(data: bytes) -> dict:
    """The second packet holds the comments; packets run through pages."""
    at, packets, open_ = 0, [], b""
    while data[at : at + 4] == b"OggS" and len(packets) < 2:
        sizes = data[at + 27 : at + 27 + data[at + 26]]
        at += 27 + len(sizes)
        for s in sizes:
            open_ += data[at : at + s]
            at += s
            if s < 255:
                packets.append(open_)
                open_ = b""
    for p in packets:
        if p[:7] == b"\x03vorbis":
            return vorbis(p[7:])
        if p[:8] == b"OpusTags":
            return vorbis(p[8:])
    return {}


def atoms(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the atoms in a range of the data."""
    end = len(data) if end is None else min(end, len(data))
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head:
            return
        yield data[at + 4 : at + 8], at + head, min(at + size, end)
        at += size


def mp4(data: bytes) -> dict:
    def inside(name: bytes, at: int, end: int) -> tuple[int, int]:
        return next(((a, z) for n, a, z in atoms(data, at, end) if n == name), (0, 0))

    at, end = inside(b"meta", *inside(b"udta", *inside(b"moov", 0, len(data))))
    tag: dict = {}
    for name, a, z in atoms(data, *inside(b"ilst", at + 4, end)):
        a, z = inside(b"data", a, z)
        value = data[a + 8 : z]
        if name in MP4:
            tag[MP4[name]] = value.decode("utf-8", "replace")
        elif name == b"\xa9day":
            number(tag, "year", value.decode("utf-8", "replace"))
        elif name in (b"trkn", b"disk") and len(value) >= 6:
            kind = "track" if name == b"trkn" else "disc"
            number(tag, kind, f"{int.from_bytes(value[2:4], 'big')}/{int.from_bytes(value[4:6], 'big')}")
    return tag


def parse(data: bytes) -> dict:
    """The tag of a file's bytes; {} if there is none or it is broken."""
    try:
        if data[:3] == b"ID3":
            return id3v2(data)
        if data[:4] == b"fLaC":
            return flac(data)
        if data[:4] == b"OggS":
            return ogg(data)
        if data[4:8] == b"ftyp":
            return mp4(data)
        if len(data) >= 128 and data[-128:-125] == b"TAG":
            return id3v1(data)
    except (IndexError, struct.error, ValueError):
        pass
    return {}


def read_file(path: str) -> dict:
    """The tag of a file; {} if it cannot be read."""
    with contextlib.suppress(OSError, ValueError), open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        return parse(data)
    return {}


def read_tags(files: DataFrame) -> DataFrame:
    """The tags of (path, file), file being where it lies; missing texts are '', missing numbers 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = [read_file(f) for f in b.column(1).to_pylist()]
            columns = [pa.array([t.get(f) or "" for t in tags], pa.string()) for f in FIELDS]
            columns += [pa.array([t.get(n) or 0 for t in tags], pa.int32()) for n in NUMBERS]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["path", *FIELDS, *NUMBERS])

    return files.select("path", "file").mapInArrow(run, SCHEMA)


def scan_tags(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Tags of the audio files below ``root``, by path relative to it."""
    from larkspur.sources.tree import list_audio

    files = list_audio(spark, root, recursive)
    rel = F.substring_index("file", root.rstrip("/") + "/", -1)
    return read_tags(files.select(rel.alias("path"), "file"))

