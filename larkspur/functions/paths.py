"""Paths and file names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import fixed
from larkspur.functions.text import utrim, without_year

TRACK_NUMBER = r"^[0-9]{1,3}\z"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the last part on, with the dot; '' without one."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^./]*\z", "")


def is_audio(path: Column) -> Column:
    return F.lower(extension(path)).isin(fixed.EXTENSIONS)


def is_track_number(c: Column) -> Column:
    return utrim(c).rlike(TRACK_NUMBER)


def artist_and_title(filename: Column) -> Column:
    """struct(artist, title) from "Artist - Title.ext", "NN - Title.ext", "NN. Title.ext", "NN Title.ext"."""
    base = utrim(stem(filename))
    at = F.instr(base, " - ")
    left, right = utrim(F.substring(base, 1, at - 1)), utrim(F.substring(base, at + 3, F.char_length(base)))
    numbered = base.rlike(r"^[0-9]{1,3}[. ]")
    pair = lambda a, t: F.struct(a.alias("artist"), t.alias("title"))
    none = F.lit("")
    split = F.when(right == "", pair(none, left)).when(is_track_number(left), pair(none, right)).otherwise(pair(left, right))
    return (
        F.when(at > 0, split)
        .when(numbered, pair(none, utrim(F.regexp_replace(base, r"^[0-9]{1,3}[. ]+", ""))))
        .otherwise(pair(none, base))
    )


def _part(path: Column, from_end: int) -> Column:
    parts = F.split(path, "/", -1)
    return F.coalesce(F.get(parts, F.size(parts) - from_end), F.lit(""))


def directory_artist(path: Column) -> Column:
    return utrim(_part(path, 3))


def directory_album(path: Column) -> Column:
    return utrim(without_year(utrim(_part(path, 2))))
