"""Text normalization as native Column expressions.

Patterns spell out white space as [\\t\\n\\f\\r ], use \\z for the end of the text and [^\\n] for any
character, so that Java's regular expressions mean what RE2's do (DuckDB runs the same patterns).
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import fixed

WS = r"[\t\n\f\r ]"
#: White space in the sense of Unicode, for trimming.
UNICODE_WS = "\\t\\n\\x0B\\f\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_WORDS = "|".join
BRACKET = rf"(?iu){WS}*[(\[][^)\]]*?(?:{_WORDS(fixed.BRACKET_NOTES).replace('.*', '[^\n]*')})[^)\]]*[)\]]{WS}*"
DASH = rf"(?iu){WS}+-{WS}+[^-]*?(?:{_WORDS(fixed.DASH_NOTES).replace('.*', '[^\n]*')})[^-]*\z"
TAIL = rf"(?iu){WS}+(?:{fixed.GUEST}){WS}+[^\n]*\z"
GUESTS = r"feat|ft|with"
PUNCTUATION = r"[^\p{L}\p{N}\t\n\f\r ]+"
ARTIST_SPLIT = rf"(?iu){WS}*;{WS}*|{WS}+(?:{fixed.JOINS}){WS}+"
FOLDER_SPLIT = rf"(?iu){WS}*[;/]{WS}*|{WS}+(?:{fixed.JOINS}){WS}+"
YEAR = rf"{WS}*\(\d{{4}}\){WS}*\z"


@cache
def accents() -> tuple[str, str]:
    """Characters whose decomposition without marks composes to one other character, and that character."""
    pairs = []
    for code in range(0x80, 0x30000):
        c = chr(code)
        how = unicodedata.decomposition(c)
        if not how or how[0] == "<":
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        to = unicodedata.normalize("NFC", plain)
        if len(to) == 1 and to != c:
            pairs.append((c, to))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def utrim(c: Column) -> Column:
    """Trims Unicode white space."""
    return F.regexp_replace(c, f"^[{UNICODE_WS}]+|[{UNICODE_WS}]+\\z", "")


def lower(c: Column) -> Column:
    """Lower case letter by letter: a final sigma is an ordinary one."""
    return F.lower(F.replace(c, F.lit("Σ"), F.lit("σ")))


def fold(c: Column) -> Column:
    """Drops diacritics."""
    plain = F.regexp_replace(F.translate(c, *accents()), r"\p{Mn}+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c)


def strip_notes(c: Column) -> Column:
    """Strips version notes and guests until nothing changes: as often as the text has places for one."""

    def once(v: Column) -> Column:
        # A pattern is tried only where the text has what it begins with.
        v = F.when(F.contains(v, F.lit("(")) | F.contains(v, F.lit("[")), F.regexp_replace(v, BRACKET, " ")).otherwise(v)
        v = F.when(F.contains(v, F.lit("-")), F.regexp_replace(v, DASH, "")).otherwise(v)
        return F.when(v.rlike(GUESTS), F.regexp_replace(v, TAIL, "")).otherwise(v)

    # The state is the last two values; once they agree the remaining turns do nothing.
    places = F.regexp_count(c, F.lit(rf"[-(\[]|{GUESTS}"))
    turns = F.sequence(F.lit(0), F.greatest(places, F.lit(1)))
    start = F.array(F.lit(None).cast("string"), c)
    step = lambda a, _: F.when(a[0].eqNullSafe(a[1]), a).otherwise(F.array(a[1], once(a[1])))
    return F.when(places > 0, F.aggregate(turns, start, step, lambda a: a[1])).otherwise(c)


def normalize(c: Column) -> Column:
    """The key form: lower case, no diacritics, notes or punctuation, single spaces. Null is ''."""
    v = strip_notes(fold(utrim(lower(F.coalesce(c, F.lit(""))))))
    # Blanks are neither letters nor numbers, so one pattern replaces punctuation and joins blanks.
    return F.trim(F.regexp_replace(v, r"[^\p{L}\p{N}]+", " "))


def distinct_names(names: Column) -> Column:
    """Trimmed, without blanks; of names equal but for case and diacritics the first stays."""
    start = F.array().cast("array<struct<name: string, key: string>>")

    def add(acc: Column, raw: Column) -> Column:
        name = utrim(raw)
        key = lower(fold(name))
        known = (name == "") | F.exists(acc, lambda a: a["key"] == key)
        return F.when(known, acc).otherwise(F.concat(acc, F.array(F.struct(name.alias("name"), key.alias("key")))))

    return F.aggregate(names, start, add, lambda acc: F.transform(acc, lambda a: a["name"]))


def split_artists(c: Column) -> Column:
    """The artists of a tag or cell: cut at ; and feat/ft/featuring/with/vs."""
    return distinct_names(F.split(F.coalesce(c, F.lit("")), ARTIST_SPLIT, -1))


def primary_artist(c: Column) -> Column:
    """The leading artist for a folder name; / separates too."""
    return F.coalesce(F.get(distinct_names(F.split(F.coalesce(c, F.lit("")), FOLDER_SPLIT, -1)), F.lit(0)), F.lit(""))


def normalize_all(names: Column) -> Column:
    """Each name's key form, '' where nothing is left; positions are those of ``names``."""
    return F.transform(names, normalize)


def without_blanks(names: Column) -> Column:
    return F.filter(names, lambda x: x != "")


def tokens(norm: Column) -> Column:
    """The set of tokens of a key form."""
    return F.array_distinct(without_blanks(F.split(norm, " ", -1)))


def without_year(c: Column) -> Column:
    return F.regexp_replace(c, YEAR, "")


def album_key(c: Column) -> Column:
    return normalize(without_year(F.coalesce(c, F.lit(""))))


def sanitize(c: Column) -> Column:
    """A file name: each run of illegal characters is one _; the names . and .. become _."""
    s = F.regexp_replace(c, fixed.ILLEGAL, "_")
    return F.when(s.isin(".", ".."), F.lit("_")).otherwise(s)


def all_caps(c: Column) -> Column:
    return c.rlike("[A-Z]") & ~c.rlike("[a-z]")


def or_default(c: Column, default: str) -> Column:
    v = F.coalesce(c, F.lit(""))
    return F.when(utrim(v) == "", F.lit(default)).otherwise(v)


def key(*parts: Column) -> Column:
    """Parts joined by U+001F, for where a join needs a single column."""
    return F.concat_ws("\u001f", *parts)


def seconds(ms: Column) -> Column:
    """Milliseconds as text to whole seconds; 0 for anything but an integer."""
    v = utrim(F.coalesce(ms, F.lit("")))
    n = F.when(v.rlike(r"^[+-]?[0-9]+\z"), v.try_cast("bigint"))
    # Truncates towards zero, as integer division does.
    return F.coalesce((n - n % 1000) / 1000, F.lit(0)).cast("bigint")
