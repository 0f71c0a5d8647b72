"""Similarity predicates over key forms and token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import fixed


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def contains_words(hay: Column, needle: Column) -> Column:
    """The needle stands in the hay between spaces or ends. Key forms have single spaces only."""
    return (needle != "") & F.contains(_padded(hay), _padded(needle))


def word_aligned(a: Column, b: Column, least: int = fixed.MIN_TITLE_RUNES) -> Column:
    """Either holds the other as whole words, and the shorter has ``least`` characters."""
    fits = F.least(F.char_length(a), F.char_length(b)) >= least
    return fits & (a != "") & (b != "") & (contains_words(a, b) | contains_words(b, a))


def share_token(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / all_).otherwise(F.lit(0.0))


def artist_contains(long: Column, short: Column) -> Column:
    n = F.char_length(short)
    return (n >= fixed.MIN_ARTIST_RUNES) & (F.char_length(long) > n) & contains_words(long, short)


def same_artist(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & ((a == b) | artist_contains(a, b) | artist_contains(b, a))


def shares_artist(a: Column, b: Column) -> Column:
    """Some artist of a is, or as whole words holds or lies in, one of b. Key forms."""
    return F.exists(a, lambda x: F.exists(b, lambda y: same_artist(x, y)))
