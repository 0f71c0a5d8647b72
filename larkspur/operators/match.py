"""Record linkage of a playlist with a library: eight tiers, one winner for each entry.

``match`` goes from tier to tier and sends only what is still open on; ``match_union`` unions all tiers
and takes the best candidate, which gives the same, since a weaker tier never beats a stronger one.
Both sides are first reduced to what a tier can tell apart: entries to distinct (title, album,
artists), tracks to the smallest path of each key. The similarity tiers are equi-joins, never nested
loops, on words chosen by rarity: a text that lies in another one is found by its rarest word, two
texts with a Jaccard similarity of at least t by the rare words that they cannot both lack. So a word
that half of all titles have makes no pairs, unless titles have no other one. An entry that names
artists joins on a linked artist as well; exact predicates then decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.functions import fixed
from larkspur.functions.paths import artist_and_title, basename, directory_album, directory_artist
from larkspur.functions.similarity import contains_words, jaccard, same_artist, share_token, word_aligned
from larkspur.functions.text import normalize, normalize_all, split_artists, tokens, without_blanks
from larkspur.operators.lineage import cut, joined

KEY = ["norm_title", "norm_album", "artist_norms"]
CANDIDATE = [*KEY, "path", "score", "place", "overlap"]


def tagged_tracks(tags: DataFrame) -> DataFrame:
    """path, title, artists, album, filename from (path, title, artist, album_artist, album).

    The album artist comes first, then the artist if it differs; equal names count once, but for case.
    What is missing comes from the file name, then from the folders; the album does so only where title
    or artists were missing.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    lead, other = split_artists(text("album_artist")), split_artists(F.when(text("artist") != text("album_artist"), text("artist")))
    start = F.array().cast("array<string>")
    seen = lambda acc, x: F.exists(acc, lambda a: F.lower(a) == F.lower(x))
    named = F.aggregate(F.concat(lead, other), start, lambda acc, x: F.when(seen(acc, x), acc).otherwise(F.array_append(acc, x)))
    return with_fallbacks(tags.select("path", text("title").alias("title"), named.alias("artists"), text("album").alias("album")))


def with_fallbacks(tracks: DataFrame) -> DataFrame:
    """Fills title, artists and album of (path, title, artists, album)."""
    t = tracks.withColumn("filename", basename(F.col("path"))).withColumn("_guess", artist_and_title(F.col("filename")))
    missing = (F.col("title") == "") | (F.size("artists") == 0)
    guess, folder = F.col("_guess.artist"), directory_artist(F.col("path"))
    artists = (
        F.when(F.size("artists") > 0, F.col("artists")).when(guess != "", F.array(guess)).when(folder != "", F.array(folder))
        .otherwise(F.array(F.lit(fixed.UNKNOWN_ARTIST)))
    )
    album = F.when((F.col("album") == "") & missing, directory_album(F.col("path"))).otherwise(F.col("album"))
    return t.select(
        "path", F.when(F.col("title") == "", F.col("_guess.title")).otherwise(F.col("title")).alias("title"), artists.alias("artists"),
        F.when(album == "", F.lit(fixed.UNKNOWN_ALBUM)).otherwise(album).alias("album"), "filename",
    )


def index_tracks(tracks: DataFrame) -> DataFrame:
    """Adds norm_title, norm_artists, norm_album, norm_filename and title_tokens."""
    t = tracks.withColumns(
        {
            "norm_title": normalize(F.col("title")),
            "norm_artists": F.array_distinct(without_blanks(normalize_all(F.col("artists")))),
            "norm_album": normalize(F.col("album")),
            "norm_filename": normalize(F.col("filename")),
        }
    )
    return t.withColumn("title_tokens", tokens(F.col("norm_title")))


def index_entries(entries: DataFrame) -> DataFrame:
    """Adds norm_title, norm_album and artist_norms ('' where a name has no key form)."""
    return entries.withColumns({"norm_title": normalize(F.col("track_name")), "norm_album": normalize(F.col("album")), "artist_norms": normalize_all(F.col("artists"))})


def _candidate(score: int, place: Column | None = None, overlap: Column | None = None) -> list[Column]:
    none = F.lit(None)
    return [F.lit(score).alias("score"), (none.cast("int") if place is None else place.cast("int")).alias("place"), (none.cast("double") if overlap is None else overlap).alias("overlap")]


def _smallest(tracks: DataFrame, *keys: str | Column) -> DataFrame:
    """One row for each key, with the smallest path: within a tier no other can win."""
    return tracks.groupBy(*keys).agg(F.min("path").alias("path"))


def _by_artist(entries: DataFrame) -> DataFrame:
    """Entries by each named artist, with its place in the list."""
    return entries.select(*KEY, F.posexplode("artist_norms").alias("place", "artist")).where("artist <> ''")


class Shared:
    """What several tiers need of the same tracks, made once: for all entries, so for those left of them too."""

    def __init__(self, entries: DataFrame, tracks: DataFrame):
        self.entries, self.tracks = entries, tracks
        self.made: dict[str, DataFrame] = {}

    def links(self) -> DataFrame:
        """artist, linked: see ``artist_links``."""
        if "" not in self.made:
            artist = lambda d, c: d.select(F.explode(c).alias("artist"))
            self.made[""] = cut(artist_links(artist(self.entries, "artist_norms"), artist(self.tracks, "norm_artists")))
        return self.made[""]

    def order(self, source: str) -> DataFrame:
        """text, words of all titles and of the tracks' column ``source``: see ``rare_first``."""
        if source not in self.made:
            titles, texts = self.entries.select(F.col("norm_title").alias("text")), self.tracks.select(F.col(source).alias("text"))
            self.made[source] = cut(rare_first(titles, texts))
        return self.made[source]


def tier_exact(entries: DataFrame, tracks: DataFrame, shared: Shared | None = None) -> DataFrame:
    t = _smallest(tracks.withColumn("artist", F.explode("norm_artists")), "norm_title", "artist", "norm_album")
    return joined(_by_artist(entries), t, ["norm_title", "artist", "norm_album"]).select(*KEY, "path", *_candidate(fixed.EXACT, F.col("place")))


def tier_title_artist(entries: DataFrame, tracks: DataFrame, shared: Shared | None = None) -> DataFrame:
    t = _smallest(tracks.withColumn("artist", F.explode("norm_artists")), "norm_title", "artist")
    return joined(_by_artist(entries), t, ["norm_title", "artist"]).select(*KEY, "path", *_candidate(fixed.TITLE_ARTIST, F.col("place")))


def tier_title_album(entries: DataFrame, tracks: DataFrame, shared: Shared | None = None) -> DataFrame:
    t = _smallest(tracks, "norm_title", "norm_album")
    return joined(entries.where("norm_album <> ''"), t, ["norm_title", "norm_album"]).select(*KEY, "path", *_candidate(fixed.TITLE_ALBUM))


def tier_title(entries: DataFrame, tracks: DataFrame, shared: Shared | None = None) -> DataFrame:
    """Equal titles; an entry that names artists needs a linked one."""
    gated = gated_entries(entries, (shared or Shared(entries, tracks)).links())
    return joined(gated, _smallest(_gated(tracks), "norm_title", "artist"), ["norm_title", "artist"]).select(*KEY, "path", *_candidate(fixed.TITLE))


def _per_artist(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("artist", F.explode("norm_artists"))


def _gated(tracks: DataFrame) -> DataFrame:
    """Tracks by each artist, and by '', where entries that name no artist find them."""
    names = F.coalesce("norm_artists", F.array().cast("array<string>"))
    return tracks.withColumn("artist", F.explode(F.concat(names, F.array(F.lit("")))))


def _named() -> Column:
    return F.size(without_blanks(F.col("artist_norms"))) > 0


def artist_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """artist, linked: pairs of distinct artists that are the same or hold one another as whole words.

    A holder shares all words of what it holds, so it is enough to join on the rarest of those.
    """
    a, b = left.select("artist").where("artist <> ''"), right.select("artist").where("artist <> ''")
    order = cut(rare_first(a.select(F.col("artist").alias("text")), b.select(F.col("artist").alias("text"))))
    known = lambda d, side: joined(d, order, F.col("artist") == F.col("text")).select("artist", _ways("artist", "words", side, fixed.MIN_ARTIST_RUNES, True)).select("artist", "way.*")
    pairs = joined(known(a.distinct(), 0), known(b.distinct(), 1).withColumnRenamed("artist", "linked"), ["side", "word"])
    return pairs.where(same_artist(F.col("artist"), F.col("linked"))).select("artist", "linked").distinct()


def _ways(text: str, words: str, side: int, least: int, equal: bool = False) -> Column:
    """A row ``way`` (side, word) for each key of a text, with its words in order of rarity, in a join that looks
    for texts of side 0 in those of side 1 and the reverse: at its own side the rarest word, if the text has
    ``least`` characters, at the other side all words. So one join does both. ``equal``: equal texts of any
    length meet too, at side 2."""
    way = lambda at, word: F.struct(F.lit(at).alias("side"), word.alias("word"))
    own = [way(side, F.when(F.char_length(text) >= least, F.get(words, F.lit(0)))), *([way(2, F.col(text))] if equal else [])]
    return F.explode(F.concat(F.array(*own), F.transform(words, lambda x: way(1 - side, x)))).alias("way")


def linked_entries(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Entries that name artists, once for each track artist that is linked with one of them."""
    named = entries.where(_named()).withColumn("named", F.explode(without_blanks(F.array_distinct("artist_norms"))))
    return joined(named, links.withColumnRenamed("artist", "named"), "named").select(*KEY, F.col("linked").alias("artist")).distinct()


def gated_entries(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Entries by each artist where they may find tracks: see ``linked_entries``; '' if they name none."""
    return linked_entries(entries, links).unionByName(entries.where(~_named()).select(*KEY, F.lit("").alias("artist")))


def rare_first(texts: DataFrame, known: DataFrame) -> DataFrame:
    """text, words (its tokens, the rarest in ``known`` first) of the distinct texts of both tables (text)."""
    both = texts.select("text").union(known.select("text")).where("text <> ''").distinct()
    each = both.select("text", F.explode(tokens(F.col("text"))).alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("df"))
    ordered = F.array_sort(F.collect_list(F.struct("df", "word")))
    return joined(each, often, "word").groupBy("text").agg(ordered.alias("o")).select("text", F.transform("o", lambda x: x["word"]).alias("words"))


def _sides(entries: DataFrame, tracks: DataFrame, source: str, shared: Shared | None) -> tuple[DataFrame, DataFrame]:
    """Entries (KEY, artist, ew) and track keys (text, artist, path, words) with their words in order of rarity;
    both join on artist, '' for entries that name none. text is the track's column ``source``."""
    shared = shared or Shared(entries, tracks)
    order = shared.order(source)
    t = _smallest(_gated(tracks.withColumn("text", F.col(source)).where("text <> ''")), "text", "artist")
    e = joined(gated_entries(entries, shared.links()), order.select(F.col("text").alias("norm_title"), F.col("words").alias("ew")), "norm_title")
    return e, joined(t, order, "text")


def _holding(entries: DataFrame, tracks: DataFrame, source: str, shared: Shared | None) -> DataFrame:
    e, t = _sides(entries, tracks, source, shared)
    e = e.select(*KEY, "artist", _ways("norm_title", "ew", 0, fixed.MIN_TITLE_RUNES)).select(*KEY, "artist", "way.*")
    t = t.select("text", "artist", "path", _ways("text", "words", 1, fixed.MIN_TITLE_RUNES)).select("text", "artist", "path", "way.*")
    return joined(e, t, ["artist", "side", "word"]).where(word_aligned(F.col("text"), F.col("norm_title"))).select(*KEY, "text", "path")


def holding_pairs(entries: DataFrame, tracks: DataFrame, source: str, shared: Shared | None = None) -> DataFrame:
    """KEY, text, path where title or text may hold the other: the rarest word of one is in the other."""
    return _holding(entries, tracks, source, shared).distinct()


def _overlapping(entries: DataFrame, tracks: DataFrame, shared: Shared | None, threshold: float) -> DataFrame:
    first = lambda c: F.explode(F.slice(c, F.lit(1), F.size(c) - F.ceil(F.size(c) * threshold - 1e-9).cast("int") + 1))
    e, t = _sides(entries, tracks, "norm_title", shared)
    near = joined(e.withColumn("word", first("ew")), t.withColumn("word", first("words")), ["artist", "word"])
    near = near.where((F.size("ew") >= threshold * F.size("words") - 1e-9) & (F.size("words") >= threshold * F.size("ew") - 1e-9))
    return near.withColumn("overlap", jaccard(F.col("ew"), F.col("words"))).where(F.col("overlap") >= threshold).select(*KEY, "text", "path", "overlap")


def overlapping_pairs(entries: DataFrame, tracks: DataFrame, shared: Shared | None = None, threshold: float = fixed.TOKEN_THRESHOLD) -> DataFrame:
    """KEY, text, path, overlap where the titles' tokens have that Jaccard similarity: of n words in order of
    rarity, two such titles share one among the first n - ceil(threshold * n) + 1 of each."""
    return _overlapping(entries, tracks, shared, threshold).distinct()


def tier_title_part(entries: DataFrame, tracks: DataFrame, shared: Shared | None = None) -> DataFrame:
    return _holding(entries, tracks, "norm_title", shared).select(*KEY, "path", *_candidate(fixed.TITLE_PART))


def tier_tokens(entries: DataFrame, tracks: DataFrame, shared: Shared | None = None) -> DataFrame:
    return _overlapping(entries, tracks, shared, fixed.TOKEN_THRESHOLD).select(*KEY, "path", *_candidate(fixed.TOKENS, None, F.col("overlap")))


def tier_artist(entries: DataFrame, tracks: DataFrame, shared: Shared | None = None) -> DataFrame:
    """Tracks of a named artist whose title shares a token: the smallest path of each artist and token."""
    t = _smallest(_per_artist(tracks).withColumn("word", F.explode(tokens(F.col("norm_title")))), "artist", "word")
    e = _by_artist(entries).withColumn("word", F.explode(tokens(F.col("norm_title"))))
    return joined(e, t, ["artist", "word"]).select(*KEY, "path", *_candidate(fixed.ARTIST, F.col("place")))


def tier_filename(entries: DataFrame, tracks: DataFrame, shared: Shared | None = None) -> DataFrame:
    return _holding(entries, tracks, "norm_filename", shared).select(*KEY, "path", *_candidate(fixed.FILENAME))


TIERS = {
    "exact": tier_exact, "title_artist": tier_title_artist, "title_album": tier_title_album, "title": tier_title,
    "title_part": tier_title_part, "tokens": tier_tokens, "artist": tier_artist, "filename": tier_filename,
}


def reason() -> Column:
    """The reason of a candidate as text; overlaps rounded half to even."""
    at = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("]"))
    overlap = F.format_string("%.2f", F.bround("overlap", 2))
    return (
        F.when(F.col("score") == fixed.EXACT, F.concat(F.lit("title+artist+album"), at))
        .when(F.col("score") == fixed.TITLE_ARTIST, F.concat(F.lit("title+artist"), at))
        .when(F.col("score") == fixed.TITLE_ALBUM, F.lit("title+album"))
        .when(F.col("score") == fixed.TITLE, F.lit("title"))
        .when(F.col("score") == fixed.TITLE_PART, F.lit("title-substring"))
        .when(F.col("score") == fixed.TOKENS, F.concat(F.lit("token-similarity("), overlap, F.lit(")")))
        .when(F.col("score") == fixed.ARTIST, F.concat(F.lit("artist"), at))
        .when(F.col("score") == fixed.FILENAME, F.lit("filename"))
    )


def best(candidates: DataFrame) -> DataFrame:
    """The candidate of the highest score for each key; then the smallest path, then the first place."""
    order = F.struct((-F.col("score")).alias("minus"), "path", "place", "overlap")
    b = candidates.groupBy(*KEY).agg(F.min(order).alias("b"))
    return b.select(*KEY, "b.path", (-F.col("b.minus")).alias("score"), "b.place", "b.overlap")


def _keys(entries: DataFrame) -> DataFrame:
    return entries.where("norm_title <> ''").select(*KEY).distinct()


def candidates(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """All tiers' candidates of distinct entry keys."""
    keys = _keys(entries)
    shared = Shared(keys, tracks)
    return _union([t(keys, tracks, shared) for t in TIERS.values()])


def with_winners(entries: DataFrame, won: DataFrame) -> DataFrame:
    """Every entry with the path, score and reason of its winner; misses have a null path and their reason."""
    won = won.select(*[F.col(k).alias(f"_won_{k}") for k in KEY], "path", "score", "place", "overlap")
    out = joined(entries, won, [F.col(k) == F.col(f"_won_{k}") for k in KEY], "left").drop(*[f"_won_{k}" for k in KEY])
    why = F.when(F.col("path").isNotNull(), reason()).when(F.col("norm_title") == "", F.lit("empty track name")).otherwise(F.lit("no match"))
    return out.withColumn("reason", why).drop("place", "overlap")


def match_union(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """The winners by one plan over all tiers."""
    return with_winners(entries, best(candidates(entries, tracks)))


def match(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """The winners tier by tier: only entries that a stronger tier left go on to the next one.

    Each step's keys with their winners are checkpointed, so steps neither repeat work nor lengthen the
    plan. No step has two similarity tiers: Spark's driver plans and describes a plan anew after each of its
    stages, so what it allocates grows with the square of a plan.
    """
    left, won = cut(_keys(entries)), None
    shared = Shared(left, tracks)
    steps = [["exact", "title_artist", "title_album", "title"], ["title_part"], ["tokens", "artist"], ["filename"]]
    for step in steps:
        asked = cut(joined(left, best(_union([TIERS[t](left, tracks, shared) for t in step])), KEY, "left"))
        found, left = asked.where("path IS NOT NULL"), asked.where("path IS NULL").select(*KEY)
        won = found if won is None else won.unionByName(found)
    return with_winners(entries, won)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def misses(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("path").isNull())


def summary(matched: DataFrame) -> DataFrame:
    """total, matched, missing."""
    return matched.agg(F.count("*").alias("total"), F.count("path").alias("matched"), F.count_if(F.col("path").isNull()).alias("missing"))


#: Titles that have a word from which near misses look for it only where rarer words cannot decide.
FREQUENT = 1_000


def near_misses(missed: DataFrame, tracks: DataFrame, k: int = 3, frequent: int = FREQUENT) -> DataFrame:
    """idx, rank, path, overlap: the k tracks whose titles overlap most with a miss, whoever plays them.

    A title enters once for all its tracks, with its k smallest paths, a miss once for all of its name.
    Titles that share a word of at most ``frequent`` titles are scored first. A title that shares none
    of these overlaps with a miss of n words by s/n at most, s of them being frequent; so only misses
    whose k-th overlap is no more go on, and of their frequent words only the rarest ones, as many as
    such a title cannot all lack.
    """
    titles = tracks.select("norm_title", "title_tokens", "path").where("norm_title <> ''")
    paths = titles.withColumn("n", F.row_number().over(W.partitionBy("norm_title").orderBy("path"))).where(F.col("n") <= k).select("norm_title", "path")
    words = cut(titles.select("norm_title", "title_tokens").dropDuplicates(["norm_title"]))
    each = words.select("norm_title", "title_tokens", F.explode("title_tokens").alias("word"))
    often = cut(each.groupBy("word").agg(F.count("*").alias("df")))
    names = missed.select(F.col("norm_title").alias("name")).distinct().withColumn("own", tokens(F.col("name")))
    asked = cut(joined(names.withColumn("word", F.explode("own")), often, "word"))

    def scored(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("name", "own", "norm_title", "title_tokens").dropDuplicates(["name", "norm_title"])
        both = pairs.select("name", "norm_title", jaccard(F.col("own"), F.col("title_tokens")).alias("overlap"))
        return joined(both, paths, "norm_title").select("name", "path", "overlap")

    best_of = W.partitionBy("name").orderBy(F.desc("overlap"), "path")
    top = lambda d: d.withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k)
    rare = asked.where(F.col("df") <= frequent).select("name", "own", "word")
    first = cut(top(scored(joined(rare, each, "word"))))
    floor = first.where(F.col("rank") == k).select("name", F.col("overlap").alias("least"))
    shared = F.array_sort(F.collect_list(F.struct("df", "word")))
    common = joined(asked.where(F.col("df") > frequent).groupBy("name").agg(F.first("own").alias("own"), shared.alias("c")), floor, "name", "left")
    need = F.greatest(F.lit(1), F.ceil(F.coalesce("least", F.lit(0.0)) * F.size("own") - 1e-9).cast("int"))
    again = common.where(F.size("c") >= need).withColumn("word", F.explode(F.slice("c", F.lit(1), F.size("c") - need + 1)["word"]))
    second = scored(joined(again.select("name", "own", "word"), each, "word"))
    out = top(first.select("name", "path", "overlap").unionByName(second).distinct())
    return joined(missed.select("idx", F.col("norm_title").alias("name")), out, "name").select("idx", "rank", "path", "overlap")


def link_pairs(a: DataFrame, b: DataFrame, text_a: str, text_b: str) -> DataFrame:
    """Rows of a and b of which one text holds the other as whole words: an equi-join on the longest
    word of the shorter one, in either direction."""
    longest = lambda c: F.array_max(F.transform(tokens(F.col(c)), lambda t: F.struct(F.char_length(t).alias("n"), t.alias("t"))))["t"]
    held = a.withColumn("_w", longest(text_a)).join(b.withColumn("_w", F.explode(tokens(F.col(text_b)))), "_w").where(contains_words(F.col(text_b), F.col(text_a)))
    holds = a.withColumn("_w", F.explode(tokens(F.col(text_a)))).join(b.withColumn("_w", longest(text_b)), "_w").where(contains_words(F.col(text_a), F.col(text_b)))
    return held.drop("_w").unionByName(holds.drop("_w")).distinct().where(F.least(F.char_length(text_a), F.char_length(text_b)) >= fixed.MIN_TITLE_RUNES)


__all__ = ["TIERS", "best", "candidates", "index_entries", "index_tracks", "link_pairs", "match", "match_union", "misses", "near_misses", "share_token", "summary", "tagged_tracks", "with_fallbacks"]
