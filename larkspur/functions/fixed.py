"""They define the matching semantics and must keep these values for right results."""

# Version notes after " - " at the end of a title.
DASH_NOTES = [
    r"radio edit", r"radio mix", r"extended mix", r"extended", r"single version", r"single edit", r"original mix",
    r"bonus track", r"deluxe edition", r"anniversary edition", r"expanded edition", r"remastered", r"remaster",
    r"remix", r"acoustic", r"live", r"instrumental", r"demo", r"version", r"edit", r"mono", r"stereo",
    r"feat\..*", r"ft\..*", r"featuring.*",
]

# In brackets these mark a version as well.
BRACKET_NOTES = [*DASH_NOTES, r"single", r"original", r"bonus", r"deluxe", r"clean", r"explicit", r"reissue", r"with .*"]

# Words that introduce a guest, and those that join artists.
GUEST = r"feat\.?|ft\.?|featuring|with"
JOINS = r"feat\.?|ft\.?|featuring|with|vs\.?"

# Scores of the match tiers.
EXACT, TITLE_ARTIST, TITLE_ALBUM, TITLE, TITLE_PART, TOKENS, ARTIST, FILENAME = 100, 80, 70, 40, 30, 25, 20, 10

# Least Jaccard similarity of the token tier; least runes of a contained title and of a contained artist.
TOKEN_THRESHOLD, MIN_TITLE_RUNES, MIN_ARTIST_RUNES = 0.6, 4, 5

# Audio files by extension.
EXTENSIONS = [".mp3", ".m4a", ".flac", ".ogg", ".opus", ".wav", ".aac"]

# Characters that file names must not have; a run of them becomes one "_".
ILLEGAL = r'[/\\?%*:|"<>]+'

# Headers of a playlist table, in order of preference.
HEADERS = {
    "track_name": ["track name", "track", "title"],
    "album": ["album name", "album"],
    "artists": ["artist name(s)", "artist names", "artists", "artist name", "artist"],
    "release": ["release date", "release"],
    "duration": ["duration (ms)", "duration_ms", "duration"],
    "uri": ["track uri", "spotify uri", "uri", "url"],
}

# Names of the folder layouts.
LAYOUT_NAMES = ["artist-album-year", "artist-album", "albumartist-album-year", "flat", "genre-artist-album-year"]

# Wording of a miss in the report, an output format.
LOOKED_UP, CLOSEST, NONE_CLOSE = "looked up:", "closest:", "closest: (no near-miss candidates in source)"

UNKNOWN_ARTIST, UNKNOWN_ALBUM, UNKNOWN_GENRE = "Unknown Artist", "Unknown Album", "Unknown Genre"

# Bytes of a file that its content fingerprint covers.
SAMPLE_BYTES = 1 << 20
