"""The linkage queries as DuckDB SQL over the driver's tables.

DuckDB's regular expressions are RE2; the patterns are those of functions.text but for the (?u) flag.
Repeated stripping of version notes is unrolled.
"""

from __future__ import annotations

from larkspur.functions import fixed, text
from larkspur.plans.fixtures import CSV, TAGS, TREE, VIEWS
from larkspur.plans.queries import FILENAMES, HEAD, TAKEN, WANTED

PASSES = 4


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("(?iu)", "(?i)").replace("'", "''") + "'"


def cut(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {_lit(pattern)}, '{by}', 'g')"


def norm(x: str) -> str:
    v = f"strip_accents(trim(lower({x})))"
    for _ in range(PASSES):
        v = cut(cut(cut(v, text.BRACKET, " "), text.DASH), text.TAIL)
    return f"trim({cut(cut(v, text.PUNCTUATION, ' '), text.WS + '+', ' ')})"


def toks(x: str) -> str:
    return f"list_filter(list_distinct(string_split({x}, ' ')), lambda t: t <> '')"


def pad(x: str) -> str:
    return f"(' ' || {x} || ' ')"


def aligned(a: str, b: str) -> str:
    return f"(least(length({a}), length({b})) >= {fixed.MIN_TITLE_RUNES} AND (contains({pad(a)}, {pad(b)}) OR contains({pad(b)}, {pad(a)})))"


def holds(long: str, short: str) -> str:
    return f"(length({short}) >= {fixed.MIN_ARTIST_RUNES} AND length({long}) > length({short}) AND contains({pad(long)}, {pad(short)}))"


def same(a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR {holds(a, b)} OR {holds(b, a)}))"


def jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}) END)"


CATALOG = f"WITH RECURSIVE catalog AS MATERIALIZED ({VIEWS.replace('AS STRING', 'AS VARCHAR')}\n)"

LINKAGE = f"""{CATALOG}, lib AS MATERIALIZED (
  SELECT path, title, artist, {norm("title")} AS nt, {norm("artist")} AS na, {norm("p_type")} AS nb, {norm("split_part(path, '/', -1)")} AS nf FROM catalog
), titles AS MATERIALIZED (SELECT nt, na, min(path) AS path, {toks("nt")} AS tt FROM lib GROUP BY nt, na
), names AS MATERIALIZED (SELECT nf, na, min(path) AS path FROM lib GROUP BY nf, na
), ent AS MATERIALIZED (
  SELECT k AS idx, wanted, ms, {norm("wanted")} AS et, {norm("on_album")} AS eb, {norm("split_part(by_artist, ';', 1)")} AS a0, {norm("split_part(by_artist, ';', 2)")} AS a1 FROM catalog
), keys AS MATERIALIZED (SELECT DISTINCT et, eb, a0, a1, {toks("et")} AS tt FROM ent WHERE et <> ''
), named AS (SELECT *, a0 AS a, 0 AS place FROM keys WHERE a0 <> '' UNION ALL SELECT *, a1, 1 FROM keys WHERE a1 <> ''
)"""
_GATE = f"((a0 = '' AND a1 = '') OR {same('na', 'a0')} OR {same('na', 'a1')})"
_KEY = "et, eb, a0, a1"
_NONE = "CAST(NULL AS DOUBLE) AS overlap"
TIERS = {
    "exact": f"SELECT {_KEY}, path, 100 AS score, place, {_NONE} FROM named JOIN lib ON nt = et AND na = a AND nb = eb",
    "title_artist": f"SELECT {_KEY}, path, 80 AS score, place, {_NONE} FROM named JOIN lib ON nt = et AND na = a",
    "title_album": f"SELECT {_KEY}, path, 70 AS score, NULL AS place, {_NONE} FROM keys JOIN lib ON nt = et AND nb = eb WHERE eb <> ''",
    "title": f"SELECT {_KEY}, path, 40 AS score, NULL AS place, {_NONE} FROM keys JOIN lib ON nt = et WHERE {_GATE}",
    "title_part": f"SELECT {_KEY}, path, 30 AS score, NULL AS place, {_NONE} FROM keys, titles WHERE {aligned('nt', 'et')} AND {_GATE}",
    "tokens": f"SELECT {_KEY}, path, 25 AS score, NULL AS place, {jac('keys.tt', 'titles.tt')} AS overlap FROM keys, titles WHERE {jac('keys.tt', 'titles.tt')} >= 0.6 AND {_GATE}",
    "artist": f"SELECT {_KEY}, path, 20 AS score, place, {_NONE} FROM named JOIN titles ON na = a WHERE list_has_any(named.tt, titles.tt)",
    "filename": f"SELECT {_KEY}, path, 10 AS score, NULL AS place, {_NONE} FROM keys, names WHERE {aligned('nf', 'et')} AND {_GATE}",
}
_ORDER = "-score, path, coalesce(place, -1), coalesce(overlap, -1)"


def tier(name: str) -> str:
    return f"""{LINKAGE}, c AS ({TIERS[name]}), r AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_ORDER}) AS n FROM c)
SELECT idx, path, score, coalesce(place, -1) AS place, round(overlap, 9) AS overlap FROM ent JOIN r USING ({_KEY}) WHERE n = 1"""


ALL = " UNION ALL ".join(TIERS.values())
MATCH = f"""{LINKAGE}, c AS ({ALL}), r AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_ORDER}) AS n FROM c),
matched AS MATERIALIZED (
  SELECT idx, wanted, ms, ent.et AS et, path, score, CASE score WHEN 100 THEN 'title+artist+album[' || place || ']' WHEN 80 THEN 'title+artist[' || place || ']' WHEN 70 THEN 'title+album'
    WHEN 40 THEN 'title' WHEN 30 THEN 'title-substring' WHEN 25 THEN 'token-similarity(' || printf('%.2f', overlap) || ')' WHEN 20 THEN 'artist[' || place || ']'
    WHEN 10 THEN 'filename' ELSE CASE WHEN ent.et = '' THEN 'empty track name' ELSE 'no match' END END AS reason
  FROM ent LEFT JOIN (SELECT * FROM r WHERE n = 1) w USING ({_KEY})
)"""
BEST = f"{MATCH} SELECT idx, path, score, reason FROM matched"

SECONDS = r"CASE WHEN regexp_full_match(trim(ms), '[+-]?[0-9]+') THEN CAST(trunc(CAST(trim(ms) AS BIGINT) / 1000.0) AS BIGINT) ELSE 0 END"
_SPLIT = lambda x, p: f"list_transform(string_split_regex({x}, {_lit(p)}), lambda p: trim(p))"
_DISTINCT = lambda l: f"list_filter({l}, lambda x, i: x <> '' AND list_position(list_transform({l}, lambda y: lower(strip_accents(y))), lower(strip_accents(x))) = i)"  # noqa: E731,E741

FOLDERS = f"""{CATALOG}, files AS MATERIALIZED ({TREE.replace('AS STRING', 'AS VARCHAR')}
), placed AS (SELECT *, split_part(rel, '/', 1) AS a, split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2) AS b, len(string_split(rel, '/')) AS depth FROM files
), artists AS MATERIALIZED (SELECT a AS dir, a AS on_disk, {norm("a")} AS key, count(*) FILTER (depth <= 3) AS file_count FROM placed GROUP BY a
), albums AS MATERIALIZED (
  SELECT a AS artist_dir, {norm("a")} AS akey, split_part(b, '/', 2) AS on_disk, b AS dir, {norm(cut("split_part(b, '/', 2)", text.YEAR))} AS key, count(*) FILTER (depth = 3) AS file_count
  FROM placed WHERE depth > 2 GROUP BY a, b
), won_artist AS MATERIALIZED (
  SELECT key, arg_min(on_disk, p) AS on_disk, arg_min(dir, p) AS dir, count(*) AS members FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY -file_count, regexp_matches(on_disk, '[A-Z]') AND NOT regexp_matches(on_disk, '[a-z]'), -strlen(on_disk), on_disk, dir) AS p FROM artists) GROUP BY key
), ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY artist_dir, key ORDER BY -file_count, regexp_matches(on_disk, '[A-Z]') AND NOT regexp_matches(on_disk, '[a-z]'), -strlen(on_disk), on_disk, dir) AS p FROM albums
), won_album AS MATERIALIZED (SELECT artist_dir, key, arg_min(on_disk, p) AS on_disk, arg_min(dir, p) AS dir, count(*) AS members FROM ranked GROUP BY artist_dir, key
)"""

SAFE = lambda x: cut(x, fixed.ILLEGAL, "_")


def resolved(incoming: str, known: str = "true") -> str:
    """CTEs that end in ``res``: src, artist_folder, album_folder of (src, artist, album, suffix)."""
    return f"""inc AS MATERIALIZED ({incoming}
), ik AS MATERIALIZED (
  SELECT *, {norm("artist")} AS ak, {norm("album")} AS bk, {SAFE("album")} || suffix AS plain, {norm(cut(SAFE("album") + " || suffix", text.YEAR))} AS rk FROM inc
), fa AS (SELECT ak, arg_min({SAFE("artist")}, src) AS name FROM ik GROUP BY ak
), fb AS (SELECT ak, rk, arg_min(plain, src) AS name, min(src) AS since FROM ik GROUP BY ak, rk
), res AS MATERIALIZED (
  SELECT ik.src, coalesce(wa.on_disk, fa.name) AS artist_folder, coalesce(wb.on_disk, CASE WHEN ik.src >= fb.since THEN fb.name END, ik.plain) AS album_folder
  FROM ik LEFT JOIN (SELECT * FROM won_artist WHERE {known}) wa ON wa.key = ik.ak LEFT JOIN fa ON fa.ak = ik.ak
  LEFT JOIN won_album wb ON wb.artist_dir = wa.dir AND wb.key = ik.bk LEFT JOIN fb ON fb.ak = ik.ak AND fb.rk = ik.bk
)"""


META = """meta AS MATERIALIZED (
  SELECT concat('in/', CAST(k AS VARCHAR), '.mp3') AS path, artist, CASE WHEN k % 3 = 0 THEN p_brand ELSE '' END AS album_artist, p_type AS album, title,
    CASE WHEN k % 4 = 0 THEN 'Unknown Genre' ELSE 'Genre: ' || CAST(k % 3 AS VARCHAR) END AS genre, ' (' || CAST(1990 + k % 3 AS VARCHAR) || ')' AS year,
    CASE WHEN p_size <= 0 THEN '' WHEN k % 4 > 1 AND k % 3 > 0 THEN printf('%d-%02d - ', k % 3, p_size) ELSE printf('%02d - ', p_size) END AS prefix FROM catalog
)"""
_LEAD = "CASE WHEN album_artist = '' THEN artist ELSE album_artist END"
_NAME = "prefix || artist || ' - ' || title || '.mp3'"
LAYOUT = {
    "artist_album_year": f"{SAFE('artist')} || '/' || {SAFE('album')} || year || '/' || {SAFE(_NAME)}",
    "artist_album": f"{SAFE('artist')} || '/' || {SAFE('album')} || '/' || {SAFE(_NAME)}",
    "albumartist_album_year": f"{SAFE(_LEAD)} || '/' || {SAFE('album')} || year || '/' || {SAFE(_NAME)}",
    "flat": SAFE("prefix || artist || ' - ' || album || ' - ' || title || '.mp3'"),
    "genre_artist_album_year": f"{SAFE('genre')} || '/' || {SAFE('artist')} || '/' || {SAFE('album')} || year || '/' || {SAFE(_NAME)}",
}
PLAN = f"""{FOLDERS}, {META}, {resolved("SELECT path AS src, artist, album, year AS suffix FROM meta")},
there AS (SELECT rel AS dest FROM files UNION SELECT {LAYOUT["artist_album_year"]} FROM meta WHERE contains(path, '7')),
went AS (SELECT src, artist_folder || '/' || album_folder || '/' || {SAFE(_NAME)} AS dest FROM res JOIN meta ON path = src),
plan AS (
  SELECT src, dest, CASE WHEN dest IN (SELECT dest FROM there) THEN 'exists' WHEN src = min(src) OVER (PARTITION BY dest) THEN 'move' ELSE 'duplicate' END AS action FROM went
)"""

_NUMBER = r"regexp_extract(path, ' \(([1-9][0-9]{0,8})\)\.mp3$', 1)"
UNIQUE = lambda wanted, taken: f"""w AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY src) AS j FROM ({wanted})),
used AS (SELECT DISTINCT regexp_replace(path, ' \\([1-9][0-9]*\\)\\.mp3$', '.mp3') AS dest, CAST({_NUMBER} AS BIGINT) AS k FROM ({taken}) WHERE {_NUMBER} <> ''),
room AS (SELECT dest, max(j) + 1 + (SELECT count(*) FROM used u WHERE u.dest = w.dest) AS top FROM w GROUP BY dest),
free AS (
  SELECT dest, k, row_number() OVER (PARTITION BY dest ORDER BY k) AS j FROM (SELECT dest, unnest(range(2, top + 1)) AS k FROM room) x
  WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.dest = x.dest AND u.k = x.k)
), renamed AS (SELECT src, dest, regexp_replace(dest, '\\.mp3$', '') || ' (' || k || ').mp3' AS renamed FROM w JOIN free USING (dest, j))"""  # noqa: E731

MERGE = f"""{FOLDERS}, homes AS MATERIALIZED (
  SELECT akey, key, arg_min(on_disk, o) AS name, arg_min(dir, o) AS spot, min(own) AS own FROM (
    SELECT al.*, CASE WHEN al.artist_dir = w.dir THEN 0 ELSE 1 END AS own,
      row_number() OVER (PARTITION BY al.akey, al.key ORDER BY al.artist_dir <> w.dir, CASE WHEN al.artist_dir = w.dir THEN '' ELSE al.artist_dir END, p) AS o
    FROM ranked al JOIN won_artist w ON w.key = al.akey) GROUP BY akey, key
), moved AS MATERIALIZED (
  SELECT f.rel AS src, f.length, f.digest, w.dir || '/' || h.name || substr(f.rel, length(al.dir) + 1) AS dest
  FROM placed f JOIN albums al ON al.dir = f.b JOIN won_artist w ON w.key = al.akey JOIN homes h ON h.akey = al.akey AND h.key = al.key
  WHERE f.depth > 2 AND al.dir <> w.dir || '/' || h.name
  UNION ALL SELECT f.rel, f.length, f.digest, w.dir || substr(f.rel, length(f.a) + 1) FROM placed f JOIN artists ar ON ar.dir = f.a JOIN won_artist w ON w.key = ar.key WHERE f.depth = 2 AND f.a <> w.dir
), stay AS (SELECT * FROM files WHERE rel NOT IN (SELECT src FROM moved)),
acts AS MATERIALIZED (
  SELECT m.src, m.dest, CASE WHEN s.rel IS NULL AND m.src = min(m.src) OVER (PARTITION BY m.dest) THEN 'MERGE'
    WHEN coalesce(s.length, first_value(m.length) OVER o) = m.length AND coalesce(s.digest, first_value(m.digest) OVER o) = m.digest THEN 'DROP' ELSE 'RENAME' END AS action
  FROM moved m LEFT JOIN stay s ON s.rel = m.dest WINDOW o AS (PARTITION BY m.dest ORDER BY m.src)
), {UNIQUE("SELECT src, dest FROM acts WHERE action = 'RENAME'", "SELECT rel AS path FROM stay UNION SELECT dest FROM moved")},
merged AS (SELECT acts.src, coalesce(renamed, acts.dest) AS dest, action FROM acts LEFT JOIN renamed USING (src))"""

_GUESS = """s AS (SELECT *, trim(regexp_replace(split_part({name}, '/', -1), '\\.[^./]*$', '')) AS stem FROM {source}),
p AS (SELECT *, instr(stem, ' - ') AS pos FROM s), q AS (SELECT *, trim(substr(stem, 1, pos - 1)) AS l, trim(substr(stem, pos + 3)) AS r FROM p),
guess AS (
  SELECT *, CASE WHEN pos > 0 AND r <> '' AND NOT regexp_full_match(l, '[0-9]{{1,3}}') THEN l ELSE '' END AS whom,
    CASE WHEN pos > 0 THEN CASE WHEN r = '' THEN l ELSE r END WHEN regexp_matches(stem, '^[0-9]{{1,3}}[. ]') THEN trim(regexp_replace(stem, '^[0-9]{{1,3}}[. ]+', '')) ELSE stem END AS called FROM q
)"""
FALLBACKS = f"""{CATALOG}, t AS ({TAGS.replace('AS STRING', 'AS VARCHAR')}), {_GUESS.format(name="path", source="t")},
f AS (
  SELECT *, string_split(path, '/') AS parts, CASE WHEN album_artist <> '' THEN split_part(album_artist, ';', 1) || '|Guest' ELSE artist END AS named, title = '' OR (artist = '' AND album_artist = '') AS gap FROM guess
), g AS (
  SELECT *, CASE WHEN len(parts) >= 3 THEN trim(parts[len(parts) - 2]) ELSE '' END AS da, CASE WHEN len(parts) >= 2 THEN trim({cut('trim(parts[len(parts) - 1])', text.YEAR)}) ELSE '' END AS db FROM f
), h AS (SELECT *, CASE WHEN album = '' AND gap THEN db ELSE album END AS own FROM g)
SELECT path, CASE WHEN title = '' THEN called ELSE title END AS title, CASE WHEN named <> '' THEN named WHEN whom <> '' THEN whom WHEN da <> '' THEN da ELSE 'Unknown Artist' END AS artists,
  CASE WHEN own = '' THEN 'Unknown Album' ELSE own END AS album, parts[len(parts)] AS filename FROM h"""

SCAN = f"""{CATALOG}, c AS (
  SELECT k, CASE WHEN k % 11 = 0 THEN '' WHEN k % 4 = 1 THEN p_name || ', "' || p_brand || '"' WHEN k % 4 = 2 THEN p_name || chr(10) || 'x' ELSE trim(wanted) END AS track_name,
    CASE WHEN k % 7 = 0 THEN '' ELSE trim(on_album) END AS album, CASE WHEN k % 7 = 0 THEN '' ELSE by_artist END AS by_artist, CASE WHEN k % 7 = 0 THEN '' ELSE ms END AS ms FROM catalog
), a AS (SELECT *, {_SPLIT('by_artist', text.ARTIST_SPLIT)} AS names FROM c WHERE track_name <> '')
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS idx, 'u' || k AS uri, track_name, album, array_to_string({_DISTINCT('names')}, '|') AS artists, '' AS release, CAST({SECONDS} AS INTEGER) AS duration FROM a"""

REPORTS = f"""{MATCH}, lost AS MATERIALIZED (SELECT * FROM matched WHERE path IS NULL),
nt AS MATERIALIZED (SELECT nt, {toks('nt')} AS tt FROM (SELECT DISTINCT nt FROM lib)), ne AS MATERIALIZED (SELECT et, {toks('et')} AS u FROM (SELECT DISTINCT et FROM lost)),
no AS MATERIALIZED (SELECT et, nt, {jac('u', 'tt')} AS overlap FROM ne, nt), np AS (SELECT nt, na, nb, path, row_number() OVER (PARTITION BY nt ORDER BY path) AS n FROM lib),
nr AS (SELECT et, nt, na, nb, path, overlap, row_number() OVER (PARTITION BY et ORDER BY overlap DESC, path) AS rank FROM no JOIN np USING (nt) WHERE overlap > 0 AND n <= 3),
near AS (
  SELECT et, string_agg('      [' || printf('%.2f', overlap) || '] ' || path || ' | title="' || nt || '" artist="' || na || '" album="' || nb || '"', chr(10) ORDER BY rank) AS lines FROM nr WHERE rank <= 3 GROUP BY et
), raw AS (SELECT k, nullif(trim(split_part(by_artist, ';', 1)), '') AS lead, on_album FROM catalog)
SELECT idx, '- ' || wanted || ' | ' || coalesce(lead, 'Unknown') || ' | ' || on_album || chr(10) || '    looked up: title="' || lost.et || '" artist="' || {norm("coalesce(lead, '')")} || '" album="' || {norm("on_album")} || '"' || chr(10)
  || coalesce('    closest:' || chr(10) || lines, '    closest: (no near-miss candidates in source)') AS report
FROM lost JOIN raw ON k = idx LEFT JOIN near ON near.et = lost.et"""

SQL: dict[str, str] = {
    "q_normalize": f"{CATALOG}, t AS (SELECT 'p' || k AS id, wanted || ' - Remastered ' || artist AS t FROM catalog UNION ALL SELECT 'd' || doc_id, text FROM documents) SELECT id, {norm('t')} AS norm FROM t",
    "q_split_artists": f"{CATALOG}, s AS (SELECT k, {_SPLIT(chr(39).join(['by_artist || ', ' feat. ', ' || artist || ', '; ', ' || p_type']), text.ARTIST_SPLIT)} AS l FROM catalog) SELECT k, array_to_string({_DISTINCT('l')}, '|') AS artists FROM s",
    "q_primary_artist": f"{CATALOG}, s AS (SELECT k, {_SPLIT(chr(39).join(['by_artist || ', '/', ' || p_type']), text.FOLDER_SPLIT)} AS l FROM catalog) SELECT k, coalesce(({_DISTINCT('l')})[1], '') AS artist FROM s",
    "q_sanitize": f"SELECT page_id, {SAFE('url')} AS name, regexp_matches(url, '[A-Z]') AND NOT regexp_matches(url, '[a-z]') AS caps, {cut(chr(39).join(['url || ', ' (1999) ', '']), text.YEAR)} AS no_year FROM pages",
    "q_tokens_jaccard": f"WITH d AS MATERIALIZED (SELECT doc_id, {norm('text')} AS n FROM documents), t AS MATERIALIZED (SELECT doc_id, {toks('n')} AS t FROM d) SELECT a.doc_id, len(a.t) AS n_tokens, round({jac('a.t', 'b.t')}, 9) AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1",
    "q_word_contains": f"WITH b AS MATERIALIZED (SELECT item_id, {norm('text')} AS a FROM benchmark), d AS MATERIALIZED (SELECT doc_id, {norm('text')} AS t FROM documents) SELECT item_id, doc_id FROM b, d WHERE a <> '' AND t <> '' AND {aligned('a', 't')}",
    "q_shares_artist": f"{CATALOG}, x AS (SELECT k, {norm(chr(39).join(['artist || ', ' and friends', '']))} AS l, {norm(chr(39).join(['split_part(by_artist, ', ';', ', 1)']))} AS a0, {norm(chr(39).join(['split_part(by_artist, ', ';', ', 2)']))} AS a1, {norm('title')} AS t, {norm('wanted')} AS w FROM catalog) SELECT k, {same('l', 'a0')} OR {same('l', 'a1')} AS shared, t <> '' AND w <> '' AND {aligned('t', 'w')} AS aligned FROM x",
    "q_path_parse": f"{CATALOG}, p AS (SELECT path FROM catalog UNION SELECT url FROM pages), s AS (SELECT path, string_split(path, '/') AS l, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM p) SELECT path, ext, lower(ext) IN ({', '.join(map(_lit, fixed.EXTENSIONS))}) AS audio, CASE WHEN len(l) >= 3 THEN trim(l[len(l) - 2]) ELSE '' END AS artist, CASE WHEN len(l) >= 2 THEN trim({cut('trim(l[len(l) - 1])', text.YEAR)}) ELSE '' END AS album FROM s",
    "q_filename_parse": f"""{CATALOG}, n AS ({FILENAMES.replace('AS STRING', 'AS VARCHAR')}), s AS (SELECT k, trim(regexp_replace(name, '\\.[^./]*$', '')) AS b FROM n),
p AS (SELECT k, b, instr(b, ' - ') AS pos FROM s), q AS (SELECT *, trim(substr(b, 1, pos - 1)) AS l, trim(substr(b, pos + 3)) AS r FROM p)
SELECT k, CASE WHEN pos > 0 AND r <> '' AND NOT regexp_full_match(l, '[0-9]{{1,3}}') THEN l ELSE '' END AS artist,
  CASE WHEN pos > 0 THEN CASE WHEN r = '' THEN l ELSE r END WHEN regexp_matches(b, '^[0-9]{{1,3}}[. ]') THEN trim(regexp_replace(b, '^[0-9]{{1,3}}[. ]+', '')) ELSE b END AS title FROM q""",
    "q_csv_scan": SCAN,
    "q_tag_fallbacks": FALLBACKS,
    "q_miss_reports": REPORTS,
    "q_fingerprint_dedup": f"WITH d AS (SELECT doc_id AS id, 2 * strlen(text) AS n, sha1(unhex(left(hex(encode(text || text)), {2 * HEAD}))) AS h FROM documents), f AS (SELECT *, min(id) OVER (PARTITION BY n, h) AS f, count(*) OVER (PARTITION BY n, h) AS c FROM d) SELECT id, h AS digest, CASE WHEN c > 1 THEN f END AS keep, c > 1 AND id <> f AS is_duplicate FROM f",
    "q_duration_parse": f"{CATALOG} SELECT k, {SECONDS} AS seconds FROM catalog",
    **{f"q_tier_{t}": tier(t) for t in TIERS},
    "q_match_best": BEST,
    "q_match_union": BEST,
    "q_match_misses": f"{MATCH} SELECT idx, wanted AS track_name, reason FROM matched WHERE path IS NULL",
    "q_match_summary": f"{MATCH} SELECT count(*) AS total, count(path) AS matched, count(*) - count(path) AS missing FROM matched",
    "q_near_miss_topk": f"""{LINKAGE}, t AS MATERIALIZED (SELECT nt, {toks('nt')} AS tt FROM (SELECT DISTINCT nt FROM lib)), e AS MATERIALIZED (SELECT et, {toks('et')} AS u FROM (SELECT DISTINCT et FROM ent)),
o AS MATERIALIZED (SELECT et, nt, {jac('u', 'tt')} AS overlap FROM e, t), p AS (SELECT nt, path, row_number() OVER (PARTITION BY nt ORDER BY path) AS n FROM lib),
r AS (SELECT et, path, overlap, row_number() OVER (PARTITION BY et ORDER BY overlap DESC, path) AS rank FROM o JOIN p USING (nt) WHERE overlap > 0 AND n <= 3)
SELECT idx, CAST(rank AS INTEGER) AS rank, path, round(overlap, 9) AS overlap FROM ent JOIN r USING (et) WHERE rank <= 3""",
    "q_m3u_lines": f"{MATCH} SELECT idx, '#EXTINF:' || ({SECONDS}) || ',' || artist || ' - ' || title AS info, '/music/' || path AS location FROM matched JOIN lib USING (path)",
    "q_folder_counts": f"{FOLDERS} SELECT dir, key, file_count FROM artists UNION ALL SELECT dir, key, file_count FROM albums",
    "q_canonical_group": f"{FOLDERS} SELECT '' AS artist_dir, key, on_disk, members FROM won_artist UNION ALL SELECT artist_dir, key, on_disk, members FROM won_album",
    "q_resolve_folder": FOLDERS + ", " + resolved("SELECT 'in/' || k AS src, artist, p_type || CASE WHEN k % 3 = 0 THEN ' Deluxe' ELSE '' END AS album, ' (2005)' AS suffix FROM catalog", "contains(key, '1')") + " SELECT src, artist_folder, album_folder FROM res",
    **{f"q_layout_{n}": f"{CATALOG}, {META} SELECT path, {d} AS dest FROM meta" for n, d in LAYOUT.items()},
    "q_move_plan": f"{PLAN} SELECT src, dest, action FROM plan",
    "q_move_summary": f"{PLAN} SELECT count(*) AS total, count(*) FILTER (action = 'move') AS moved, count(*) FILTER (action <> 'move') AS skipped FROM plan",
    "q_content_dedup": "WITH d AS (SELECT doc_id AS id, strlen(text) AS n, sha1(text) AS h FROM documents), f AS (SELECT *, min(id) OVER (PARTITION BY n, h) AS f, count(*) OVER (PARTITION BY n, h) AS c FROM d) SELECT id, CASE WHEN c > 1 THEN f END AS keep, c > 1 AND id <> f AS is_duplicate FROM f",
    "q_unique_names": f"{CATALOG}, {UNIQUE(WANTED.replace('AS STRING', 'AS VARCHAR'), TAKEN)} SELECT src, renamed FROM renamed",
    "q_merge_plan": f"{MERGE} SELECT src, dest, action FROM merged",
    "q_merge_summary": f"""{MERGE}, la AS (SELECT count(*) AS n FROM artists a JOIN won_artist w USING (key) WHERE a.dir <> w.dir),
lb AS (SELECT count(*) AS n FROM albums al JOIN won_artist w ON w.key = al.akey JOIN homes h ON h.akey = al.akey AND h.key = al.key WHERE al.dir <> w.dir || '/' || h.name AND (al.dir <> h.spot OR h.own = 0))
SELECT la.n + lb.n AS consolidated, (SELECT count(*) FROM merged WHERE action = 'DROP') AS skipped, (SELECT count(*) FROM merged WHERE action = 'RENAME') AS renamed_on_merge FROM la, lb""",
}
