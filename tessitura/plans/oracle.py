"""DuckDB SQL for the catalogue's queries, written independently of the Spark plans (brute force where that is plainer)."""

from __future__ import annotations

from tessitura.plans.views import ALIAS, FILE, ITEM, RUN_TS, SCROBBLE, SOURCE, TRACK

q = lambda s: "'" + s.replace("'", "''") + "'"


# Fixed values, written down once more so that a wrong one in the code under test shows: what is deleted from names, and characters replaced in paths.
DECORATIONS = (
    r"\[\d{4}\]$", r"\s+\-\s+ep$", r"\s+ep$", r"\s+\-\s+single$", r"\(.*?feat\..*?\)", r"\(.*?ft\s+.*?\)", r"\[.*?feat\..*?\]", r"\(bonus track\)", r"\(.*?remastered.*?\)", r"feat\. .*?$", r"\(explicit\)$",
    r"\[re-recorded\]$", r"\(re-recorded\)$", r"\(переиздание\)$", r"\(золотое издание\)$", r"\(.*?edition\)$", r"\- remaster$", r"\- re-recorded$", r"\(.*?remaster\)$", r"\[.*?remaster\]$", r"\(.*?version.*?\)$",
    r"\(.*?deluxe.*?\)$", r"\[.*?deluxe.*?\]$", r"\(.*?motion picture.*?\)$", r"\(.*?extended play.*?\)$", r"\(.*?from.*?\)$", r"\(.*?soundtrack.*?\)$", r"^\d+\.\s+", r"^\d+\s+\-\s+", r"^\|\d+\|\s+", "collectors edition",
)
PUNCTUATION = ("-", "–", ",", ".", ":", '"', "*", "[", "]", "(", ")", "'", "’", "‘", "…", "►", "™")
UNSAFE = '*<>:"/\\|?’“”'


def norm(x: str, nfkc=lambda c: c) -> str:
    c = f"coalesce({x}, '')"
    for p in DECORATIONS:
        c = f"regexp_replace({c}, {q(p)}, '', 'gi')"
    chars = ", ".join(q(ch) for ch in PUNCTUATION)
    c = f"list_reduce([{chars}], lambda acc, ch: CASE WHEN length(acc) < 2 THEN acc ELSE replace(acc, ch, '') END, replace(replace({c}, '/', ' '), '\\', ' '))"
    c = nfkc(c)
    return rf"translate(lower(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), 'ёé', 'ee')"


def grams(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def jaccard(a: str, b: str) -> str:
    return f"CAST(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END AS FLOAT)"


def part(x: str, limit: str, name: bool = False) -> str:
    c = rf"translate(regexp_replace(substr(coalesce({x}, ''), 1, {limit}), '\s+$', ''), {q(UNSAFE)}, '{'_' * len(UNSAFE)}')"
    c = f"regexp_replace({c}, '^\\.', '_')"
    return c if name else f"CASE WHEN {c} = '' THEN '_' ELSE regexp_replace({c}, '\\.$', '_') END"


BUCKET = "CAST(round_even(duration / 5.0, 0) * 5 AS INT)"
NORMED = f"t AS (SELECT *, {norm('title')} AS title_norm, {norm('artist')} AS artist_norm, {norm('album')} AS album_norm, {norm('album_artist')} AS album_artist_norm FROM track_v)"


def hash_of(prefix: str = "") -> str:
    fields = ["title", "artist", "album_artist", "album", "track_n", "disc_n", "year"]
    return " || ';' || ".join([f"coalesce(CAST({prefix}{f} AS VARCHAR), '')" for f in fields] + [f"coalesce(CAST({BUCKET} AS VARCHAR), '')"])


def components(*sets: tuple[str, ...], order: str = "date_added ASC NULLS LAST, year ASC NULLS LAST, id") -> str:
    """comp(id, component) and found(id, component, canon_id)."""
    parts = []
    for s in sets:
        keys = [f"{f}_norm" if f in ("artist", "album_artist") else BUCKET if f == "duration" else f for f in s]
        some = " OR ".join(f"{k} <> ''" if k.endswith("_norm") else f"{k} IS NOT NULL" for k in keys)
        parts.append(f"SELECT id, min(id) OVER w AS least, count(*) OVER w AS n FROM t WHERE title_norm <> '' AND ({some}) WINDOW w AS (PARTITION BY title_norm, {', '.join(keys)})")
    return f"""links AS (SELECT DISTINCT id, least FROM ({' UNION ALL '.join(parts)}) WHERE n > 1), edges AS (SELECT id AS a, least AS b FROM links UNION SELECT least, id FROM links),
  reach(id, r) AS (SELECT DISTINCT a, a FROM edges UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.id),
  comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id),
  found AS (SELECT id, component, CASE WHEN c <> id THEN c END AS canon_id FROM (SELECT comp.id, component, first_value(comp.id) OVER (PARTITION BY component ORDER BY {order.replace(', id', ', comp.id')}) AS c FROM comp JOIN t ON t.id = comp.id))"""


DEFAULT = components(("artist", "duration"), ("artist", "year"), ("album_artist", "duration"))
YEAR = components(("artist", "duration"), ("artist", "year"), ("album_artist", "duration"), order="year ASC NULLS LAST, date_added ASC NULLS LAST, id")
DEDUP = f"WITH RECURSIVE {TRACK}, {NORMED}, {DEFAULT}"
ROLLUP = "rollup AS (SELECT coalesce(f.canon_id, t.id) AS root_id, count(*) AS n_tracks, max(CASE WHEN rating <> 0 THEN rating END) AS rating, coalesce(bool_or(loved), false) AS loved, min(date_added) AS date_added FROM t LEFT JOIN found f ON f.id = t.id GROUP BY 1)"
STORED = f"""h AS (SELECT id, {hash_of()} AS duplicate_hash FROM track_v), top AS (SELECT component, arg_max(duplicate_hash, comp.id) AS canon_hash FROM comp JOIN h ON h.id = comp.id GROUP BY 1),
  stored AS (SELECT component AS group_id, CASE WHEN component % 6 = 0 AND comp.id = component THEN 'gone' || duplicate_hash ELSE duplicate_hash END AS member_hash, canon_hash FROM comp JOIN h ON h.id = comp.id JOIN top USING (component))"""
FRESH = """s AS (SELECT id, date, platform, title, coalesce(artist, '') AS artist, coalesce(album, '') AS album, min(id) OVER (PARTITION BY title, coalesce(artist, ''), coalesce(album, '')) AS place FROM scrobble_v),
  fresh AS (SELECT date, title, artist, album, platform FROM s QUALIFY row_number() OVER (PARTITION BY date ORDER BY place, id) = 1)"""
COUNTS = "c AS (SELECT playlist_id, track_id, count(*) FILTER (side = 'base') AS base, count(*) FILTER (side = 'ours') AS ours, count(*) FILTER (side = 'theirs') AS theirs FROM item_v GROUP BY 1, 2)"
STATES = "states AS (SELECT playlist_id, 'a' AS remote, track_id, base, theirs FROM c UNION ALL SELECT playlist_id, 'b', track_id, base, ours FROM c)"
PLAYS = f"""plays AS (SELECT DISTINCT coalesce(f.canon_id, t.id) AS root_id, date_trunc('second', date) AS d FROM scrobble_v JOIN t USING (title) LEFT JOIN found f ON f.id = t.id), {ROLLUP},
  stats AS (SELECT root_id, count(*) AS play_count, max(d) AS last_play, min(d) AS first_play, any_value(rating) AS rating, CASE WHEN any_value(rating) IS NOT NULL THEN any_value(date_added) END AS rated_at, any_value(loved) AS loved,
  CASE WHEN any_value(loved) THEN any_value(date_added) END AS starred_at, least(min(d), any_value(date_added)) AS created_at FROM plays JOIN rollup USING (root_id) GROUP BY root_id)"""


def merged(has: str) -> str:
    return f"""WITH {ITEM}, {COUNTS}, tg AS (SELECT c.*, CASE WHEN {has} THEN greatest(0, ours + theirs - base) ELSE greatest(ours, theirs) END AS target FROM (SELECT *, sum(base) OVER (PARTITION BY playlist_id) AS nb FROM c) c),
  r AS (SELECT item_v.*, row_number() OVER (PARTITION BY playlist_id, side, track_id ORDER BY pos) AS occ FROM item_v WHERE side <> 'base')
  SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY side, pos) AS position, track_id FROM r JOIN tg USING (playlist_id, track_id)
  WHERE CASE side WHEN 'ours' THEN occ <= target ELSE occ <= target - least(ours, target) END"""


ARTIST = "CASE WHEN compilation THEN 'Compilations' ELSE coalesce(nullif(album_artist, ''), nullif(artist, ''), 'Unknown Artist') END"
NAME = "CASE WHEN track_number IS NOT NULL THEN coalesce(d || '-', '') || CASE WHEN track_number < 10 THEN '0' ELSE '' END || track_number || ' ' ELSE '' END || title"
PATHS = f"""paths AS (SELECT DISTINCT id, {part(ARTIST, 'n')} || '/' || {part("coalesce(nullif(album, ''), 'Unknown Album')", 'n')} || '/' || {part(NAME, 'n - length(tail)', True)} || tail AS path FROM (
  SELECT *, CASE WHEN s > 0 THEN ' ' || s ELSE '' END || '.' || e AS tail FROM (SELECT *, unnest(list_distinct([NULL, disc_number])) AS d0 FROM source_v) , (SELECT unnest([0, 1, 2]) AS s), (SELECT unnest([40, 35]) AS n), (SELECT unnest(['mp3', 'm4a']) AS e)))"""
PATHS = PATHS.replace("SELECT *, unnest(list_distinct([NULL, disc_number])) AS d0 FROM source_v", "SELECT *, NULL::INT AS d FROM source_v UNION ALL SELECT *, disc_number FROM source_v WHERE disc_number IS NOT NULL")
FIRST = ", ".join(f"arg_min({e}, id) FILTER ({e} IS NOT NULL) AS {n}" for n, e in (("track_n", "track_number"), ("disc_n", "disc_number"), ("compilation", "compilation"), ("year", "year"), ("duration", "CAST(round_even(nullif(duration_ms, 0) / 1000.0, 0) AS INT)"), ("loved", "CASE WHEN loved THEN true END"), ("rating", "CASE WHEN NOT rating_computed THEN rating END")))
NORM_ALIAS = f"a AS (SELECT *, '[' || title || ' / ' || artist || ' / ' || album || ']' AS alias_key, {norm('title')} AS title_norm, {norm('artist')} AS artist_norm, {norm('album')} AS album_norm FROM alias_v)"
CHAIN = "chain AS (SELECT id, CASE WHEN id % 100 >= 4 THEN id - 4 END AS canon_id FROM track_v)"

WHOLE = f"""{DEDUP}, {STORED}, first AS (SELECT duplicate_hash, min(id) AS f FROM h GROUP BY 1), ok AS (SELECT group_id FROM stored LEFT JOIN first ON member_hash = duplicate_hash GROUP BY 1 HAVING bool_and(f IS NOT NULL)),
  dec AS (SELECT member_hash, arg_max(f, group_id) AS target FROM stored JOIN ok USING (group_id) JOIN first ON canon_hash = duplicate_hash GROUP BY 1), told AS (SELECT h.id, found.canon_id AS auto, CASE WHEN member_hash IS NULL THEN found.canon_id WHEN target <> h.id THEN target END AS canon_id FROM h LEFT JOIN found ON h.id = found.id LEFT JOIN dec ON member_hash = duplicate_hash),
  walk(id, up, step) AS (SELECT id, canon_id, 1 FROM told WHERE canon_id IS NOT NULL UNION ALL SELECT w.id, t.canon_id, step + 1 FROM walk w JOIN told t ON t.id = w.up WHERE t.canon_id IS NOT NULL), flat AS (SELECT id, arg_max(up, step) AS root FROM walk GROUP BY 1),
  final AS (SELECT told.id, flat.root AS canon_id FROM told LEFT JOIN flat ON flat.id = told.id)"""
RANKED = """ranked AS (SELECT coalesce(f.canon_id, track_id) AS root_id, file_v.id, count(*) OVER (PARTITION BY coalesce(f.canon_id, track_id)) AS n,
  row_number() OVER (PARTITION BY coalesce(f.canon_id, track_id) ORDER BY bitrate // 1000 DESC, CASE ext WHEN 'flac' THEN 3 WHEN 'm4a' THEN 2 WHEN 'mp3' THEN 1 ELSE 0 END DESC, file_v.id) AS r FROM file_v LEFT JOIN final f ON f.id = track_id)"""
REVIEW = f"""{DEDUP}, {STORED}, rows AS (SELECT component, t.id, found.canon_id AS cand, CASE WHEN component % 2 = 1 THEN found.canon_id END AS now, duplicate_hash, title_norm, artist_norm, album_artist_norm, album_norm FROM found JOIN t ON t.id = found.id JOIN h ON h.id = t.id),
  pg AS (SELECT component, count(*) AS n_tracks, string_agg(duplicate_hash, chr(0) ORDER BY duplicate_hash) AS hashes, bool_or(now IS NOT NULL) AS pointed, bool_or(contains(title_norm, '1') OR contains(artist_norm, '1') OR contains(album_artist_norm, '1') OR contains(album_norm, '1')) AS has_one,
    any_value(coalesce(nullif(artist_norm, ''), nullif(album_artist_norm, ''), '?') || ' — ' || title_norm) FILTER (cand IS NULL) AS base_label FROM rows GROUP BY 1),
  grp AS (SELECT group_id, string_agg(member_hash, chr(0) ORDER BY member_hash) AS hashes FROM stored GROUP BY 1), hit AS (SELECT component, max(group_id) AS group_id FROM pg JOIN grp USING (hashes) GROUP BY 1),
  pick AS (SELECT rows.component, rows.id, now, canon_hash, (SELECT max(r2.id) FROM rows r2 WHERE r2.component = rows.component AND r2.duplicate_hash = canon_hash) AS target, group_id FROM rows LEFT JOIN hit USING (component) LEFT JOIN (SELECT DISTINCT * FROM stored) s USING (group_id) WHERE group_id IS NULL OR member_hash = duplicate_hash),
  conf AS (SELECT component, bool_and(group_id IS NOT NULL AND (canon_hash IS NULL OR target IS NOT NULL)) AS confirmed FROM pick GROUP BY 1),
  page AS (SELECT pg.component, base_label || CASE WHEN row_number() OVER (PARTITION BY base_label ORDER BY pg.component) > 1 THEN ' #' || row_number() OVER (PARTITION BY base_label ORDER BY pg.component) ELSE '' END AS label, n_tracks, confirmed, pointed, has_one, hashes,
    (SELECT string_agg(id || ':' || coalesce(CAST(CASE WHEN confirmed THEN target ELSE now END AS VARCHAR), '-'), ',' ORDER BY id) FROM pick WHERE pick.component = pg.component) AS members FROM pg JOIN conf USING (component))"""

SQL: dict[str, str] = {
    "normalize_name": f"WITH {TRACK}, {NORMED} SELECT id, title_norm, artist_norm, album_norm, album_artist_norm FROM t",
    "trigram_similarity": f"WITH {TRACK}, g AS (SELECT id, {grams('title')} AS a, {grams('title[1:3] || title[5:]')} AS b, {grams('album')} AS c FROM track_v) SELECT id, CAST({jaccard('a', 'b')} AS DOUBLE) AS to_typo, CAST({jaccard('a', 'c')} AS DOUBLE) AS to_album FROM g",
    "path_generate": f"WITH {TRACK}, {SOURCE}, {PATHS} SELECT id, path FROM paths",
    "text_scalars": f"""WITH {TRACK} SELECT id, '[' || title || ' / ' || coalesce(artist, '') || ' / ' || coalesce(album, '') || ']' AS label, album || ' #' || id || coalesce(chr(10) || artist, '') AS comment,
      CASE WHEN id % 2 = 0 THEN title ELSE 'Other/' || title END AS path, ((duration * 37) // 60) || ':' || lpad(CAST((duration * 37) % 60 AS VARCHAR), 2, '0') AS length, coalesce(artist, '?') || ' — ' || title AS group_label,
      CASE WHEN id % 13 = 0 THEN 'Compilations' ELSE coalesce(album_artist, artist, 'Unknown Artist') END AS path_artist, CAST(round_even((duration * 1000 + (id % 2) * 500) / 1000.0, 0) AS INT) AS seconds, {BUCKET} AS bucket FROM track_v""",
    "duplicate_hash": f"WITH {TRACK} SELECT id, {hash_of()} AS duplicate_hash FROM track_v",
    "status_counts": f"""{DEDUP}, {FILE}, {SCROBBLE} SELECT (SELECT count(*) FROM track_v) AS tracks, (SELECT count(*) FILTER (loved) FROM track_v) AS loved, (SELECT count(*) FILTER (coalesce(rating, 0) <> 0) FROM track_v) AS rated,
      (SELECT count(*) FROM file_v) AS files, (SELECT count(track_id) FROM file_v) AS bound, (SELECT count(*) FROM scrobble_v) AS scrobbles, (SELECT count(canon_id) FROM found) AS twins, (SELECT count(DISTINCT canon_id) FROM found) AS "groups",
      (SELECT count(track_id)::DOUBLE / count(*) FROM file_v) AS bound_share""",
    "scrobbles_by_platform": f"WITH {TRACK}, {SCROBBLE} SELECT platform, count(*) AS n_scrobbles, count(DISTINCT date) AS n_dates FROM scrobble_v GROUP BY platform",
    "dedup_single_set": f"WITH RECURSIVE {TRACK}, {NORMED}, {components(('artist', 'duration'))} SELECT * FROM found",
    "dedup_union_sets": f"{DEDUP} SELECT * FROM found",
    "dedup_canon_year": f"WITH RECURSIVE {TRACK}, {NORMED}, {YEAR} SELECT * FROM found",
    "dedup_manual_override": f"""{DEDUP}, {STORED}, first AS (SELECT duplicate_hash, min(id) AS f FROM h GROUP BY 1), ok AS (SELECT group_id FROM stored LEFT JOIN first ON member_hash = duplicate_hash GROUP BY 1 HAVING bool_and(f IS NOT NULL)),
      dec AS (SELECT member_hash, arg_max(f, group_id) AS target FROM stored JOIN ok USING (group_id) JOIN first ON canon_hash = duplicate_hash GROUP BY 1)
      SELECT found.id, CASE WHEN member_hash IS NULL THEN canon_id WHEN target <> found.id THEN target END AS canon_id FROM found JOIN h ON h.id = found.id LEFT JOIN dec ON member_hash = duplicate_hash""",
    "stored_groups": f"{DEDUP}, {STORED} SELECT group_id, string_agg(member_hash, '|' ORDER BY member_hash) AS hashes FROM stored GROUP BY 1",
    "canon_flatten": f"WITH {TRACK} SELECT id, CASE WHEN id % 100 >= 4 THEN id - id % 100 + id % 4 END AS canon_id FROM track_v",
    "main_file_pick": f"""{DEDUP}, {FILE} SELECT root_id, id AS file_id, n AS n_files FROM (SELECT coalesce(canon_id, track_id) AS root_id, file_v.id, count(*) OVER (PARTITION BY coalesce(canon_id, track_id)) AS n,
      row_number() OVER (PARTITION BY coalesce(canon_id, track_id) ORDER BY bitrate // 1000 DESC, CASE ext WHEN 'flac' THEN 3 WHEN 'm4a' THEN 2 WHEN 'mp3' THEN 1 ELSE 0 END DESC, file_v.id) AS r FROM file_v LEFT JOIN found f ON f.id = track_id) WHERE r = 1""",
    "group_rollup": f"{DEDUP}, {ROLLUP} SELECT * FROM rollup",
    "scrobble_fresh": f"WITH {TRACK}, {SCROBBLE}, {FRESH} SELECT * FROM fresh",
    "scrobble_import_stats": f"""WITH {TRACK}, {SCROBBLE}, {FRESH}, came AS (SELECT title, artist, album, count(DISTINCT date) AS n FROM scrobble_v GROUP BY ALL), took AS (SELECT title, artist, album, count(*) AS m FROM fresh GROUP BY ALL)
      SELECT CAST(sum(coalesce(m, 0)) AS BIGINT) AS scrobbles_created, CAST(sum(n - coalesce(m, 0)) AS BIGINT) AS scrobbles_ignored, count(*) FILTER (m IS NULL) AS aliases_skipped, count(m) AS aliases_created FROM came LEFT JOIN took USING (title, artist, album)""",
    "alias_augment": f"""WITH {TRACK}, {SCROBBLE}, {ALIAS}, {NORM_ALIAS} SELECT alias_key, CASE WHEN artist_norm = '' THEN coalesce((SELECT CASE WHEN count(DISTINCT b.artist_norm) = 1 THEN min(b.artist_norm) END FROM a b WHERE b.title_norm = a.title_norm AND b.artist_norm <> ''), '') ELSE artist_norm END AS artist_norm,
      CASE WHEN album_norm = '' THEN coalesce((SELECT CASE WHEN count(DISTINCT b.album_norm) = 1 THEN min(b.album_norm) END FROM a b WHERE b.title_norm = a.title_norm AND b.album_norm <> ''), '') ELSE album_norm END AS album_norm FROM a""",
    "alias_match_exact": f"""{DEDUP}, {SCROBBLE}, alias_v AS (SELECT DISTINCT title, artist, album FROM scrobble_v), {NORM_ALIAS}
      SELECT alias_key, id AS track_id FROM (SELECT alias_key, t.id, row_number() OVER (PARTITION BY alias_key ORDER BY canon_id ASC NULLS FIRST, t.album_artist_norm, t.artist_norm, t.album_norm, t.id) AS r FROM a JOIN t USING (title_norm) LEFT JOIN found f ON f.id = t.id WHERE a.artist_norm = '' AND title_norm <> '') WHERE r = 1""",
    "alias_match_fuzzy": f"""WITH {TRACK}, {SCROBBLE}, {ALIAS}, {NORMED}, {NORM_ALIAS}, x AS (SELECT *, {grams('title_norm')} AS g, {grams('artist_norm')} AS ga, {grams('album_norm')} AS gb FROM a WHERE artist_norm <> '' AND title_norm <> ''),
      tt AS (SELECT title_norm AS b, {grams('title_norm')} AS g FROM (SELECT DISTINCT title_norm FROM t)), xt AS (SELECT DISTINCT title_norm AS a, g FROM x), p AS (SELECT a, b, {jaccard('xt.g', 'tt.g')} AS sim FROM xt, tt),
      ok AS (SELECT * FROM p WHERE sim >= CAST(0.3 AS FLOAT) AND (a = b OR CAST(sim AS DOUBLE) >= 0.45 OR (length(a) >= 4 AND length(b) >= 4 AND (contains(a, b) OR contains(b, a))))),
      y AS (SELECT id, title_norm, {grams('artist_norm')} AS ta, {grams('album_artist_norm')} AS tb, {grams('album_norm')} AS tc FROM t),
      z AS (SELECT alias_key, id, sim, greatest({jaccard('ga', 'ta')}, {jaccard('ga', 'tb')})::DOUBLE * 0.75 + CASE WHEN album_norm = '' THEN 0.5 ELSE {jaccard('gb', 'tc')}::DOUBLE END * 0.25 AS score FROM x JOIN ok ON x.title_norm = ok.a JOIN y ON y.title_norm = ok.b)
      SELECT alias_key, id AS track_id, round(score, 6) AS score FROM z QUALIFY row_number() OVER (PARTITION BY alias_key ORDER BY score DESC, sim DESC, id) = 1 AND z.score >= 0.4""",
    "plays_copy": f"""WITH {TRACK}, {SCROBBLE}, {FRESH}, m AS (SELECT title, min(id) AS id FROM track_v GROUP BY 1) SELECT date AS played_at, m.id AS track_id, platform FROM fresh JOIN m USING (title) WHERE m.id % 4 <> 0""",
    "unify_tracks": f"WITH {TRACK}, {SOURCE} SELECT title, artist, album, album_artist, min(id) AS first_source, count(*) AS n_sources, {FIRST}, coalesce(first(date_added ORDER BY id), make_timestamp({RUN_TS}000000)) AS date_added FROM source_v GROUP BY 1, 2, 3, 4",
    "bind_files": f"""WITH {TRACK}, {SOURCE}, {PATHS}, f AS (SELECT id || ':' || path AS file_id, lower(CASE WHEN id % 4 = 0 THEN '/music/Library/' ELSE '/backup/old ' END || CASE WHEN id % 3 = 0 THEN upper(path) ELSE path END) AS p FROM paths),
      c AS (SELECT DISTINCT id, lower(path) AS low FROM paths), fp AS (SELECT file_id, p, string_split(p, '/')[-1] AS name FROM f), cp AS (SELECT id, low, string_split(low, '/')[-1] AS name FROM c) SELECT file_id, min(id) AS source_id FROM fp JOIN cp ON fp.name = cp.name AND contains(p, low) GROUP BY 1""",
    "orphan_files": f"""WITH {TRACK}, {SOURCE}, f AS (SELECT id, CASE WHEN id % 5 = 0 THEN title || '?' ELSE title END AS title, artist, album, album_artist, CASE WHEN id % 7 = 0 THEN 'n/a' ELSE year || '-01-01' END AS date FROM source_v)
      SELECT f.id, min(t.id) AS found_track, TRY_CAST(any_value(f.date)[1:4] AS INT) AS year FROM f LEFT JOIN track_v t ON f.title = t.title AND f.artist IS NOT DISTINCT FROM t.artist AND f.album IS NOT DISTINCT FROM t.album AND f.album_artist IS NOT DISTINCT FROM t.album_artist GROUP BY f.id""",
    "playlists_seed": f"""WITH {TRACK}, {SOURCE}, {ITEM}, l AS (SELECT playlist_id, pos, s.source_id AS track_id, date_added FROM item_v JOIN source_v s ON s.source_id = item_v.track_id AND provider = 'apple_xml' WHERE side = 'ours' AND s.id % 14 <> 0),
      m AS (SELECT playlist_id, track_id, min(pos) AS p FROM l GROUP BY 1, 2), d AS (SELECT playlist_id, min(date_added) AS lo, max(date_added) AS latest FROM l GROUP BY 1)
      SELECT playlist_id, track_id, row_number() OVER (PARTITION BY playlist_id ORDER BY p) AS position, CASE WHEN playlist_id % 2 = 0 THEN make_timestamp({RUN_TS}000000) ELSE lo END AS created_at, latest FROM m JOIN d USING (playlist_id) WHERE playlist_id % 9 <> 0""",
    "list_dedup_inflated": f"WITH {ITEM} SELECT playlist_id, track_id, row_number() OVER (PARTITION BY playlist_id ORDER BY min(pos)) AS position FROM item_v WHERE side = 'ours' GROUP BY playlist_id, track_id",
    "playlists_by_name": f"""WITH RECURSIVE {ITEM}, raw AS (SELECT playlist_id, list(track_id ORDER BY pos) AS tracks FROM item_v WHERE side = 'ours' GROUP BY 1),
      l AS (SELECT *, list_filter(tracks, lambda x, i: list_position(tracks, x) = i) AS once, list_sort(list_distinct(tracks)) AS own, 'list ' || playlist_id % 40 AS name, row_number() OVER (ORDER BY CASE WHEN playlist_id % 5 <> 0 THEN playlist_id % 97 END DESC NULLS LAST, playlist_id) AS n FROM raw),
      s AS (SELECT 0::BIGINT AS n, []::STRUCT(name VARCHAR, pid BIGINT, tracks BIGINT[])[] AS held UNION ALL SELECT l.n, CASE WHEN len(list_filter(held, lambda h: h.name = l.name)) > 0
          THEN list_transform(held, lambda h: CASE WHEN h.name = l.name THEN struct_pack(name := h.name, pid := h.pid, tracks := list_concat(h.tracks, list_filter(l.once, lambda x: NOT list_contains(h.tracks, x)))) ELSE h END)
        WHEN len(list_filter(held, lambda h: list_sort(list_distinct(h.tracks)) = l.own)) > 0 THEN held ELSE list_append(held, struct_pack(name := l.name, pid := l.playlist_id, tracks := l.tracks)) END FROM s JOIN l ON l.n = s.n + 1),
      e AS (SELECT unnest(held) AS h FROM (SELECT held FROM s ORDER BY n DESC LIMIT 1)) SELECT h.pid AS playlist_id, h.name AS name, CAST(generate_subscripts(h.tracks, 1) AS INT) AS position, unnest(h.tracks) AS track_id FROM e""",
    "auto_dedup": f"{WHOLE} SELECT * FROM final",
    "auto_dedup_mains": f"{WHOLE}, {FILE}, {RANKED} SELECT root_id, id AS file_id, n AS n_files FROM ranked WHERE r = 1",
    "auto_dedup_summary": f"""{WHOLE}, {FILE}, {RANKED}, same AS (SELECT root_id, bool_and((id % 100000 % 7 = 0) = (r = 1)) AS same FROM ranked GROUP BY 1)
      SELECT (SELECT count(DISTINCT canon_id) FROM final) AS n_groups, (SELECT count(canon_id) FROM final) AS n_twins, (SELECT count(*) FROM told WHERE auto IS DISTINCT FROM canon_id) AS n_overridden,
        (SELECT count(*) FROM told JOIN final USING (id) WHERE told.canon_id IS DISTINCT FROM final.canon_id) AS n_flattened, (SELECT count(*) FROM same WHERE NOT same) AS n_mains_changed""",
    "review_pages": f"{REVIEW} SELECT component, label, n_tracks, confirmed, pointed AND NOT confirmed AS auto_resolved, members FROM page",
    "review_filter": f"""{REVIEW}, p AS (SELECT *, pointed AND NOT confirmed AS auto FROM page), modes(mode, c, a) AS (VALUES ('resolved all', NULL, false), ('resolved unconfirmed', false, false), ('resolved confirmed', true, false), ('auto-resolved', false, true)), parts(partial) AS (VALUES (''), ('1')),
      k AS (SELECT mode, partial, p.* FROM modes, parts LEFT JOIN p ON auto = a AND (c IS NULL OR confirmed = c) AND (partial = '' OR has_one))
      SELECT mode, partial, count(component) AS n_pages, arg_min(component, struct_pack(x := NOT confirmed, y := hashes, z := component)) FILTER (component IS NOT NULL) AS first_page FROM k GROUP BY 1, 2""",
    "merge_with_base": merged("nb > 0"),
    "merge_no_base": merged("false"),
    "conflicts_detect": f"WITH {ITEM}, {COUNTS}, {STATES} SELECT playlist_id, track_id, count(DISTINCT remote) AS n_remotes FROM states GROUP BY 1, 2 HAVING max(theirs - base) > 0 AND min(theirs - base) < 0",
    "touched_tracks": f"WITH {ITEM}, {COUNTS} SELECT playlist_id, track_id FROM c WHERE ours <> base OR theirs <> base",
    "resolve_auto": f"""WITH {ITEM}, {COUNTS}, k AS (SELECT *, sum(base) OVER (PARTITION BY playlist_id) > 0 AS has FROM c), one AS (SELECT *, CASE WHEN has THEN greatest(0, base + theirs - base) ELSE greatest(base, theirs) END AS x FROM k)
      SELECT playlist_id, track_id, y AS copies FROM (SELECT *, CASE WHEN has THEN greatest(0, x + ours - base) ELSE greatest(x, ours) END AS y FROM one) WHERE y > 0""",
    "ref_count_ops": f"WITH {ITEM}, {COUNTS} SELECT playlist_id, 'ref' || track_id AS ref, ours AS want, theirs AS have FROM c WHERE ours <> theirs",
    "playlist_totals": f"WITH {TRACK}, {ITEM} SELECT playlist_id, count(t.id) AS song_count, CAST(coalesce(sum(duration), 0) AS BIGINT) AS seconds, CAST(coalesce(sum(duration * 1000 + track_n), 0) AS BIGINT) AS size FROM item_v LEFT JOIN track_v t ON t.id = CASE WHEN track_id % 4 = 0 THEN -1 ELSE track_id END WHERE side = 'ours' GROUP BY 1",
    "backend_only": f"WITH {ITEM} SELECT DISTINCT playlist_id FROM item_v WHERE side = 'theirs' AND playlist_id NOT IN (SELECT playlist_id FROM item_v WHERE side = 'base')",
    "resolved_refs": f"WITH {TRACK}, {ITEM}, {CHAIN} SELECT playlist_id, pos, coalesce(canon_id, track_id + 100) AS track_id FROM item_v LEFT JOIN chain ON chain.id = track_id + 100 WHERE side = 'theirs'",
    "play_stats": f"{DEDUP}, {SCROBBLE}, {PLAYS} SELECT * FROM stats",
    "album_stats": f"{DEDUP}, {SCROBBLE}, {PLAYS} SELECT album, CAST(sum(play_count) AS BIGINT) AS play_count, max(last_play) AS last_play, min(created_at) AS created_at, count(*) AS n_groups FROM stats JOIN (SELECT id, album FROM track_v) ON id = root_id GROUP BY album",
    "artist_stats": f"""{DEDUP}, {SCROBBLE}, {PLAYS}, roles AS (SELECT DISTINCT album, album_artist AS artist, CASE WHEN id % 2 = 0 THEN 'albumartist' ELSE 'artist' END AS role FROM track_v WHERE album_artist IS NOT NULL)
      SELECT roles.artist, CAST(sum(play_count) AS BIGINT) AS play_count, max(last_play) AS last_play FROM stats JOIN (SELECT id, album FROM track_v) ON id = root_id JOIN roles USING (album) GROUP BY 1""",
}
SQL["alias_match_misspelt"] = SQL["alias_match_fuzzy"].replace(ALIAS, ALIAS.replace("artist,", "artist[1:3] || artist[5:] AS artist,"))
