"""Queries over remotes and the server: domain tables that stand in for them, the queries, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import text as X
from tessitura.operators import dedup, push, reconcile
from tessitura.plans import views as V
from tessitura.plans.oracle import DEDUP
from tessitura.plans.scratch import written
from tessitura.plans.views import FILE, ITEM, SCROBBLE


def _text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _pair(a: str, b: Column) -> Column:
    return F.concat(F.lit(a), b.cast("string"))


# ---- playlists and remotes -------------------------------------------------------------------------------------------


def _root(c: Column) -> Column:
    """Tracks 17 and 19 are twins of the ones before them."""
    return F.when(c.isin(17, 19), c - 1).otherwise(c)


def _side(items: DataFrame, side: str) -> DataFrame:
    return items.where(F.col("side") == side).select("playlist_id", F.col("pos").cast("long").alias("pos"), "track_id")


def _state(spark: SparkSession, sf: str):
    """Playlists, ours, links and two remotes: a source, then a server whose two translations are no inverses of each other."""
    items = written(V.playlist_item_v(spark, sf), "items")  # narrow rows, read many times
    ours, base, theirs = (_side(items, s) for s in ("ours", "base", "theirs"))
    ours, base = (x.withColumn("track_id", _root(F.col("track_id"))) for x in (ours, base))
    playlists = written(items.select("playlist_id").distinct(), "playlists")
    held = written(reconcile.in_order(base, "playlist_id", "pos", "track_id", "base"), "bases")
    k = F.col("playlist_id")
    links = held.select("playlist_id", F.lit("server").alias("remote"), _pair("x", k).alias("external_id"), "base")
    links = links.union(held.where("playlist_id % 2 = 0").select("playlist_id", F.lit("source").alias("remote"), _pair("s", k).alias("external_id"), "base"))
    lists = written(theirs.select("playlist_id").distinct(), "lists")
    server_lists = lists.where("playlist_id % 11 <> 0").select(_pair("x", k).alias("external_id"), _pair("list ", k).alias("name"))
    server_items = theirs.where("playlist_id % 11 <> 0").select(_pair("x", k).alias("external_id"), "pos", _pair("m", F.col("track_id")).alias("ref"))
    t = spark.range(20).select(F.col("id").alias("t"))
    known = t.where("t <> 7").select(_pair("m", F.col("t")).alias("ref"), F.when(F.col("t") == 4, 3).otherwise(_root(F.col("t"))).cast("long").alias("canon"))
    offered = t.where("t % 5 <> 2").select(F.col("t").alias("canon"), _pair("m", F.col("t")).alias("ref"))
    source_lists = lists.where("playlist_id % 3 <> 0").select(_pair("s", k).alias("external_id"), _pair("list ", k).alias("name"))
    source_items = theirs.where("playlist_id % 3 <> 0").select(_pair("s", k).alias("external_id"), "pos", ((F.col("track_id") + 1) % 20).cast("string").alias("ref"))
    read = t.where("t <> 9").select(F.col("t").cast("string").alias("ref"), _root(F.col("t")).cast("long").alias("canon"))
    return playlists, ours, links, [reconcile.Remote("source", source_lists, source_items, read), reconcile.Remote("server", server_lists, server_items, known, offered)]


def _one(spark: SparkSession, sf: str, at: int):
    playlists, ours, links, remotes = _state(spark, sf)
    return reconcile.pair_sync(ours, reconcile.current_links(playlists, links, remotes[at]), remotes[at])


def pair_sync_source(spark, sf):
    return _one(spark, sf, 0).merged


def pair_sync_items(spark, sf):
    return _one(spark, sf, 1).merged


def pair_sync_ops(spark, sf):
    return _one(spark, sf, 1).ops


def pair_sync_links(spark, sf):
    return _one(spark, sf, 1).links.withColumn("base", _text(F.col("base")))


def server_after(spark, sf):
    """The server's lists once the operations of a pass are done."""
    playlists, ours, links, remotes = _state(spark, sf)
    linked = reconcile.current_links(playlists, links, remotes[1])
    return reconcile.remote_after(reconcile.membership(linked, remotes[1]), reconcile.pair_sync(ours, linked, remotes[1]).ops)


def _decisions(playlists: DataFrame) -> DataFrame:
    how = F.col("playlist_id") % 4
    return playlists.select("playlist_id", F.when(how == 0, "ours").when(how == 3, "auto").otherwise("take").alias("strategy"), F.when(how == 1, "source").when(how == 2, "server").alias("remote"))


def resolve_decisions(spark, sf):
    playlists, ours, links, remotes = _state(spark, sf)
    return reconcile.resolve(ours, reconcile.states_of(playlists, links, remotes), _decisions(playlists))


def remote_conflicts(spark, sf):
    playlists, _, links, remotes = _state(spark, sf)
    return reconcile.conflicted(reconcile.states_of(playlists, links, remotes))


def review_changes(spark, sf):
    """Lists that a run with review would ask about."""
    playlists, ours, links, remotes = _state(spark, sf)
    states = reconcile.states_of(playlists, links, remotes)
    return reconcile.changes(ours, states, reconcile.auto_fold(ours, states))


def _reconciled(spark, sf):
    playlists, ours, links, remotes = _state(spark, sf)
    return reconcile.reconcile(playlists, ours, links, remotes, _decisions(playlists))


def reconcile_items(spark, sf):
    return _reconciled(spark, sf).items


def reconcile_links(spark, sf):
    return _reconciled(spark, sf).links.withColumn("base", _text(F.col("base")))


def reconcile_pulled(spark, sf):
    return _reconciled(spark, sf).pulled


def base_from_json(spark, sf):
    """Stored bases as JSON text, and back to members with positions."""
    base = reconcile.in_order(_side(V.playlist_item_v(spark, sf), "base"), "playlist_id", "pos", "track_id", "base")
    stored = base.select("playlist_id", F.to_json("base").alias("synced_track_ids"))
    return stored.select("playlist_id", F.posexplode(reconcile.json_base(F.col("synced_track_ids"))).alias("pos", "track_id"))


def merged_sql(p: str, base: str, ours: str, theirs: str) -> str:
    """CTEs that end in ``p`` (playlist_id, pos, track_id): the merge of three tables of that shape."""
    return f"""{p}_c AS (SELECT playlist_id, track_id, count(*) FILTER (s = 'b') AS b, count(*) FILTER (s = 'o') AS o, count(*) FILTER (s = 't') AS t FROM (SELECT playlist_id, track_id, 'b' AS s FROM {base} UNION ALL SELECT playlist_id, track_id, 'o' FROM {ours} UNION ALL SELECT playlist_id, track_id, 't' FROM {theirs}) GROUP BY 1, 2),
  {p}_g AS (SELECT *, CASE WHEN sum(b) OVER (PARTITION BY playlist_id) > 0 THEN greatest(0, o + t - b) ELSE greatest(o, t) END AS target FROM {p}_c),
  {p}_r AS (SELECT playlist_id, track_id, pos, 0 AS s, row_number() OVER (PARTITION BY playlist_id, track_id ORDER BY pos) AS k FROM {ours} UNION ALL SELECT playlist_id, track_id, pos, 1, row_number() OVER (PARTITION BY playlist_id, track_id ORDER BY pos) FROM {theirs}),
  {p} AS (SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY s, pos) AS pos, track_id FROM {p}_r JOIN {p}_g USING (playlist_id, track_id) WHERE CASE s WHEN 0 THEN k <= target ELSE k <= target - least(o, target) END)"""


ROOT = "CASE WHEN track_id IN (17, 19) THEN track_id - 1 ELSE track_id END"
STATE = f"""{ITEM}, lists AS (SELECT DISTINCT playlist_id FROM item_v), ours AS (SELECT playlist_id, pos, {ROOT} AS track_id FROM item_v WHERE side = 'ours'), base AS (SELECT playlist_id, pos, {ROOT} AS track_id FROM item_v WHERE side = 'base'),
  theirs AS (SELECT playlist_id, pos, track_id FROM item_v WHERE side = 'theirs'), linked AS (SELECT DISTINCT playlist_id FROM base), there AS (SELECT DISTINCT playlist_id FROM theirs),
  srv_here AS (SELECT playlist_id FROM there JOIN linked USING (playlist_id) WHERE playlist_id % 11 <> 0), srv_rows AS (SELECT playlist_id, pos, 'm' || track_id AS ref, CASE WHEN track_id = 4 THEN 3 WHEN track_id <> 7 THEN {ROOT} END AS canon FROM theirs WHERE playlist_id IN (FROM srv_here)),
  srv_theirs AS (SELECT playlist_id, pos, canon AS track_id FROM srv_rows WHERE canon IS NOT NULL), srv_base AS (SELECT * FROM base WHERE playlist_id IN (FROM srv_here)),
  src_here AS (SELECT playlist_id FROM there JOIN linked USING (playlist_id) WHERE playlist_id % 2 = 0 AND playlist_id % 3 <> 0), src_theirs AS (SELECT playlist_id, pos, {ROOT} AS track_id FROM (SELECT playlist_id, pos, (track_id + 1) % 20 AS track_id FROM theirs WHERE playlist_id IN (FROM src_here)) WHERE track_id <> 9),
  src_state AS (SELECT * FROM base WHERE playlist_id % 2 = 0), src_base AS (SELECT * FROM base WHERE playlist_id IN (FROM src_here))"""


def pushed_sql(p: str, merged: str, rows: str, here: str) -> str:
    """CTEs for the refs that a merge pushes: ``p_want`` (playlist_id, pos, ref), ``p_ops`` and ``p_links``."""
    return f"""{p}_first AS (SELECT playlist_id, canon, ref, min(pos) AS f FROM {rows} WHERE canon IS NOT NULL GROUP BY 1, 2, 3), {p}_own AS (SELECT playlist_id, canon, arg_max(ref, f) AS ref FROM {p}_first GROUP BY 1, 2),
  {p}_want AS (SELECT * FROM (SELECT m.playlist_id, m.pos, coalesce(o.ref, CASE WHEN m.track_id % 5 <> 2 THEN 'm' || m.track_id END) AS ref FROM {merged} m LEFT JOIN {p}_own o ON o.playlist_id = m.playlist_id AND o.canon = m.track_id) WHERE ref IS NOT NULL),
  {p}_both AS (SELECT playlist_id, ref, count(*) FILTER (s = 1) AS have, count(*) FILTER (s = 0) AS want, min(pos) FILTER (s = 0) AS w, min(pos) FILTER (s = 1) AS h FROM (SELECT playlist_id, ref, pos, 0 AS s FROM {p}_want UNION ALL SELECT playlist_id, ref, pos, 1 FROM {rows}) GROUP BY 1, 2),
  {p}_ops AS (SELECT playlist_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY w IS NULL, coalesce(w, h), ref) AS INT) AS ord, ref, have, want FROM {p}_both WHERE have <> want),
  {p}_ext AS (SELECT playlist_id, 'x' || playlist_id AS external_id FROM {here} UNION ALL SELECT DISTINCT playlist_id, 'new:' || playlist_id FROM {p}_want WHERE playlist_id NOT IN (FROM {here})),
  {p}_read AS (SELECT playlist_id, pos, CASE WHEN ref = 'm4' THEN 3 WHEN ref = 'm17' THEN 16 WHEN ref = 'm19' THEN 18 WHEN ref <> 'm7' THEN CAST(ref[2:] AS BIGINT) END AS c FROM {p}_want),
  {p}_links AS (SELECT playlist_id, external_id, coalesce(b, '') AS base FROM {p}_ext LEFT JOIN (SELECT playlist_id, string_agg(c, ',' ORDER BY pos) AS b FROM {p}_read WHERE c IS NOT NULL GROUP BY 1) USING (playlist_id))"""


SERVER = f"{STATE}, {merged_sql('sm', 'srv_base', 'ours', 'srv_theirs')}, {pushed_sql('s', 'sm', 'srv_rows', 'srv_here')}"
TWO = "two AS (SELECT 'source' AS remote, playlist_id, track_id, 1 AS b, 0 AS t FROM src_state UNION ALL SELECT 'source', playlist_id, track_id, 0, 1 FROM src_theirs UNION ALL SELECT 'server', playlist_id, track_id, 1, 0 FROM srv_base UNION ALL SELECT 'server', playlist_id, track_id, 0, 1 FROM srv_theirs)"
CLASH = f"{TWO}, deltas AS (SELECT remote, playlist_id, track_id, sum(t) - sum(b) AS d FROM two GROUP BY 1, 2, 3), clash AS (SELECT playlist_id, track_id, count(*) AS n_remotes FROM deltas GROUP BY 1, 2 HAVING max(d) > 0 AND min(d) < 0)"
FOLD = f"{merged_sql('f1', 'src_state', 'ours', 'src_theirs')}, {merged_sql('f2', 'srv_base', 'f1', 'srv_theirs')}"
TAKEN = """SELECT playlist_id, pos, track_id FROM ours WHERE playlist_id % 4 = 0 UNION ALL SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY pos), track_id FROM src_theirs WHERE playlist_id % 4 = 1
  UNION ALL SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY pos), track_id FROM srv_theirs WHERE playlist_id % 4 = 2"""
RECONCILED = f"""{STATE}, {CLASH}, forced AS (SELECT DISTINCT playlist_id FROM clash WHERE playlist_id % 4 <> 3), start AS (SELECT * FROM ours WHERE playlist_id NOT IN (FROM forced) UNION ALL SELECT * FROM ({TAKEN}) WHERE playlist_id IN (FROM forced)),
  rs_base AS (SELECT * FROM src_base WHERE playlist_id NOT IN (FROM forced) UNION ALL SELECT * FROM src_theirs WHERE playlist_id IN (FROM forced)), rs_in AS (SELECT * FROM start WHERE playlist_id IN (FROM src_here)), {merged_sql('rs', 'rs_base', 'rs_in', 'src_theirs')},
  mid AS (SELECT * FROM rs UNION ALL SELECT * FROM start WHERE playlist_id NOT IN (FROM src_here)), rv_base AS (SELECT * FROM srv_base WHERE playlist_id NOT IN (FROM forced) UNION ALL SELECT * FROM srv_theirs WHERE playlist_id IN (FROM forced)), {merged_sql('rv', 'rv_base', 'mid', 'srv_theirs')},
  {pushed_sql('v', 'rv', 'srv_rows', 'srv_here')}, fresh AS (SELECT playlist_id AS old, (SELECT max(playlist_id) FROM lists) + row_number() OVER (ORDER BY 'x' || playlist_id) AS playlist_id FROM there WHERE playlist_id % 11 <> 0 AND playlist_id NOT IN (FROM srv_here)),
  pull AS (SELECT fresh.playlist_id, pos, track_id AS raw, CASE WHEN track_id = 4 THEN 3 WHEN track_id <> 7 THEN {ROOT} END AS track_id FROM theirs JOIN fresh ON theirs.playlist_id = old), pulled AS (SELECT * FROM pull WHERE track_id IS NOT NULL),
  pull_first AS (SELECT playlist_id, track_id, raw, min(pos) AS f FROM pulled GROUP BY 1, 2, 3), pull_ref AS (SELECT playlist_id, track_id, arg_max(raw, f) AS raw FROM pull_first GROUP BY 1, 2)"""


# ---- the server's statistics ---------------------------------------------------------------------------------------


def _when(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.cast("long"))


def _canon(spark: SparkSession, sf: str) -> DataFrame:
    t = V.track_v(spark, sf)
    return dedup.find_duplicates(t.withColumns({f"{f}_norm": X.normalize_name(F.col(f), nfkc=False) for f in ("title", "artist", "album", "album_artist")})).select("id", "canon_id")


def _server(spark: SparkSession, sf: str) -> push.Push:
    t, k = V.track_v(spark, sf), F.col("id")
    tracks = t.select("id", "title", "album", "album_artist", "date_added", "rating", "loved", F.when(k % 6 != 0, ((k % 4) * 20).cast("int")).alias("album_rating"), (k % 12 == 0).alias("album_loved"))
    first = V.file_v(spark, sf).groupBy("track_id").agg(F.min("id").alias("first"))
    files = V.file_v(spark, sf).join(first, "track_id").select("id", "track_id", (F.col("id") == F.col("first")).alias("is_main"), F.when((F.col("id") == F.col("first")) & (F.col("track_id") % 5 != 0), F.concat(_pair("Library/Music/t", F.col("track_id")), F.lit(".mp3"))).alias("library_path"))
    plays = V.scrobble_v(spark, sf).select(F.col("date").alias("played_at"), "title").join(t.select(k.alias("track_id"), "title"), "title").select("track_id", "played_at")
    media = tracks.where("id % 7 <> 0").select(_pair("mf", k).alias("id"), F.concat(_pair("Music/t", k), F.lit(".mp3")).alias("path"), _pair("al ", F.col("album")).alias("album_id"), _when(1_400_000_000 + k * 3600).alias("created_at"))
    albums = tracks.select(_pair("al ", F.col("album")).alias("id")).distinct().select("id", _when(F.lit(1_300_000_000)).alias("created_at"))
    role = F.when(k % 3 == 0, "albumartist").when(k % 3 == 1, "artist").otherwise("composer")
    artists = tracks.where("album_artist is not null").select(_pair("al ", F.col("album")).alias("album_id"), _pair("ar ", F.col("album_artist")).alias("artist_id"), role.alias("role"))
    artists = artists.union(t.where("artist is not null").select(_pair("al ", F.col("album")), _pair("ar ", F.col("artist")), role)).distinct()
    scrobbles = tracks.where("id % 3 = 0").select(_pair("mf", k).alias("media_file_id"), (1_234_567_890 + k).alias("submission_time"))
    none = F.lit(None)
    marked = tracks.where("id % 10 = 0").select(_pair("mf", k).alias("item_id"), F.lit("media_file").alias("item_type"), F.lit(5).cast("long").alias("play_count"), _when(F.lit(1_000_000_000)).alias("play_date"), F.lit(40).alias("rating"), _when(F.lit(1_000_000_001)).alias("rated_at"), F.lit(True).alias("starred"), _when(F.lit(1_000_000_002)).alias("starred_at"))
    of_albums = tracks.where("id % 15 = 0").select(_pair("al ", F.col("album"))).distinct().select("*", F.lit("album"), F.lit(5).cast("long"), _when(F.lit(2_000_000_000)), F.lit(60), _when(F.lit(1_000_000_001)), F.lit(False), none.cast("timestamp"))
    annotations = marked.union(of_albums)
    return push.push_stats(tracks, _canon(spark, sf), files, plays, media, albums, artists, scrobbles, annotations)


def push_tracks(spark, sf):
    return _server(spark, sf).tracks


def push_scrobbles(spark, sf):
    return _server(spark, sf).scrobbles


def push_annotations(spark, sf):
    return _server(spark, sf).annotations


def push_media(spark, sf):
    return _server(spark, sf).media


def push_albums(spark, sf):
    return _server(spark, sf).albums


PUSH = f"""{DEDUP}, {FILE}, {SCROBBLE}, root AS (SELECT t.id, coalesce(canon_id, t.id) AS root_id FROM track_v t LEFT JOIN found f ON f.id = t.id),
  facts AS (SELECT root_id, min(date_added) AS added, max(rating) FILTER (rating <> 0) AS rating, CAST(max((t.id % 4) * 20) FILTER (t.id % 6 <> 0 AND t.id % 4 <> 0) AS INT) AS album_rating, coalesce(bool_or(loved), false) AS loved, bool_or(t.id % 12 = 0) AS album_loved FROM track_v t JOIN root USING (id) GROUP BY 1),
  owned AS (SELECT t.id AS track_id, root_id, 'mf' || t.id AS media_id, 'al ' || album AS album_id, make_timestamp((1400000000 + t.id * 3600) * 1000000) AS created_at FROM track_v t JOIN root USING (id) WHERE t.id IN (SELECT track_id FROM file_v) AND t.id % 5 <> 0 AND t.id % 7 <> 0),
  secs AS (SELECT DISTINCT root_id, CAST(epoch(date) AS BIGINT) AS s FROM scrobble_v JOIN (SELECT id AS tid, title FROM track_v) USING (title) JOIN root ON root.id = tid), had AS (SELECT 'mf' || id AS m, 1234567890 + id AS s FROM track_v WHERE id % 3 = 0),
  every AS (SELECT m, s FROM had UNION SELECT media_id, s FROM secs JOIN owned USING (root_id)), agg AS (SELECT m, count(*) AS n, max(s) AS hi, min(s) AS lo FROM every GROUP BY 1),
  done AS (SELECT track_id, root_id, media_id, album_id, created_at, added, rating, album_rating, loved, album_loved, coalesce(n, 0) AS play_count, make_timestamp(hi * 1000000) AS last_play, make_timestamp(lo * 1000000) AS first_play FROM owned JOIN facts USING (root_id) LEFT JOIN agg ON m = media_id)"""
ALBUM_TOTALS = "totals AS (SELECT album_id, CAST(sum(play_count) AS BIGINT) AS play_count, max(last_play) AS play_date, arg_min(struct_pack(t := track_id, r := album_rating, a := added), track_id) FILTER (album_rating IS NOT NULL) AS r, arg_min(struct_pack(t := track_id, a := added), track_id) FILTER (album_loved) AS l FROM done GROUP BY 1)"
HAD_ALBUM = "had_album AS (SELECT DISTINCT 'al ' || album AS album_id FROM track_v WHERE id % 15 = 0)"
T = lambda s: f"make_timestamp({s}000000)"

SQL = {
    "pair_sync_source": f"WITH {STATE}, o AS (SELECT * FROM ours WHERE playlist_id IN (FROM src_here)), {merged_sql('m', 'src_base', 'o', 'src_theirs')} SELECT * FROM m UNION ALL SELECT playlist_id, pos, track_id FROM ours WHERE playlist_id NOT IN (FROM src_here)",
    "pair_sync_items": f"WITH {SERVER} SELECT * FROM sm",
    "pair_sync_ops": f"WITH {SERVER} SELECT * FROM s_ops",
    "pair_sync_links": f"WITH {SERVER} SELECT * FROM s_links",
    "server_after": f"""WITH {SERVER}, rows AS (SELECT playlist_id, 0 AS later, pos, ref FROM srv_rows ANTI JOIN s_ops USING (playlist_id, ref) UNION ALL SELECT playlist_id, 1, ord, unnest(list_transform(range(want), lambda x: ref)) FROM s_ops)
      SELECT playlist_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY later, pos) AS INT) AS pos, ref FROM rows""",
    "resolve_decisions": f"WITH {STATE}, {FOLD} SELECT playlist_id, pos, track_id FROM f2 WHERE playlist_id % 4 = 3 UNION ALL {TAKEN}",
    "remote_conflicts": f"WITH {STATE}, {CLASH} SELECT * FROM clash",
    "review_changes": f"""WITH {STATE}, {FOLD}, l AS (SELECT 'o' AS s, * FROM ours UNION ALL SELECT 'f', * FROM f2 UNION ALL SELECT 'vb', * FROM srv_base UNION ALL SELECT 'vt', * FROM srv_theirs UNION ALL SELECT 'sb', * FROM src_state UNION ALL SELECT 'st', * FROM src_theirs),
      a AS (SELECT s, playlist_id, string_agg(track_id, ',' ORDER BY pos) AS x FROM l GROUP BY 1, 2), p AS (PIVOT a ON s IN ('o', 'f', 'vb', 'vt', 'sb', 'st') USING any_value(x) GROUP BY playlist_id)
      SELECT playlist_id FROM p WHERE o IS DISTINCT FROM f OR vb IS DISTINCT FROM vt OR sb IS DISTINCT FROM st""",
    "reconcile_items": f"WITH {RECONCILED} SELECT * FROM rv UNION ALL SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY pos), track_id FROM pulled",
    "reconcile_links": f"""WITH {RECONCILED}, pl AS (SELECT playlist_id, pos, CASE WHEN r.raw = 4 THEN 3 WHEN r.raw IN (17, 19) THEN r.raw - 1 ELSE r.raw END AS c FROM pulled JOIN pull_ref r USING (playlist_id, track_id))
      SELECT playlist_id, 'server' AS remote, external_id, base FROM v_links
      UNION ALL SELECT playlist_id, 'server', 'x' || any_value(old), coalesce(string_agg(c, ',' ORDER BY pos), '') FROM fresh LEFT JOIN pl USING (playlist_id) GROUP BY 1
      UNION ALL SELECT playlist_id, 'source', 's' || playlist_id, coalesce(string_agg(track_id, ',' ORDER BY pos), '') FROM src_here LEFT JOIN src_theirs USING (playlist_id) GROUP BY 1
      UNION ALL SELECT playlist_id, 'source', 's' || playlist_id, string_agg(track_id, ',' ORDER BY pos) FROM src_state WHERE playlist_id NOT IN (FROM src_here) GROUP BY 1""",
    "reconcile_pulled": f"WITH {RECONCILED} SELECT playlist_id, 'server' AS remote, 'x' || old AS external_id, 'list ' || old AS name FROM fresh",
    "base_from_json": f"WITH {ITEM} SELECT playlist_id, CAST(pos - 1 AS INT) AS pos, track_id FROM item_v WHERE side = 'base'",
    "push_tracks": f"{PUSH} SELECT * FROM done",
    "push_scrobbles": f"{PUSH} SELECT m AS media_file_id, s AS submission_time FROM every ANTI JOIN had USING (m, s)",
    "push_media": f"{PUSH} SELECT media_id AS id, least(created_at, first_play, added) AS created_at, least(created_at, first_play, added) AS birth_time FROM done",
    "push_albums": f"{PUSH} SELECT album_id AS id, least({T(1300000000)}, min(first_play), min(added)) AS created_at FROM done GROUP BY 1",
    "push_annotations": f"""{PUSH}, {ALBUM_TOTALS}, {HAD_ALBUM}, roles AS (SELECT DISTINCT 'al ' || album AS album_id, 'ar ' || a AS artist_id, id % 3 AS k FROM (SELECT id, album, album_artist AS a FROM track_v UNION ALL SELECT id, album, artist FROM track_v) WHERE a IS NOT NULL AND id % 3 <> 2),
      mf AS (SELECT 'mf' || id AS item_id FROM track_v WHERE id % 10 = 0), al AS (SELECT coalesce(totals.album_id, had_album.album_id) AS item_id, had_album.album_id IS NOT NULL AS had, totals.* EXCLUDE (album_id) FROM totals FULL JOIN had_album USING (album_id))
      SELECT coalesce(item_id, media_id) AS item_id, 'media_file' AS item_type, coalesce(play_count, 5) AS play_count, CASE WHEN media_id IS NULL THEN {T(1000000000)} ELSE last_play END AS play_date, coalesce(rating, CASE WHEN item_id IS NOT NULL THEN 40 END) AS rating,
        CASE WHEN rating IS NOT NULL THEN added WHEN item_id IS NOT NULL THEN {T(1000000001)} END AS rated_at, coalesce(loved, false) OR item_id IS NOT NULL AS starred, CASE WHEN loved THEN added WHEN item_id IS NOT NULL THEN {T(1000000002)} END AS starred_at FROM done FULL JOIN mf ON item_id = media_id
      UNION ALL SELECT item_id, 'album', coalesce(play_count, 5), coalesce(play_date, CASE WHEN had THEN {T(2000000000)} END), CASE WHEN had THEN 60 ELSE r.r END,
        CASE WHEN l IS NOT NULL AND (had OR r IS NULL OR l.t >= r.t) THEN l.a WHEN had THEN {T(1000000001)} ELSE r.a END, l IS NOT NULL, NULL FROM al
      UNION ALL SELECT artist_id, 'artist', CAST(sum(play_count) AS BIGINT), max(play_date), NULL, NULL, false, NULL FROM roles JOIN totals USING (album_id) GROUP BY 1""",
}

QUERIES = (
    pair_sync_source, pair_sync_items, pair_sync_ops, pair_sync_links, server_after, resolve_decisions, remote_conflicts, review_changes, reconcile_items, reconcile_links, reconcile_pulled, base_from_json, push_tracks, push_scrobbles,
    push_annotations, push_media, push_albums,
)
