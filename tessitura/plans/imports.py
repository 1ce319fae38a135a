"""Queries over sources and sinks: exports are written from the driver's tables into the shared folder by Spark, read back, and compared with the tables."""

from __future__ import annotations

import contextlib
import uuid
import zipfile

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import text as X
from tessitura.operators import commits, dedup, history, sinks, unify
from tessitura.plans import views as V
from tessitura.plans.oracle import ARTIST, DEDUP, FRESH, NAME, STORED, norm, part
from tessitura.plans.scratch import partitions, shared_dir, shuffles_dropped, written
from tessitura.plans.views import FILE, ITEM, SCROBBLE, SOURCE, TRACK
from tessitura.sources import detect as D
from tessitura.sources import exports
from tessitura.sources.records import filesystem

BLOCKS = 8  # files of an export, at least


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/export-{uuid.uuid4().hex}/{name}"


def _lines(rows: DataFrame, value: Column, folder: str, suffix: str, key: str = "id", head: str = "", tail: str = "", between: str = "", blocks: int | None = None) -> str:
    """Write ``value`` of every row, in order of ``key``, into one file for each of ``blocks``: rows stream into their files, each on a line of its own, between lines of head and tail,
    ``between`` in front of every row but a file's first. A task writes, sorts and later reads one file, so there are as many as the session has partitions: what a task holds doesn't grow with the input alone."""
    spark = rows.sparkSession
    blocks = blocks or max(BLOCKS, partitions(spark))
    b = (F.col(key) % blocks).cast("int").alias("b")
    if between:
        first = rows.groupBy(b).agg(F.min(key).alias("_first"))  # a row for each file
        each = rows.join(F.broadcast(first), F.col(key) % blocks == F.col("b"))
        each = each.select("b", F.lit(1).alias("o"), F.col(key).alias("k"), F.concat(F.when(F.col(key) == F.col("_first"), "").otherwise(between), value).alias("v"))
    else:
        each = rows.select(b, F.lit(1).alias("o"), F.col(key).alias("k"), value.alias("v"))
    if head:
        ends = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(head).alias("v")), F.struct(F.lit(2).alias("o"), F.lit(tail).alias("v")))).alias("x")
        each = each.union(spark.range(blocks).select(F.col("id").cast("int").alias("b"), ends).select("b", "x.o", F.lit(0).alias("k"), "x.v"))
    with shuffles_dropped(spark):
        each.repartitionById(blocks, "b").sortWithinPartitions("b", "o", "k").select("b", "v").write.partitionBy("b").text(folder)
    # Spark's text writer names its files itself; the readers go by their suffix
    store, where = filesystem(folder)
    made = [x.path for x in store.get_file_info(fs.FileSelector(where, recursive=True)) if "/part-" in x.path]
    for i, f in enumerate(sorted(made)):
        store.move(f, f"{where}/{i}.{suffix}")
    for x in store.get_file_info(fs.FileSelector(where)):
        if x.base_name.startswith("b="):
            store.delete_dir(x.path)
    return folder


def _xml(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _entry(name: str, kind: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<key>{name}</key><{kind}>"), value, F.lit(f"</{kind}>")), F.lit(""))


def _flag(name: str, value: Column) -> Column:
    return F.coalesce(F.when(value, F.lit(f"<key>{name}</key><true/>")).when(~value, F.lit(f"<key>{name}</key><false/>")), F.lit(""))


def _time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


PLIST = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE plist PUBLIC "-//Apple//DTD PLIST 1.0//EN" "http://www.apple.com/DTDs/PropertyList-1.0.dtd">\n<plist version="1.0"><dict>'


def _plist_tracks(spark: SparkSession, sf: str) -> str:
    t, s = V.track_v(spark, sf), lambda c: F.col(c).cast("string")
    value = F.concat(
        F.lit("<key>"), s("id"), F.lit("</key><dict>"), _entry("Track ID", "integer", s("id")), _entry("Name", "string", _xml(F.col("title"))), _entry("Artist", "string", _xml(F.col("artist"))), _entry("Album", "string", _xml(F.col("album"))),
        _entry("Album Artist", "string", _xml(F.col("album_artist"))), _entry("Track Number", "integer", s("track_n")), _entry("Disc Number", "integer", s("disc_n")), _entry("Year", "integer", s("year")), _entry("Total Time", "integer", (F.col("duration") * 1000).cast("string")),
        _entry("Rating", "integer", s("rating")), _flag("Loved", F.col("loved")), _entry("Date Added", "date", _time(F.col("date_added"))), _flag("Apple Music", F.when(F.col("id") % 4 == 0, True)), _entry("Persistent ID", "string", F.upper(F.hex("id"))), F.lit("</dict>"),
    )
    return _lines(t, value, _folder(spark, "library"), "xml", head=f"{PLIST}<key>Tracks</key><dict>", tail="</dict></dict></plist>")


def plist_tracks(spark, sf):
    t = exports.plist_tracks(spark, _plist_tracks(spark, sf))
    more = [F.expr("variant_get(extra, '$.apple_music', 'boolean')").alias("apple_music"), F.expr("variant_get(extra, '$.persistent_id', 'string')").alias("persistent_id")]
    return t.select("provider", "source_id", "title", "artist", "album", "album_artist", "track_number", "disc_number", "year", "duration_ms", "loved", "rating", "date_added", *more)


def plist_members(spark, sf):
    """Lists of a property-list library; a seventh of the tracks isn't known, some lists are smart."""
    items = V.playlist_item_v(spark, sf, "ours").groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("pos", "track_id"))).alias("m"))
    entry = F.transform("m", lambda x: F.concat(F.lit("<dict><key>Track ID</key><integer>"), x["track_id"].cast("string"), F.lit("</integer></dict>")))
    k = F.col("playlist_id").cast("string")
    value = F.concat(F.lit("<dict>"), _entry("Name", "string", F.concat(F.lit("list "), k)), _entry("Playlist Persistent ID", "string", k), F.when(F.col("playlist_id") % 9 == 0, F.lit("<key>Smart Info</key><data>AAAA</data>")).otherwise(F.lit("")), F.lit("<key>Playlist Items</key><array>"), F.array_join(entry, ""), F.lit("</array></dict>"))
    path = _lines(items, value, _folder(spark, "lists"), "xml", key="playlist_id", head=f"{PLIST}<key>Playlists</key><array>", tail="</array></dict></plist>")
    known = spark.range(20).where("id % 7 <> 0").select(F.col("id").cast("string").alias("source_id"))
    return exports.plist_members(exports.plist_playlists(spark, path), known).select(F.col("list_id").cast("long").alias("playlist_id"), F.col("source_id").cast("long").alias("track_id"), "position")


def _media_export(spark: SparkSession, sf: str) -> str:
    t = V.track_v(spark, sf)
    record = F.struct(
        F.col("id").alias("Track Identifier"), F.col("title").alias("Title"), F.col("artist").alias("Artist"), F.col("album").alias("Album"), F.col("track_n").alias("Track Number On Album"), F.col("year").alias("Track Year"),
        (F.col("duration") * 1000).alias("Track Duration"), F.when(F.col("id") % 3 == 0, F.col("id") % 2 == 0).alias("Is Part of Compilation"), _time(F.col("date_added")).alias("Date Added To Library"), F.col("rating").alias("Track Like Rating"),
    )
    return _lines(t, F.to_json(record), _folder(spark, exports.TRACKS_ENTRY), "json", head="[", tail="]", between=",")


def media_services_tracks(spark, sf):
    rows = exports.media_services_tracks(spark, _media_export(spark, sf))
    return rows.select("provider", "source_id", "title", "artist", "album", "track_number", "year", "duration_ms", "compilation", "date_added", F.expr("variant_get(extra, '$.track_like_rating', 'int')").alias("like_rating"))


def _archived(spark: SparkSession, folder: str, names: tuple[str, ...]) -> str:
    """The files of a folder as archives beside it, one for each, packed by tasks as streams: ``names`` lead to the file, the last one within the innermost archive."""
    to = f"{folder}-archives"
    store, where = filesystem(folder)
    files = [x.path for x in store.get_file_info(fs.FileSelector(where)) if x.is_file]
    target = filesystem(to)[1]
    store.create_dir(target)

    def pack(batches):
        own = filesystem(folder)[0]
        for b in batches:
            for path in b["path"]:
                with contextlib.ExitStack() as stack, own.open_input_stream(path) as data:
                    out = stack.enter_context(own.open_output_stream(f"{target}/{path.rsplit('/', 1)[-1]}.zip"))
                    for name in names:
                        out = stack.enter_context(stack.enter_context(zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)).open(name, "w", force_zip64=True))
                    while chunk := data.read(1 << 20):
                        out.write(chunk)
            yield b

    spark.createDataFrame([(x,) for x in files], "path string").repartition(len(files)).mapInPandas(pack, "path string").count()
    return to


def archive_tracks(spark, sf):
    """Tracks from archives within archives, each member a partition."""
    names = ("deep/export.zip", f"x/{exports.TRACKS_ENTRY}.json.zip", "tracks.json")
    rows = exports.media_services_tracks(spark, _archived(spark, _media_export(spark, sf), names))
    return rows.select("provider", "source_id", "title", "artist", "album", "duration_ms", "compilation")


def media_services_members(spark, sf):
    items = V.playlist_item_v(spark, sf).where("side = 'ours'").groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("pos", "track_id"))).alias("m"))
    kind = F.when(F.col("playlist_id") % 9 == 0, "Smart Playlist").otherwise("Playlist")
    record = F.struct(F.col("playlist_id").alias("Container Identifier"), F.concat(F.lit("list "), F.col("playlist_id").cast("string")).alias("Title"), kind.alias("Container Type"), F.col("m.track_id").alias("Playlist Item Identifiers"))
    path = _lines(items, F.to_json(record), _folder(spark, exports.PLAYLISTS_ENTRY), "json", key="playlist_id", head="[", tail="]", between=",")
    known = spark.range(20).where("id % 7 <> 0").select(F.col("id").cast("string").alias("source_id"))
    return exports.media_services_members(exports.media_services_playlists(spark, path), known).select(F.col("list_id").cast("long").alias("playlist_id"), F.col("source_id").cast("long").alias("track_id"), "position")


def _heard(spark: SparkSession, sf: str) -> DataFrame:
    """Scrobbles with a length; some are too short, some lack title, artist or album."""
    s, k = V.scrobble_v(spark, sf), F.col("id")
    return s.select("id", "date", F.when(k % 13 != 0, F.col("title")).alias("title"), F.nullif("artist", F.lit("")).alias("artist"), F.nullif("album", F.lit("")).alias("album"), (20_000 + (k % 5) * 5_000).alias("ms"))


def play_activity(spark, sf):
    kind = F.when(F.col("id") % 4 == 0, "PLAY_START").otherwise("PLAY_END")
    end = F.when(F.col("id") % 6 == 0, _time(F.col("date")))
    rows = _heard(spark, sf).select(kind.alias("Event Type"), F.col("album").alias("Album Name"), F.col("title").alias("Song Name"), F.col("ms").alias("Play Duration Milliseconds"), F.when(F.col("id") % 6 != 0, _time(F.col("date"))).alias("Event Timestamp"), end.alias("Event End Timestamp"), F.col("id").alias("Event Number"))
    path = _folder(spark, f"{exports.ACTIVITY_ENTRY}.csv")
    rows.write.option("header", "true").csv(path)
    return exports.play_activity(spark, path)


def _history(spark, sf) -> tuple[DataFrame, DataFrame]:
    names = (("ts", _time(F.col("date"))), ("ms_played", F.col("ms")), ("master_metadata_track_name", F.col("title")), ("master_metadata_album_artist_name", F.col("artist")), ("master_metadata_album_album_name", F.col("album")))
    record = F.struct(*[c.alias(n) for n, c in names])
    return exports.streaming_history(spark, _lines(_heard(spark, sf), F.to_json(record), _folder(spark, "history"), "json", head="[", tail="]", between=","))


def streaming_history(spark, sf):
    return _history(spark, sf)[0]


def history_quarantine(spark, sf):
    """Rows of a streaming history that are set apart."""
    return _history(spark, sf)[1]


def listens(spark, sf):
    when = F.when(F.col("id") % 2 == 0, F.col("date").cast("long").cast("string")).otherwise(_time(F.col("date")))
    record = F.struct(when.alias("listened_at"), F.struct(F.col("title").alias("track_name"), F.col("artist").alias("artist_name"), F.col("album").alias("release_name")).alias("track_metadata"))
    return exports.listens(spark, _lines(_heard(spark, sf), F.to_json(record), _folder(spark, "listens"), "jsonl"))


def scrobble_csv(spark, sf):
    """Headerless rows; a sixth has no date, a thirteenth no title."""
    h, e = _heard(spark, sf), F.lit("")
    text = F.when(F.col("id") % 6 == 0, "01 Jan 1970 00:00").otherwise(F.date_format("date", "dd MMM yyyy HH:mm"))
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, e), F.lit('"'))
    row = F.concat_ws(",", quoted(F.col("artist")), quoted(F.col("album")), quoted(F.col("title")), text)
    return exports.scrobble_csv(spark, _lines(h, row, _folder(spark, "scrobbles"), "csv", blocks=BLOCKS))  # its dates count within files, so which rows share one is fixed


def dedup_json(spark, sf):
    """Stored decisions written as portable JSON and read back."""
    from tessitura.plans.catalogue import _stored

    path = _folder(spark, "groups")
    exports.write_dedup_groups(_stored(spark, sf), path)
    return exports.dedup_groups(spark, path).withColumn("group_id", F.col("group_id").cast("long"))


def detect_formats(spark, sf):
    """What is found at exports of six forms and at a folder of none."""
    t, h = V.track_v(spark, sf), _heard(spark, sf)
    root = _folder(spark, "all")
    ms = _lines(t, F.to_json(F.struct("id")), f"{root}/{D.SIGNATURES[0]}.json", "json", head="[", tail="]", between=",")
    hist = _lines(h, F.to_json(F.struct(F.coalesce("title", F.lit("")).alias(D.HISTORY_KEY))), f"{root}/history", "json", head="[", tail="]", between=",")
    jl = _lines(h, F.to_json(F.struct("id")), f"{root}/listens", "jsonl")
    audio = _lines(t, F.col("title"), f"{root}/audio", "MP3")
    other = _lines(t, F.col("title"), f"{root}/other", "txt")
    one = lambda folder: spark.read.format("binaryFile").load(folder).agg(F.min("path")).first()[0]
    csv, plist = one(_lines(h, F.lit("a,b,c,d"), f"{root}/csv", "csv")), one(_plist_tracks(spark, sf))
    places = {"media_services": ms.rsplit("/", 1)[0], "streaming_history": hist, "listens": jl, "audio": audio, "none": other, "scrobble_csv": csv, "plist": plist}
    # the folder above them all is ambiguous
    return spark.createDataFrame([(n, "|".join(D.detect(spark, p))) for n, p in places.items()], "place string, formats string")


# ---- sinks ---------------------------------------------------------------------------------------------------------


def get_or_create(spark, sf):
    """Of all source rows the tracks that aren't there yet."""
    there = V.track_v(spark, sf).withColumn("title", F.when(F.col("id") % 3 == 0, F.concat(F.col("title"), F.lit("!"))).otherwise(F.col("title")))
    return sinks.missing(there, V.source_track_v(spark, sf).select(*unify.KEY), list(unify.KEY)).select(*unify.KEY)


def fill_nulls(spark, sf):
    """Tracks' empty fields from the source rows of their id, two of each."""
    t = V.track_v(spark, sf).select("id", "artist", "year", "rating")
    s = V.source_track_v(spark, sf).select(F.col("source_id").alias("id"), F.concat(F.lit("by "), "provider").alias("artist"), (F.col("id") % 50 + 1950).cast("int").alias("year"), F.col("track_number").alias("rating"))
    return sinks.fill_nulls(t, s, ["id"], ["artist", "year", "rating"])


def _pairs(spark: SparkSession, sf: str, side: str, items: DataFrame | None = None) -> DataFrame:
    rows = (V.playlist_item_v(spark, sf) if items is None else items).where(F.col("side") == side)
    return rows.groupBy("playlist_id").agg(F.count("*").alias("n"), F.max("track_id").alias("last")).select("playlist_id", F.lit("server").alias("remote"), F.concat(F.lit(f"{side} "), F.col("n").cast("string")).alias("external_id"), "last")


def upsert_links(spark, sf):
    return sinks.upsert(_pairs(spark, sf, "base"), _pairs(spark, sf, "theirs"), ["playlist_id", "remote"])


def _ours(spark: SparkSession, sf: str, side: str = "ours", items: DataFrame | None = None) -> DataFrame:
    return (V.playlist_item_v(spark, sf) if items is None else items).where(F.col("side") == side).select("playlist_id", "track_id", F.col("pos").alias("position"))


def append_members(spark, sf):
    return sinks.appended(_ours(spark, sf), _ours(spark, sf, "theirs").withColumnRenamed("position", "ord"))


def overwrite_members(spark, sf):
    return sinks.replaced(_ours(spark, sf), _ours(spark, sf, "base"))


def rebuild_playlists(spark, sf):
    """All lists deleted and built anew from the base; the counts of both."""
    old, new = _ours(spark, sf), _ours(spark, sf, "base")
    lists = lambda x: x.select("playlist_id").distinct()
    state, deleted = sinks.rebuilt_playlists(lists(old), old, _pairs(spark, sf, "theirs"), lists(new), new)
    count = lambda n: state[n].agg(F.count("*").alias(n))
    return deleted.crossJoin(count("playlist")).crossJoin(count("item")).crossJoin(count("link"))  # four single rows


def committed_state(spark, sf):
    """Lists and links committed, rebuilt in a second run that is repeated, and what both versions hold."""
    items = written(V.playlist_item_v(spark, sf), "items")  # joined and placed once, for all sides
    folder, item, link = _folder(spark, "state"), _ours(spark, sf, "ours", items), _pairs(spark, sf, "theirs", items)
    commits.commit(spark, {"item": item, "link": link}, folder, "first", dry_run=False)
    now = commits.state(spark, folder)
    new = _ours(spark, sf, "base", items)
    lists = lambda x: x.select("playlist_id").distinct()
    plan, _ = sinks.rebuilt_playlists(lists(item), now.read(spark, "item"), now.read(spark, "link"), lists(new), new)
    for _ in range(2):
        commits.commit(spark, {"item": plan["item"]}, folder, "second", dry_run=False)
    out = None
    for v in (1, 2):
        one = commits.state(spark, folder, v)
        rows = one.read(spark, "item").select("playlist_id", F.lit("item").alias("kind")).union(one.read(spark, "link").select("playlist_id", F.lit("link")))
        rows = rows.groupBy("playlist_id", "kind").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "kind", "playlist_id", "n")
        out = rows if out is None else out.union(rows)
    return out


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return V.file_v(spark, sf).withColumn("library_path", F.when(F.col("first_order") % 3 != 0, F.concat(F.lit("Library/Music/"), F.col("id").cast("string"))))


def organize_pending(spark, sf):
    return sinks.pending_tracks(V.track_v(spark, sf), _placed(spark, sf)).select("id")


def _file_plan(spark, sf, **own):
    """Where every file goes; tracks are their own groups. ``own``: columns worked out for each track, which the plan keeps, with root_id."""
    files = V.file_v(spark, sf, by_track=True).withColumn("root_id", F.col("track_id"))
    tracks = V.track_v(spark, sf).withColumns({"compilation": F.col("id") % 13 == 0, **own})
    return sinks.file_plan(files, tracks, dedup.best_files(files), ("root_id", *own) if own else ())


def file_plan(spark, sf):
    return _file_plan(spark, sf)


def expected_files(spark, sf):
    """Source rows that should have a local file and have none of the best kind bound."""
    s = V.source_track_v(spark, sf)
    bound = V.file_v(spark, sf).where("ext = 'flac' AND bitrate = 320000").select((F.col("track_id") * 2).alias("source_id")).distinct()
    return unify.missing_files(s.withColumn("apple_music", F.when(F.col("id") % 8 == 0, True)), bound).select("id")


def replays(spark, sf):
    """Plays copied again: a scrobble that has a play keeps its id and is pointed to the track that it is linked with now."""
    from tessitura.plans.catalogue import _links

    fresh = history.fresh_scrobbles(V.scrobble_v(spark, sf))
    had = fresh.select((F.col("date").cast("long") % 100_000).alias("play_id"), F.col("date").alias("played_at"), F.lit(-1).cast("long").alias("track_id"), "platform").where("play_id % 7 <> 0")
    return history.copy_plays(fresh, _links(spark, sf), had)


def fresh_after_import(spark, sf):
    """Scrobbles whose dates aren't there yet."""
    s = V.scrobble_v(spark, sf)
    return history.fresh_scrobbles(s, s.where("platform = 'lastfm'").select("date"))


def new_aliases(spark, sf):
    """Aliases that an import creates: those that bring a date and aren't there yet."""
    s = V.scrobble_v(spark, sf)
    there = s.where("platform = 'spotify'").select("title", "artist", "album").distinct()
    return history.created_aliases(history.fresh_scrobbles(s), there)


def renormalized(spark, sf):
    """All comparison forms worked out anew over wrong ones, names outside ASCII included."""
    t = V.track_v(spark, sf)
    odd = F.element_at(F.array(*[F.lit(x) for x in ODD]), (F.col("id") % len(ODD) + 1).cast("int"))
    t = t.select("id", F.concat("title", odd).alias("title"), F.concat_ws(" ", odd, "artist").alias("artist"), F.lit("wrong").alias("title_norm"), F.lit("wrong").alias("artist_norm"))
    return X.renormalized(t).select("id", "title_norm", "artist_norm")


def masked_dsn(spark, sf):
    k = F.col("id").cast("string")
    dsn = F.when(F.col("id") % 2 == 0, F.concat(F.lit("postgresql+psycopg://user:p"), k, F.lit("@host:54/db"))).otherwise(F.concat(F.lit("sqlite:///"), k))
    return V.track_v(spark, sf).select("id", X.masked_dsn(dsn).alias("dsn"), X.full_name(F.col("artist"), F.col("album_artist"), F.col("title")).alias("full_name"))


# Endings of names, and what each leaves in the comparison form.
ODD = ("", " ﬁn", " Ａｂｃ", " Ёж É", " (переиздание)", "  x ™", " Ⅳ", " [2001]", " ½", " ſ")
SHOWN = {"ﬁ": "fi", "Ａｂｃ": "Abc", "Ⅳ": "IV", "½": "1⁄2", "ſ": "s", " ": " ", " ": " "}


def _nfkc(x: str) -> str:
    for a, b in SHOWN.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


HEARD = "heard AS (SELECT id, date, CASE WHEN id % 13 <> 0 THEN title END AS title, nullif(artist, '') AS artist, nullif(album, '') AS album, 20000 + (id % 5) * 5000 AS ms FROM scrobble_v)"
KNOWN = "track_id % 7 <> 0"


ODDS = "[" + ", ".join(f"'{x}'" for x in ODD) + "][id % " + str(len(ODD)) + " + 1]"
MEMBERS = "ok AS (SELECT * FROM item_v WHERE side = 'ours' AND playlist_id % 9 <> 0)"
STORED_ROWS = f"{DEDUP}, {STORED}"
SQL = {
    "plist_tracks": f"WITH {TRACK} SELECT 'apple_xml' AS provider, CAST(id AS VARCHAR) AS source_id, title, artist, album, album_artist, track_n AS track_number, disc_n AS disc_number, year, duration * 1000 AS duration_ms, loved, rating, date_added, CASE WHEN id % 4 = 0 THEN true END AS apple_music, hex(id) AS persistent_id FROM track_v",
    "plist_members": f"""WITH {ITEM}, {MEMBERS}, m AS (SELECT *, row_number() OVER (PARTITION BY playlist_id, track_id ORDER BY pos) = 1 AS first FROM ok), n AS (SELECT *, sum(CASE WHEN first OR NOT ({KNOWN}) THEN 1 ELSE 0 END) OVER (PARTITION BY playlist_id ORDER BY pos) AS p FROM m)
      SELECT playlist_id, track_id, CAST(p AS INT) AS position FROM n WHERE first AND {KNOWN}""",
    "media_services_tracks": f"WITH {TRACK} SELECT 'apple_ms' AS provider, CAST(id AS VARCHAR) AS source_id, title, artist, album, track_n AS track_number, year, duration * 1000 AS duration_ms, id % 3 = 0 AND id % 2 = 0 AS compilation, date_added, rating AS like_rating FROM track_v",
    "archive_tracks": f"WITH {TRACK} SELECT 'apple_ms' AS provider, CAST(id AS VARCHAR) AS source_id, title, artist, album, duration * 1000 AS duration_ms, id % 3 = 0 AND id % 2 = 0 AS compilation FROM track_v",
    "media_services_members": f"WITH {ITEM}, {MEMBERS} SELECT playlist_id, track_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY min(pos)) AS INT) AS position FROM ok WHERE {KNOWN} GROUP BY 1, 2",
    "play_activity": f"WITH {TRACK}, {SCROBBLE}, {HEARD} SELECT 'apple_ms' AS platform, title, NULL::VARCHAR AS artist, album, date FROM heard WHERE id % 4 <> 0 AND ms >= 30000 AND title IS NOT NULL",
    "streaming_history": f"WITH {TRACK}, {SCROBBLE}, {HEARD} SELECT 'spotify' AS platform, title, artist, album, date FROM heard WHERE ms >= 30000 AND title IS NOT NULL AND artist IS NOT NULL AND album IS NOT NULL",
    "history_quarantine": f"WITH {TRACK}, {SCROBBLE}, {HEARD} SELECT 'spotify' AS platform, title, artist, album, date FROM heard WHERE ms >= 30000 AND title IS NOT NULL AND (artist IS NULL OR album IS NULL)",
    "listens": f"WITH {TRACK}, {SCROBBLE}, {HEARD} SELECT 'listenbrainz' AS platform, title, artist, album, date FROM heard",
    "scrobble_csv": f"""WITH {TRACK}, {SCROBBLE}, {HEARD}, r AS (SELECT *, row_number() OVER (PARTITION BY id % {BLOCKS}, id % 6 = 0 ORDER BY id) - 1 AS k FROM heard WHERE title IS NOT NULL)
      SELECT 'lastfm' AS platform, title, coalesce(artist, '') AS artist, coalesce(album, '') AS album, CASE WHEN id % 6 = 0 THEN TIMESTAMP '2010-01-01' + k * INTERVAL 5 MINUTE ELSE date END AS date FROM r""",
    "dedup_json": f"{STORED_ROWS} SELECT group_id, member_hash, canon_hash FROM stored",
    "detect_formats": "SELECT * FROM (VALUES ('media_services', 'media_services|listens|audio'), ('streaming_history', 'streaming_history'), ('listens', 'listens'), ('audio', 'audio'), ('none', ''), ('scrobble_csv', 'scrobble_csv'), ('plist', 'plist')) AS v(place, formats)",
    "get_or_create": f"WITH {TRACK}, {SOURCE}, there AS (SELECT CASE WHEN id % 3 = 0 THEN title || '!' ELSE title END AS title, artist, album, album_artist FROM track_v) SELECT DISTINCT title, artist, album, album_artist FROM source_v s WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.title = s.title AND t.artist IS NOT DISTINCT FROM s.artist AND t.album IS NOT DISTINCT FROM s.album AND t.album_artist IS NOT DISTINCT FROM s.album_artist)",
    "fill_nulls": f"""WITH {TRACK}, {SOURCE}, s AS (SELECT source_id AS id, min('by ' || provider) AS artist, CAST(min(id % 50 + 1950) AS INT) AS year, min(track_number) AS rating FROM source_v GROUP BY 1)
      SELECT t.id, coalesce(t.artist, s.artist) AS artist, coalesce(t.year, s.year) AS year, coalesce(t.rating, s.rating) AS rating FROM track_v t LEFT JOIN s USING (id)""",
    "upsert_links": f"""WITH {ITEM}, p AS (SELECT playlist_id, side, 'server' AS remote, side || ' ' || count(*) AS external_id, max(track_id) AS last FROM item_v WHERE side <> 'ours' GROUP BY 1, 2)
      SELECT playlist_id, remote, external_id, last FROM p QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY side DESC) = 1""",
    "append_members": f"WITH {ITEM}, l AS (SELECT playlist_id, max(pos) AS n FROM item_v WHERE side = 'ours' GROUP BY 1) SELECT playlist_id, track_id, coalesce(n, 0) + row_number() OVER (PARTITION BY playlist_id ORDER BY pos) AS position FROM item_v LEFT JOIN l USING (playlist_id) WHERE side = 'theirs'",
    "overwrite_members": f"WITH {ITEM}, b AS (SELECT DISTINCT playlist_id FROM item_v WHERE side = 'base') SELECT playlist_id, track_id, pos AS position FROM item_v WHERE CASE WHEN playlist_id IN (FROM b) THEN side = 'base' ELSE side = 'ours' END",
    "rebuild_playlists": f"WITH {ITEM} SELECT count(DISTINCT playlist_id) FILTER (side = 'ours') AS n_deleted, count(DISTINCT playlist_id) FILTER (side = 'base') AS playlist, count(*) FILTER (side = 'base') AS item, 0::BIGINT AS link FROM item_v",
    "committed_state": f"""WITH {ITEM}, v AS (SELECT unnest([1, 2]) AS version) SELECT version, 'item' AS kind, playlist_id, count(*) AS n FROM item_v, v WHERE side = CASE version WHEN 1 THEN 'ours' ELSE 'base' END GROUP BY ALL
      UNION ALL SELECT version, 'link', playlist_id, 1 FROM (SELECT DISTINCT playlist_id FROM item_v WHERE side = 'theirs'), v""",
    "organize_pending": f"WITH {TRACK}, {FILE} SELECT DISTINCT track_id AS id FROM file_v WHERE first_order % 3 = 0 AND track_id IN (SELECT id FROM track_v)",
    "file_plan": f"""WITH {TRACK}, {FILE}, f AS (SELECT file_v.id AS file_id, ext, track_id, row_number() OVER (PARTITION BY track_id ORDER BY bitrate // 1000 DESC, CASE ext WHEN 'flac' THEN 3 WHEN 'm4a' THEN 2 WHEN 'mp3' THEN 1 ELSE 0 END DESC, file_v.id) = 1 AS main FROM file_v),
      n AS (SELECT *, row_number() OVER (PARTITION BY track_id, main ORDER BY file_id) - 1 AS k FROM f), j AS (SELECT file_id, main, title, album, artist, album_artist, t.id % 13 = 0 AS compilation, track_n AS track_number, disc_n AS d, CASE WHEN NOT main AND k > 0 THEN ' ' || k ELSE '' END || '.' || ext AS tail FROM n JOIN track_v t ON t.id = track_id)
      SELECT file_id, CASE WHEN main THEN 'main' ELSE 'copy' END AS role, CASE WHEN main THEN 'Library/Music/' ELSE 'Copies/Music/' END || {part(ARTIST, '35')} || '/' || {part("coalesce(nullif(album, ''), 'Unknown Album')", '35')} || '/' || {part(NAME, '35 - length(tail)', True)} || tail AS target FROM j""",
    "expected_files": f"WITH {TRACK}, {SOURCE}, {FILE} SELECT id FROM source_v WHERE provider = 'apple_xml' AND id % 8 <> 0 AND id NOT IN (SELECT track_id * 2 FROM file_v WHERE ext = 'flac' AND bitrate = 320000)",
    "replays": f"""WITH {TRACK}, {SCROBBLE}, {FRESH}, m AS (SELECT title, min(id) AS id FROM track_v GROUP BY 1) SELECT CASE WHEN epoch(date)::BIGINT % 100000 % 7 <> 0 THEN epoch(date)::BIGINT % 100000 END AS play_id, date AS played_at, m.id AS track_id, platform FROM fresh JOIN m USING (title) WHERE m.id % 4 <> 0
      UNION ALL SELECT epoch(date)::BIGINT % 100000, date, -1, platform FROM fresh JOIN m USING (title) WHERE m.id % 4 = 0 AND epoch(date)::BIGINT % 100000 % 7 <> 0""",
    "fresh_after_import": f"WITH {TRACK}, {SCROBBLE}, {FRESH} SELECT * FROM fresh WHERE date NOT IN (SELECT date FROM scrobble_v WHERE platform = 'lastfm')",
    "new_aliases": f"WITH {TRACK}, {SCROBBLE}, {FRESH} SELECT DISTINCT title, artist, album FROM fresh EXCEPT SELECT title, artist, album FROM scrobble_v WHERE platform = 'spotify'",
    "renormalized": f"WITH {TRACK}, o AS (SELECT id, title || {ODDS} AS title, {ODDS} || coalesce(' ' || artist, '') AS artist FROM track_v) SELECT id, {norm('title', _nfkc)} AS title_norm, {norm('artist', _nfkc)} AS artist_norm FROM o",
    "masked_dsn": f"WITH {TRACK} SELECT id, CASE WHEN id % 2 = 0 THEN 'postgresql+psycopg://host:54/db' ELSE 'sqlite:///' || id END AS dsn, coalesce(artist, '') || ' [' || coalesce(album_artist, '') || '] ' || title AS full_name FROM track_v",
}

QUERIES = (
    plist_tracks, plist_members, media_services_tracks, archive_tracks, media_services_members, play_activity, streaming_history, history_quarantine, listens, scrobble_csv, dedup_json, detect_formats, get_or_create, fill_nulls, upsert_links, append_members, overwrite_members,
    rebuild_playlists, committed_state, organize_pending, file_plan, expected_files, replays, fresh_after_import, new_aliases, renormalized, masked_dsn,
)
