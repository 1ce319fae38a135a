"""Readers of music-library exports.

Archives, JSON and CSV files come as streams of records through a data source with a partition for each file or member (``records``), property lists in pieces through
Spark's text reader; no reader holds a file. Rows that don't fit are kept apart (``quarantine``), never raised.
"""

from __future__ import annotations

import base64
import csv
import io
import itertools
import json
import plistlib
import re
from datetime import date, datetime
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessitura.sources.records import CHUNK, json_items, lines, records

LEAST_MS = 30_000
SPLIT = "source_id string, known string, rest string"
# Names of fields in the exports, and list types that aren't playlists.
PLIST_FIELDS = {
    "Name": "title", "Artist": "artist", "Album": "album", "Album Artist": "album_artist", "Track Number": "track_number", "Disc Number": "disc_number", "Year": "year", "Total Time": "duration_ms",
    "Compilation": "compilation", "Loved": "loved", "Rating": "rating", "Rating Computed": "rating_computed", "Album Loved": "album_loved", "Album Rating": "album_rating",
    "Album Rating Computed": "album_rating_computed", "Date Added": "date_added", "Date Modified": "date_modified",
}
MS_FIELDS = {
    "Title": "title", "Artist": "artist", "Album": "album", "Album Artist": "album_artist", "Track Number On Album": "track_number", "Disc Number Of Album": "disc_number", "Track Year": "year",
    "Track Duration": "duration_ms", "Is Part of Compilation": "compilation", "Date Added To Library": "date_added", "Last Modified Date": "date_modified",
}
SKIPPED_LISTS = ("Smart Playlist", "Genius Mix", "Genius Playlist", "Folder")
TRACKS_ENTRY, PLAYLISTS_ENTRY, ACTIVITY_ENTRY = "Apple Music Library Tracks", "Apple Music Library Playlists", "Apple Music Play Activity"
KINDS = {"track_number": "int", "disc_number": "int", "year": "int", "duration_ms": "int", "rating": "int", "album_rating": "int", "compilation": "boolean", "loved": "boolean", "rating_computed": "boolean", "album_loved": "boolean", "album_rating_computed": "boolean", "date_added": "timestamp", "date_modified": "timestamp"}
COLUMNS = ("title", "artist", "album", "album_artist", "track_number", "disc_number", "year", "duration_ms", "compilation", "loved", "rating", "rating_computed", "album_loved", "album_rating", "album_rating_computed", "date_added", "date_modified")


def _safe(v):
    return v.isoformat() if isinstance(v, (datetime, date)) else v.hex() if isinstance(v, bytes) else v


def _snake(name: str) -> str:
    return name.lower().replace(" ", "_")


def _split(record: dict, fields: dict[str, str]) -> tuple[str, str]:
    """Structured fields and the rest, both as JSON; times as ISO text, bytes as hex."""
    known = {fields[k]: _safe(v) for k, v in record.items() if k in fields}
    rest = {_snake(k): _safe(v) for k, v in record.items() if k not in fields}
    return json.dumps(known), json.dumps(rest, default=str)


def _source_tracks(rows: DataFrame, provider: str) -> DataFrame:
    known = F.from_json("known", ", ".join(f"{c} {'string' if KINDS.get(c) == 'timestamp' else KINDS.get(c, 'string')}" for c in COLUMNS))
    out = rows.withColumn("k", known)
    cast = [F.to_timestamp(f"k.{c}").alias(c) if KINDS.get(c) == "timestamp" else F.col(f"k.{c}").alias(c) for c in COLUMNS]
    return out.select(F.lit(provider).alias("provider"), "source_id", *cast, F.parse_json("rest").alias("extra"))


def unseen(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows whose (provider, source_id) isn't known yet, one for each."""
    rows = rows.dropDuplicates(["provider", "source_id"])
    return rows if known is None else rows.join(known.select("provider", "source_id"), ["provider", "source_id"], "left_anti")


PIECE = b"<dict>"  # where files of a property list are cut
HELD = 4096  # bytes of a file that a row holds, or one piece: Python gets rows by number, so what it holds at once follows from this, not from the file


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, at, piece): files in pieces of some HELD bytes, so that none is ever held whole; those of a file lie in one partition, in order, and give it again with PIECE between them."""
    rows = spark.read.option("recursiveFileLookup", "true").option("lineSep", PIECE.decode()).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("piece"))

    def joined(batches):
        for b in batches:
            cut = b["piece"].map(len).groupby([b["path"], b["start"]], sort=False).cumsum() // HELD
            yield b.groupby(["path", "start", cut.rename("cut")], sort=False).agg(at=("at", "first"), piece=("piece", PIECE.join)).reset_index()[list(b.columns)]

    return rows.mapInPandas(joined, rows.schema).repartition("path").sortWithinPartitions("path", "start", "at")


class Entries:
    """The entries of one part of a property list that is fed piece by piece, taken as they end: (key, value), without keys in an array."""

    def __init__(self, part: str = "Playlists", kind: str = "array", short=None) -> None:
        self.part, self.kind, self.short = part, kind, short  # short: how an inner entry of a list is kept
        self.done: list[tuple[str | None, object]] = []
        self.open, self.key, self.text, self.depth = [], None, [], 0  # open: [container, key] from the part on
        self.xml, self.held = None, b""

    def feed(self, data: bytes, last: bool = False) -> list[tuple[str | None, object]]:
        """The entries that ended since the last call."""
        if self.xml is None:
            self.held += data
            if not last and (len(self.held) < 8 or self.held.startswith(b"bplist00")):
                return []  # a binary property list has its index at the end
            if self.held.startswith(b"bplist00"):
                found = plistlib.loads(self.held).get(self.part, [])
                return list(found.items()) if isinstance(found, dict) else [(None, self._shortened(p)) for p in found]
            self.xml = expat.ParserCreate()
            self.xml.buffer_text = True
            self.xml.StartElementHandler, self.xml.EndElementHandler, self.xml.CharacterDataHandler, self.xml.EntityDeclHandler = self._start, self._end, self.text.append, self._entity
            data, self.held = self.held, b""
        self.xml.Parse(data, last)
        out, self.done[:] = self.done[:], []
        return out

    def _shortened(self, entry):
        return {k: [self.short[1](x) for x in v] if self.short and k == self.short[0] else v for k, v in entry.items()}

    def _entity(self, *_) -> None:
        raise plistlib.InvalidFileException("XML entity declarations are not supported in plist files")

    def _start(self, tag: str, _) -> None:
        self.depth += 1
        self.text.clear()
        if self.open:
            if tag in ("dict", "array"):
                self.open.append([{} if tag == "dict" else [], None])
        elif tag == self.kind and self.depth == 3 and self.key == self.part:
            self.open.append([None, None])

    def _end(self, tag: str) -> None:
        self.depth -= 1
        if not self.open:
            if tag == "key" and self.depth == 2:
                self.key = "".join(self.text)
            return
        if tag == "key":
            self.open[-1][1] = "".join(self.text)
            return
        value = self.open.pop()[0] if tag in ("dict", "array") else self._leaf(tag, "".join(self.text))
        if not self.open:
            return
        into, key = self.open[-1]
        if len(self.open) == 1:
            self.done.append((key, value))
        elif isinstance(into, dict):
            into[key] = value
        elif self.short and len(self.open) == 3 and self.open[1][1] == self.short[0]:
            into.append(self.short[1](value))
        else:
            into.append(value)

    @staticmethod
    def _leaf(tag: str, text: str):
        if tag in ("true", "false"):
            return tag == "true"
        if tag == "integer":
            return int(text, 16 if text.lower().startswith(("0x", "-0x")) else 10)
        if tag == "real":
            return float(text)
        if tag == "date":
            return datetime.fromisoformat(text.strip().removesuffix("Z"))
        return base64.b64decode(text) if tag == "data" else text


def _track_id(item: dict) -> str | None:
    return str(item["Track ID"]) if item else None


def _plist(spark: SparkSession, path: str, make, rows, schema: str) -> DataFrame:
    """Rows of the entries that ``make()`` takes from each property list below a path, parsed as it is read."""
    names = StructType.fromDDL(schema).names

    def ended(batches):
        """The entries of one file after another."""
        file, parser = None, None
        for b in batches:
            for where, piece in zip(b["path"], b["piece"], strict=True):
                if where != file:
                    yield from parser.feed(b"", True) if parser else []
                    file, parser = where, make()
                    yield from parser.feed(piece)
                else:
                    yield from parser.feed(PIECE + piece)
        yield from parser.feed(b"", True) if parser else []

    def run(batches):
        found = rows(ended(batches))
        while some := list(itertools.islice(found, 50_000)):
            yield pd.DataFrame(some, columns=names)

    return _pieces(spark, path).mapInPandas(run, schema)


def plist_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a property-list library; a task holds one track at a time, not the library."""

    def rows(entries):
        for key, t in entries:
            yield (str(t.get("Track ID", key)), *_split(t, PLIST_FIELDS))

    return _source_tracks(_plist(spark, path, lambda: Entries("Tracks", "dict"), rows, SPLIT), "apple_xml")


def plist_playlists(spark: SparkSession, path: str) -> DataFrame:
    """(list_id, name, description, folder, pos, source_id) of plain playlists; smart lists and the library's own containers are left out.

    Repeats of a track that is known don't count; one that isn't known takes its position again with every repeat, so ``pos`` can have gaps after
    the join with tracks: pass ``known`` ids to ``plist_members``. Files are parsed as they are read: a task holds one playlist's ids, not the library.
    """

    def rows(entries):
        for _, p in entries:
            if p.get("Smart Info") or p.get("Master") or p.get("Music"):
                continue
            same = (p.get("Playlist Persistent ID"), p.get("Name"), p.get("Description") or None, bool(p.get("Folder", False)))
            for i, track in enumerate(p.get("Playlist Items") or [None]):
                yield (*same, i, track)

    return _plist(spark, path, lambda: Entries(short=("Playlist Items", _track_id)), rows, "list_id string, name string, description string, folder boolean, at int, source_id string")


def plist_members(lists: DataFrame, tracks: DataFrame) -> DataFrame:
    """Members with positions: each known track once; every entry but the repeats of known tracks advances the position."""
    known = tracks.select("source_id").distinct().withColumn("known", F.lit(True))
    rows = lists.where("source_id is not null").join(known, "source_id", "left").select("list_id", "source_id", "at", "known").repartition("list_id")  # one exchange for both windows
    first = F.row_number().over(W.partitionBy("list_id", "source_id").orderBy("at")) == 1
    counted = rows.withColumn("counts", F.when(first | F.col("known").isNull(), 1).otherwise(0)).withColumn("first", first)
    placed = counted.withColumn("position", F.sum("counts").over(W.partitionBy("list_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    return placed.where("first and known").select("list_id", "source_id", F.col("position").cast("int").alias("position"))


def _media_tracks(stream):
    for _, t in json_items(stream):
        yield (str(t["Track Identifier"]), *_split({"Is Part of Compilation": False, **t}, MS_FIELDS))


def _media_playlists(stream):
    for _, p in json_items(stream):
        for i, item in enumerate(dict.fromkeys(map(str, p.get("Playlist Item Identifiers") or []))):
            yield str(p["Container Identifier"]), p.get("Title", ""), p.get("Container Type", ""), item, i


def media_services_tracks(spark: SparkSession, path: str) -> DataFrame:
    return _source_tracks(records(spark, path, _media_tracks, re.escape(TRACKS_ENTRY), SPLIT), "apple_ms")


def media_services_playlists(spark: SparkSession, path: str, skipped: tuple[str, ...] = SKIPPED_LISTS) -> DataFrame:
    """(list_id, name, source_id, at): each list's items once, in order of first occurrence; empty lists and container types are left out."""
    rows = records(spark, path, _media_playlists, re.escape(PLAYLISTS_ENTRY), "list_id string, name string, kind string, source_id string, at int")
    return rows.where(~F.col("kind").isin(*skipped)).drop("kind")


def media_services_members(lists: DataFrame, tracks: DataFrame) -> DataFrame:
    """Known members, positions from 1 without gaps."""
    met = lists.join(tracks.select("source_id").distinct(), "source_id")
    return met.select("list_id", "source_id", F.row_number().over(W.partitionBy("list_id").orderBy("at")).alias("position"))


ACTIVITY = {"Event Type": "kind", "Album Name": "album", "Song Name": "title", "Play Duration Milliseconds": "ms", "Event Timestamp": "ts", "Event End Timestamp": "end_ts"}


def _text(stream) -> io.TextIOWrapper:
    """A binary stream as text, quoted line ends kept as they are."""
    return io.TextIOWrapper(io.BufferedReader(stream, CHUNK) if isinstance(stream, io.RawIOBase) else stream, encoding="utf-8-sig", newline="")


def _activity(stream):
    for row in csv.DictReader(_text(stream)):
        yield tuple(row.get(k) or None for k in ACTIVITY)


def play_activity(spark: SparkSession, path: str) -> DataFrame:
    """Ended plays of 30 s or more with a song name; this feed names no artist."""
    rows = records(spark, path, _activity, re.escape(ACTIVITY_ENTRY), ", ".join(f"{n} string" for n in ACTIVITY.values()))
    return rows.where((F.col("kind") == "PLAY_END") & (F.col("ms").try_cast("long") >= LEAST_MS) & F.col("title").isNotNull()).select(F.lit("apple_ms").alias("platform"), "title", F.lit(None).cast("string").alias("artist"), "album", F.try_to_timestamp(F.coalesce("ts", "end_ts")).alias("date"))


def _json_records(stream):
    for _, x in json_items(stream):
        yield (json.dumps(x),)


def _json_lines(stream):
    yield from ((x,) for x in lines(stream) if x.strip())


def streaming_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Plays of 30 s or more, and the rows set apart because artist or album is missing."""
    schema = "ts string, ms_played long, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string"
    rows = records(spark, path, _json_records, r"\.json", "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    rows = rows.select(F.lit("spotify").alias("platform"), F.col("master_metadata_track_name").alias("title"), F.col("master_metadata_album_artist_name").alias("artist"), F.col("master_metadata_album_album_name").alias("album"), F.try_to_timestamp(F.col("ts")).alias("date"), "ms_played")
    whole = F.col("artist").isNotNull() & F.col("album").isNotNull()
    taken = rows.where((F.col("ms_played") >= LEAST_MS) & F.col("title").isNotNull())
    return taken.where(whole).drop("ms_played"), taken.where(~whole).drop("ms_played")


def listens(spark: SparkSession, path: str) -> DataFrame:
    """Listens in JSON lines, from a folder or from ``listens/`` in an archive; epoch seconds or ISO times."""
    schema = "listened_at string, track_metadata struct<track_name:string, artist_name:string, release_name:string>"
    if path.endswith(".zip"):
        rows = records(spark, path, _json_lines, r"^listens/.*\.jsonl$", "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    else:
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    when = F.coalesce(F.timestamp_seconds(F.col("listened_at").try_cast("long")), F.try_to_timestamp(F.col("listened_at")))
    return rows.select(F.lit("listenbrainz").alias("platform"), F.col("track_metadata.track_name").alias("title"), F.col("track_metadata.artist_name").alias("artist"), F.col("track_metadata.release_name").alias("album"), when.alias("date"))


def _scrobbles(stream):
    bad = 0
    for r in csv.reader(_text(stream)):
        if len(r) < 4 or not r[2]:
            continue
        try:
            when = datetime.strptime(r[3], "%d %b %Y %H:%M")
        except ValueError:
            when = None
        if when and when.date() == date(1970, 1, 1):
            when = datetime(2010, 1, 1) + bad * (datetime(2010, 1, 1, 0, 5) - datetime(2010, 1, 1))
            bad += 1
        yield r[0], r[1], r[2], when.isoformat() if when else None


def scrobble_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless artist, album, title, 'd MMM yyyy HH:mm'; rows without a title go first, then dates on 1970-01-01 become 2010-01-01 plus
    five minutes for each such row before, in file order."""
    rows = records(spark, path, _scrobbles, "", "artist string, album string, title string, date string")
    return rows.select(F.lit("lastfm").alias("platform"), "title", "artist", "album", F.to_timestamp("date").alias("date"))


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, ext, size, modified, and tags where a tag library is installed) of mp3, m4a and flac files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{mp3,m4a,flac}").load(path)
    base = [F.col("path").alias("source_path"), F.regexp_extract("path", r"\.([^.]+)$", 1).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    try:
        import mutagen  # noqa: F401
    except ImportError:
        return rows.select(*base)
    keys = {"artist": ("TPE1", "©ART"), "album": ("TALB", "©alb"), "album_artist": ("TPE2", "aART"), "title": ("TIT2", "©nam"), "date": ("TDRC", "TDOR", "©day")}

    def tag(batches):
        for b in batches:
            for content, *rest in zip(b["content"], b["source_path"], b["ext"], b["size"], b["modified"], strict=True):
                audio = mutagen.File(io.BytesIO(bytes(content)))
                tags = (audio and audio.tags) or {}
                found = {n: next(("; ".join(map(str, tags[k])) if isinstance(tags[k], list) else str(tags[k]) for k in ks if k in tags), None) for n, ks in keys.items()}
                yield pd.DataFrame([dict(zip(("source_path", "ext", "size", "modified"), rest, strict=True), **found, duration=audio and audio.info.length, bitrate=audio and getattr(audio.info, "bitrate", 0))])

    schema = "source_path string, ext string, size long, modified timestamp, artist string, album string, album_artist string, title string, date string, duration double, bitrate int"
    return rows.select("content", *base).mapInPandas(tag, schema)


def server_table(spark: SparkSession, url: str, name: str, driver: str = "org.sqlite.JDBC") -> DataFrame:
    """A table of the music server's database; needs the JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, driver=driver).load()


def _groups(stream):
    for label, g in json_items(stream):
        yield from ((label, m, c) for m, c in zip(g["members"], g["canon_hashes"], strict=True))


def dedup_groups(spark: SparkSession, path: str) -> DataFrame:
    """Stored decisions, JSON {label: {members: [...], canon_hashes: [...]}} with one canon hash or null beside each member: (group_id, member_hash, canon_hash)."""
    return records(spark, path, _groups, "", "group_id string, member_hash string, canon_hash string")


def write_dedup_groups(members: DataFrame, path: str) -> None:
    """The form that ``dedup_groups`` reads: one object over all labels, members sorted, in files that Spark writes.

    Each part is an object of its own, so a reader takes them together; equal labels can't occur, as the label is the group's id.
    """
    each = members.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("member_hash", "canon_hash"))).alias("m"))
    entry = F.struct(F.col("m.member_hash").alias("members"), F.col("m.canon_hash").alias("canon_hashes"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'^\{"x":|\}$', "")
    pairs = each.select("group_id", F.concat(quoted(F.col("group_id").cast("string")), F.lit(":"), F.to_json(entry, {"ignoreNullFields": "false"})).alias("pair"))
    block = F.pmod(F.xxhash64("group_id"), F.lit(64))  # files of bounded share, each a whole object
    whole = pairs.groupBy(block.alias("b")).agg(F.array_sort(F.collect_list(F.struct("group_id", "pair"))).alias("p"))
    whole.select(F.concat(F.lit("{"), F.array_join("p.pair", ","), F.lit("}")).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def imported_groups(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored groups after an import, and one row (created, updated). A group is the multiset of its member hashes: an incoming
    one replaces the stored one that has the same, whatever its label; the last of several incoming ones with the same members counts."""
    of = lambda rows: rows.groupBy("group_id").agg(F.array_sort(F.collect_list("member_hash")).alias("hashes"))
    new = of(incoming).groupBy("hashes").agg(F.max("group_id").alias("group_id"), F.count("*").alias("n"))
    old = of(existing).select("hashes", F.col("group_id").alias("_old"))
    met = new.join(old, "hashes", "left")
    kept = existing.join(met.where("_old is not null").select(F.col("_old").alias("group_id")), "group_id", "left_anti")
    taken = incoming.join(new.select("group_id"), "group_id", "left_semi")
    counts = met.agg(F.count_if(F.col("_old").isNull()).alias("created"), F.coalesce(F.sum(F.col("n") - F.when(F.col("_old").isNull(), 1).otherwise(0)), F.lit(0)).cast("long").alias("updated"))
    return kept.unionByName(taken.select(*existing.columns)), counts
