"""Canonical tracks from source rows and files, file binding by path, and playlists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.text import file_name, half_even_seconds, path_album, path_artist, path_part, tag_year
from tessitura.operators.ranked import numbered
from tessitura.plans.scratch import written

KEY = ("title", "artist", "album", "album_artist")
SUFFIXES, LIMITS, EXTENSIONS = (0, 1, 2), (40, 35), ("mp3", "m4a")


def unify_tracks(source: DataFrame, run_ts) -> DataFrame:
    """One row for each (title, artist, album, album_artist), nulls equal: first non-null value of each field by source id.

    ``date_added`` is the first row's own, or else ``run_ts``: later rows never fill it.
    """
    fields = {
        "track_n": F.col("track_number"), "disc_n": F.col("disc_number"), "compilation": F.col("compilation"), "year": F.col("year"),
        "duration": half_even_seconds(F.col("duration_ms")), "loved": F.when(F.col("loved"), True), "rating": F.when(~F.col("rating_computed"), F.col("rating")),
    }
    if "album_rating" in source.columns:
        fields |= {"album_loved": F.when(F.col("album_loved"), True), "album_rating": F.when(~F.col("album_rating_computed"), F.col("album_rating"))}
    first = [F.min_by(c, F.when(c.isNotNull(), F.col("id"))).alias(n) for n, c in fields.items()]
    added = F.coalesce(F.min_by(F.struct("date_added"), "id")["date_added"], run_ts).alias("date_added")
    return source.groupBy(*KEY).agg(F.min("id").alias("first_source"), F.count("*").alias("n_sources"), *first, added)


def expects_local_file(provider, extra_apple_music):
    return (provider == "apple_xml") & ~F.coalesce(extra_apple_music, F.lit(False))


def missing_files(source: DataFrame, bound: DataFrame) -> DataFrame:
    """Source rows that should have a local file and have none. ``source``: id, provider, apple_music. ``bound``: source_id of rows with a file."""
    wanted = source.where(expects_local_file(F.col("provider"), F.col("apple_music")))
    return wanted.join(bound.select(F.col("source_id").alias("id")), "id", "left_anti")


def _parts(source: DataFrame) -> DataFrame:
    """What a track's paths depend on: (id, title, track_number, discs, pa, pl)."""
    discs = F.array_compact(F.array(F.struct(F.lit(None).cast("int").alias("d")), F.when(F.col("disc_number").isNotNull(), F.struct(F.col("disc_number").cast("int").alias("d")))))
    return source.select("id", "title", "track_number", discs.alias("discs"), path_artist(F.col("compilation"), F.col("album_artist"), F.col("artist")).alias("pa"), path_album(F.col("album")).alias("pl"))


def _placed(named: DataFrame) -> DataFrame:
    """(id, folder, name) of every option, some more than once.

    The parts of a path are worked out step by step, in projections that the generated code can hold: folders once for each track and limit, names
    for each option.
    """
    options = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s in SUFFIXES for e in EXTENSIONS])
    limited = named.withColumn("n", F.explode(F.array(*[F.lit(n) for n in LIMITS])))
    folders = limited.select("id", "title", "track_number", "discs", "n", F.concat_ws("/", path_part(F.col("pa"), F.col("n")), path_part(F.col("pl"), F.col("n"))).alias("folder"))
    rows = folders.select("id", "title", "track_number", "n", "folder", F.explode("discs").alias("disc")).withColumn("o", F.explode(options))
    name = file_name(F.col("title"), F.col("o.e"), F.col("track_number"), F.col("disc.d"), F.col("o.s"), F.col("n"))
    return rows.select("id", "folder", name.alias("name"))


def candidate_paths(source: DataFrame) -> DataFrame:
    """(id, path): all places where a source track's file may lie, distinct. Tracks move, not their paths."""
    return _placed(_parts(source).repartition("id")).distinct().select("id", F.concat_ws("/", "folder", "name").alias("path"))


def ends(part: Column) -> Column:
    """What stands up to and including each file extension in a part of a path."""
    pieces = F.split(part, "(?<=" + "|".join(rf"\.{e}" for e in EXTENSIONS) + ")")
    upto = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), ""))
    ending = lambda x: F.greatest(*[x.endswith(f".{e}") for e in EXTENSIONS])
    return F.array_distinct(F.filter(upto, ending))  # nothing stands behind the last one


def bind_files(source: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, source_id): each file with the smallest source track one of whose paths its own contains, letter case aside.

    A path that another contains has its album folder as a whole folder there, and its file name, which ends with an extension, begins the next part.
    So both sides meet by folder and by what stands up to an extension, by 128 bits of the two; then the part before the folder has to end with the path's
    artist. Of the tracks that have the same paths only the smallest is placed, and neither paths nor names move. Many options come of each track, which Spark's
    estimate from the tables' files doesn't see, so the join is told to be a merge: else one side may go through the driver as a broadcast.
    """
    same = ["title", "track_number", "discs", "pa", "pl"]
    keys = lambda folder, name: [F.xxhash64(folder, name).alias("k1"), F.xxhash64(F.lit(1), folder, name).alias("k2")]
    low = F.split("low", "/")
    c = _placed(_parts(source).groupBy(*same).agg(F.min("id").alias("id"))).select("id", F.lower(F.concat_ws("/", "folder", "name")).alias("low"))
    c = c.select(*keys(F.get(low, F.lit(1)), F.get(low, F.lit(2))), F.get(low, F.lit(0)).alias("artist"), "id").repartition("k1", "k2").groupBy("k1", "k2", "artist").agg(F.min("id").alias("id"))
    f = files.where(F.col("track_id").isNull()) if "track_id" in files.columns else files
    own = F.split(F.lower("source_path"), "/")
    pairs = F.transform(F.slice(own, F.lit(2), F.size(own)), lambda x, i: F.struct(F.get(own, i).alias("before"), x.alias("folder"), F.get(own, i + 2).alias("next")))
    f = f.select(F.col("id").alias("file_id"), F.explode(pairs).alias("p")).where(F.greatest(*[F.col("p.next").contains(f".{e}") for e in EXTENSIONS]))
    f = f.select("file_id", "p.before", "p.folder", F.explode(ends(F.col("p.next"))).alias("name")).select("file_id", "before", *keys(F.col("folder"), F.col("name")))
    met = written(f.join(c.hint("merge"), ["k1", "k2"]).where(F.col("before").endswith(F.col("artist"))).select("file_id", "id"), "bound")  # the join's shuffle files go
    return met.groupBy("file_id").agg(F.min("id").alias("source_id"))


def orphan_files(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Unlinked files with the track of the same tags, nulls equal; ``year`` from the date tag."""
    t = tracks.select(*[F.col(k).alias(f"t_{k}") for k in KEY], F.col("id").alias("found_track"))
    cond = None
    for k in KEY:
        same = F.col(k).eqNullSafe(F.col(f"t_{k}"))
        cond = same if cond is None else cond & same
    f = files.where("track_id is null and title is not null")
    return f.join(t, cond, "left").groupBy("id", *KEY, "date").agg(F.min("found_track").alias("found_track")).select("id", "found_track", tag_year(F.col("date")).alias("year"))


def list_without_repeats(items: DataFrame, by: str = "playlist_id", item: str = "track_id", pos: str = "pos") -> DataFrame:
    """First occurrence of each item of a list, positions from 1 without gaps."""
    first = items.groupBy(by, item).agg(F.min(pos).alias("_first"))
    return first.select(by, item, F.row_number().over(W.partitionBy(by).orderBy("_first")).alias("position"))


def seed_playlists(playlists: DataFrame, items: DataFrame, source: DataFrame) -> DataFrame:
    """New playlists: members that are linked, distinct, in order; dates fall back to the earliest and latest member's."""
    linked = items.join(source.select(F.col("source_id").alias("track_ref"), F.col("track_id"), F.col("date_added").alias("added")), items["source_track"] == F.col("track_ref")).where("track_id is not null")
    members = list_without_repeats(linked, "playlist_id", "track_id", "pos")
    dates = linked.groupBy("playlist_id").agg(F.min("added").alias("earliest"), F.max("added").alias("latest"))
    kept = playlists.where(~F.col("folder")).select("playlist_id", "created_at")
    return members.join(kept, "playlist_id").join(dates, "playlist_id").select("playlist_id", "track_id", "position", F.coalesce("created_at", "earliest").alias("created_at"), "latest")


def fold_lists(group: pd.DataFrame) -> pd.DataFrame:
    """The fold itself over the lists of some names, newest first."""
    group = group.sort_values(["created_at", "playlist_id"], ascending=[False, True], na_position="last", kind="stable")
    held: dict[str, list] = {}
    anchor: dict[str, int] = {}
    sets: dict[str, frozenset] = {}
    for pid, name, tracks in zip(group["playlist_id"], group["name"], group["tracks"], strict=True):
        tracks = list(tracks)
        if name in held:
            held[name] += [t for t in dict.fromkeys(tracks) if t not in sets[name]]
        elif frozenset(tracks) not in sets.values():
            held[name], anchor[name] = tracks, pid
        else:
            continue
        sets[name] = frozenset(held[name])
    out = [(anchor[n], n, i + 1, t) for n, x in held.items() for i, t in enumerate(x)]
    return pd.DataFrame(out, columns=["playlist_id", "name", "position", "track_id"])


def _set_hash(tracks: Column) -> list[Column]:
    """128 bits of a set of tracks, which follow from those of its members by XOR."""
    own = lambda h: F.aggregate(F.array_distinct(tracks), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(h(x)))
    return [own(h).alias(f"h{i}") for i, h in enumerate(HASHES)]


HASHES = (lambda x: F.xxhash64(x), lambda x: F.xxhash64(F.lit(1), x))


def _firsts(lists: DataFrame, anchors: DataFrame) -> DataFrame:
    """(k, track, at): where each track comes first among a name's lists from its anchor on: (list, position)."""
    later = lists.join(anchors, "k").where("o >= anchor").select("k", "o", F.posexplode("tracks").alias("i", "track"))
    return later.groupBy("k", "track").agg(F.min(F.struct("o", "i")).alias("at"))


def _states(firsts: DataFrame) -> DataFrame:
    """(k, h0, h1, o, until): the set that a name's list has from one list to another; ``until`` is null for the last one."""
    steps = firsts.groupBy("k", F.col("at.o").alias("o")).agg(*[F.bit_xor(h(F.col("track"))).alias(f"d{i}") for i, h in enumerate(HASHES)])
    w = W.partitionBy("k").orderBy("o")
    held = w.rowsBetween(W.unboundedPreceding, 0)
    return steps.select("k", *[F.bit_xor(f"d{i}").over(held).alias(f"h{i}") for i in range(2)], "o", F.lead("o").over(w).alias("until"))


def _anchors(lists: DataFrame, states: DataFrame) -> DataFrame:
    """(k, anchor): of each name the first list whose set no other name's list has just then; names that have none stay out."""
    tries = lists.select("k", "h0", "h1", "o", F.lit(0).alias("turn"), F.lit(0).alias("n"))
    begin = states.select("k", "h0", "h1", "o", F.lit(1).alias("turn"), F.lit(1).alias("n"))
    end = states.where("until is not null").select("k", "h0", "h1", F.col("until").alias("o"), F.lit(1).alias("turn"), F.lit(-1).alias("n"))
    upto = lambda *by: W.partitionBy("h0", "h1", *by).orderBy("o", "turn").rowsBetween(W.unboundedPreceding, 0)
    seen = tries.union(begin).union(end).withColumn("own", F.sum("n").over(upto("k"))).withColumn("all", F.sum("n").over(upto()))
    return seen.where("turn = 0 and all = own").groupBy("k").agg(F.min("o").alias("anchor"))


def merge_playlists_by_name(playlists: DataFrame, items: DataFrame) -> DataFrame:
    """Fold playlists newest first: the same name appends new tracks to the list of this run; a new name whose track set equals an existing
    list's current set is skipped. The anchor keeps its repeats, appended tracks are distinct.

    The fold is sequential, but what a name's list becomes follows from its anchor alone: the tracks of its later lists, where each comes first.
    So every name is anchored at its first list to begin with, the sets that the lists then have at any time (128 bits) are held against all lists, and names whose
    anchor was skipped move on, until none does. Each round settles the earliest lists that the one before left open, so the end is the fold's.
    ``playlists``: playlist_id, name, created_at. ``items``: playlist_id, pos, track_id.
    """
    held = items.groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("pos", "track_id"))).alias("m"))
    key = F.coalesce(F.concat(F.lit("="), "name"), F.lit("")).alias("k")
    order = F.struct(F.col("created_at").isNull().alias("late"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("back"), F.col("playlist_id").alias("id")).alias("o")
    lists = playlists.join(held, "playlist_id").select(key, "name", order, F.col("m.track_id").alias("tracks"))
    lists = written(lists.select("*", *_set_hash(F.col("tracks"))), "lists")
    anchors = written(lists.groupBy("k").agg(F.min("o").alias("anchor")), "anchors")
    firsts = written(_firsts(lists, anchors), "firsts")
    while True:
        now = written(_anchors(lists, _states(firsts)), "anchors")
        moved = anchors.select("k", F.col("anchor").alias("was")).join(now, "k", "full").where(~F.col("was").eqNullSafe(F.col("anchor"))).select("k", "anchor")
        moved = written(moved, "moved")
        if moved.isEmpty():
            break
        firsts = written(firsts.join(moved.select("k"), "k", "left_anti").union(_firsts(lists, moved.where("anchor is not null"))), "firsts")
        anchors = now
    anchored = lists.join(anchors, "k").where("o = anchor")
    whole = anchored.select("k", F.col("o.id").alias("playlist_id"), "name", F.size("tracks").alias("n"), "tracks")
    own = whole.select("playlist_id", "name", F.posexplode("tracks").alias("i", "track_id")).select("playlist_id", "name", (F.col("i") + 1).alias("position"), "track_id")
    more = firsts.join(whole.drop("tracks"), "k").join(anchors, "k").where(F.col("at.o") > F.col("anchor"))
    more = numbered(more.select("k", "at", "playlist_id", "name", "n", "track"), ["k"], ["at"], "rank")
    return own.union(more.select("playlist_id", "name", (F.col("n") + F.col("rank")).cast("int").alias("position"), F.col("track").alias("track_id")))
