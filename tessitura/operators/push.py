"""Pushing play statistics to a music server: scrobbles, media files, albums and annotations, as the new rows of each table.

Groups are entered through their organised main files; plays, ratings and loved state come from the whole group. Every table is a keyed upsert:
what is given back are the rows as they are to be, so writing is a separate call.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.text import server_path
from tessitura.plans.scratch import written

ROLES = ("albumartist", "artist")  # fixed values


@dataclass(frozen=True)
class Push:
    """New rows: ``scrobbles`` (media_file_id, submission_time), ``media`` (id, created_at, birth_time), ``albums`` (id, created_at) and
    ``annotations`` (item_id, item_type, play_count, play_date, rating, rated_at, starred, starred_at); ``tracks``: what was pushed for each main file."""

    scrobbles: DataFrame
    media: DataFrame
    albums: DataFrame
    annotations: DataFrame
    tracks: DataFrame


def organised_mains(files: DataFrame, canon: DataFrame) -> DataFrame:
    """(track_id, root_id, path): tracks that own a main file with a place in the library, and that place as the server names it."""
    twins = canon.where("canon_id is not null").select(F.col("id").alias("_twin"), "canon_id")
    main = files.where("is_main and library_path is not null and track_id is not null")
    return main.join(twins, main["track_id"] == twins["_twin"], "left").select("track_id", F.coalesce("canon_id", "track_id").alias("root_id"), server_path(F.col("library_path")).alias("path"))


def group_facts(tracks: DataFrame, canon: DataFrame) -> DataFrame:
    """root_id with added (earliest), rating and album_rating (largest but 0), loved and album_loved (any) of its group."""
    twins = canon.where("canon_id is not null").select(F.col("id").alias("_twin"), "canon_id")
    rows = tracks.join(twins, tracks["id"] == twins["_twin"], "left").withColumn("root_id", F.coalesce("canon_id", "id"))
    most = lambda c: F.max(F.when(F.col(c) != 0, F.col(c))).alias(c)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    return rows.groupBy("root_id").agg(F.min("date_added").alias("added"), most("rating"), most("album_rating"), some("loved"), some("album_loved"))


def upsert_annotations(existing: DataFrame, changed: DataFrame) -> DataFrame:
    """The annotations as they are afterwards: one row for each item of either side; null fields of ``changed`` leave what is there."""
    keys = ["item_id", "item_type"]
    fields = ["play_count", "play_date", "rating", "rated_at", "starred", "starred_at"]
    new = changed.select(*keys, F.lit(True).alias("_new"), *[F.col(f).alias(f"_{f}") for f in fields], F.col("exact").alias("_exact"))
    j = existing.select(*keys, *fields).join(new, keys, "full")
    plain = [F.coalesce(F.col(f"_{f}"), F.col(f)).alias(f) for f in fields if f != "play_date"]
    date = F.when(F.col("_exact"), F.col("_play_date")).otherwise(F.coalesce("_play_date", "play_date")).alias("play_date")
    return j.select(*keys, *plain, date).withColumn("starred", F.coalesce("starred", F.lit(False)))


def push_stats(tracks: DataFrame, canon: DataFrame, files: DataFrame, plays: DataFrame, media: DataFrame, albums: DataFrame, album_artists: DataFrame, scrobbles: DataFrame, annotations: DataFrame) -> Push:
    """Push all groups that own an organised main file which the server has.

    ``tracks``: id, date_added, rating, album_rating, loved, album_loved. ``canon``: id, canon_id. ``files``: track_id, is_main, library_path. ``plays``: track_id, played_at.
    ``media``: id, path, album_id, created_at. ``albums``: id, created_at. ``album_artists``: album_id, artist_id, role. ``scrobbles``: media_file_id,
    submission_time, and ``annotations``, both of one user.

    A file's play count, first and last play are over the distinct seconds of its group's plays and of the scrobbles that the server already has. Its
    annotation is overwritten, but rating and star only where the group has them. An album's and an artist's totals are sums over this run's files (an
    artist with two roles on an album counts twice); an album's rating and star are set only where it has none, by the smallest track that
    has them, and both stamp the rating's date: the later of the two in track order wins.
    """
    mains = organised_mains(files, canon).join(group_facts(tracks, canon), "root_id")
    m = media.select(F.col("id").alias("media_id"), F.col("path").alias("_path"), "album_id", "created_at")
    owned = written(mains.join(m, mains["path"] == m["_path"]).drop("_path"), "mains")
    twins = canon.where("canon_id is not null").select(F.col("id").alias("_twin"), "canon_id")
    seconds = plays.join(twins, plays["track_id"] == twins["_twin"], "left").select(F.coalesce("canon_id", plays["track_id"]).alias("root_id"), F.col("played_at").cast("long").alias("submission_time"))
    # a group with two organised main files plays for both
    mine = seconds.distinct().join(owned.select("root_id", "media_id"), "root_id").select(F.col("media_id").alias("media_file_id"), "submission_time")
    every = written(scrobbles.select("media_file_id", "submission_time").union(mine).distinct(), "scrobbles")
    s = every.groupBy("media_file_id").agg(F.count("*").alias("n"), F.max("submission_time").alias("last"), F.min("submission_time").alias("first"))
    j = owned.join(s, owned["media_id"] == s["media_file_id"], "left").drop("media_file_id")
    time = lambda c: F.timestamp_seconds(F.nullif(F.col(c), F.lit(0).cast("long")))
    done = j.select("track_id", "root_id", "media_id", "album_id", "created_at", "added", "rating", "album_rating", "loved", "album_loved", F.coalesce("n", F.lit(0)).alias("play_count"), time("last").alias("last_play"), time("first").alias("first_play"))
    done = written(done, "pushed")
    earliest = F.least("created_at", "first_play", "added")
    own = done.select(
        F.col("media_id").alias("item_id"), F.lit("media_file").alias("item_type"), "play_count", F.col("last_play").alias("play_date"), "rating", F.when(F.col("rating").isNotNull(), F.col("added")).alias("rated_at"),
        F.when(F.col("loved"), True).alias("starred"), F.when(F.col("loved"), F.col("added")).alias("starred_at"), F.lit(True).alias("exact"),
    )
    had = annotations.where("item_type = 'album'").select(F.col("item_id").alias("_album"), F.col("rating").alias("_rating"), F.col("starred").alias("_starred"))
    a = done.groupBy("album_id").agg(
        F.sum("play_count").alias("play_count"), F.max("last_play").alias("play_date"), F.min(F.least("first_play", "added")).alias("earliest"),
        F.min(F.when(F.col("album_rating").isNotNull(), F.struct("track_id", "album_rating", "added"))).alias("r"), F.min(F.when(F.col("album_loved"), F.struct("track_id", "added"))).alias("l"),
    )
    a = a.join(had, a["album_id"] == had["_album"], "left")
    rates = (F.coalesce("_rating", F.lit(0)) == 0) & F.col("r").isNotNull()
    stars = ~F.coalesce("_starred", F.lit(False)) & F.col("l").isNotNull()
    stamp = F.when(rates & stars, F.when(F.col("l.track_id") >= F.col("r.track_id"), F.col("l.added")).otherwise(F.col("r.added"))).when(rates, F.col("r.added")).when(stars, F.col("l.added"))
    none = F.lit(None).cast("timestamp")
    of_album = a.select(F.col("album_id").alias("item_id"), F.lit("album").alias("item_type"), "play_count", "play_date", F.when(rates, F.col("r.album_rating")).alias("rating"), stamp.alias("rated_at"), F.when(stars, True).alias("starred"), none.alias("starred_at"), F.lit(False).alias("exact"))
    by = album_artists.where(F.col("role").isin(*ROLES)).select("album_id", "artist_id")
    r = a.select("album_id", "play_count", "play_date").join(by, "album_id").groupBy("artist_id").agg(F.sum("play_count").alias("play_count"), F.max("play_date").alias("play_date"))
    of_artist = r.select(F.col("artist_id").alias("item_id"), F.lit("artist").alias("item_type"), "play_count", "play_date", F.lit(None).cast("int").alias("rating"), none.alias("rated_at"), F.lit(None).cast("boolean").alias("starred"), none.alias("starred_at"), F.lit(False).alias("exact"))
    new_albums = albums.join(a.select(F.col("album_id").alias("id"), "earliest"), "id").select("id", F.least("created_at", "earliest").alias("created_at"))
    return Push(
        scrobbles=every.join(scrobbles.select("media_file_id", "submission_time"), ["media_file_id", "submission_time"], "left_anti"),
        media=done.groupBy(F.col("media_id").alias("id")).agg(F.min(earliest).alias("created_at")).withColumn("birth_time", F.col("created_at")),
        albums=new_albums,
        annotations=upsert_annotations(annotations, own.union(of_album).union(of_artist)),
        tracks=done,
    )
