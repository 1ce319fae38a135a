"""Scrobbles, plays and the statistics that are pushed to a server."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_scrobbles(scrobbles: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(date, title, artist, album, platform): dates are unique over everything; the alias that appears first wins a date.

    An alias' place is the smallest id of its rows; null and '' are one artist or album.
    """
    e = F.lit("")
    s = scrobbles.select("id", "date", "platform", "title", F.coalesce("artist", e).alias("artist"), F.coalesce("album", e).alias("album"))
    seen = s.groupBy("title", "artist", "album").agg(F.min("id").alias("place"))
    s = s.join(seen, ["title", "artist", "album"])
    if existing is not None:
        s = s.join(existing.select("date").distinct(), "date", "left_anti")
    best = s.groupBy("date").agg(F.min(F.struct("place", "id", "title", "artist", "album", "platform")).alias("k"))
    return best.select("date", "k.title", "k.artist", "k.album", "k.platform")


def import_stats(scrobbles: DataFrame, fresh: DataFrame) -> DataFrame:
    """How many alias dates came, were taken and were ignored."""
    came = scrobbles.groupBy("title", "artist", "album").agg(F.countDistinct("date").alias("n"))
    taken = fresh.groupBy("title", "artist", "album").agg(F.count("*").alias("m"))
    j = came.join(taken, ["title", "artist", "album"], "left").fillna(0, ["m"])
    return j.agg(F.sum("m").alias("scrobbles_created"), F.sum(F.col("n") - F.col("m")).alias("scrobbles_ignored"), F.count_if(F.col("m") == 0).alias("aliases_skipped"), F.count_if(F.col("m") > 0).alias("aliases_created"))


def created_aliases(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """(title, artist, album) that an import creates: those that bring a date and aren't there."""
    keys = ["title", "artist", "album"]
    return fresh.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def copy_plays(scrobbles: DataFrame, links: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(played_at, track_id, platform) of linked aliases. ``links``: title, artist, album, track_id.

    With ``existing`` plays (play_id, played_at, track_id, platform; a scrobble is its date) the new state of the table: a scrobble that has a play keeps it,
    pointed to the track that its alias is linked with now; new plays have no play_id yet; plays of unlinked aliases stay as they are.
    """
    found = scrobbles.join(links.where("track_id is not null"), ["title", "artist", "album"]).select(F.col("date").alias("played_at"), "track_id", "platform")
    if existing is None:
        return found
    had = existing.select("play_id", "played_at", F.col("track_id").alias("_track"), F.col("platform").alias("_platform"))
    j = found.join(had, "played_at", "full")
    return j.select("play_id", "played_at", F.coalesce("track_id", "_track").alias("track_id"), F.coalesce("_platform", "platform").alias("platform"))


def play_stats(plays: DataFrame, canon: DataFrame, rollup: DataFrame) -> DataFrame:
    """Per group: distinct seconds played, first and last, with rating and loved state."""
    twins = canon.select(F.col("id").alias("twin"), "canon_id")
    p = plays.join(twins, plays["track_id"] == twins["twin"], "left").select(F.coalesce("canon_id", "track_id").alias("root_id"), F.col("played_at").cast("long").alias("s"))
    s = p.groupBy("root_id").agg(F.countDistinct("s").alias("play_count"), F.timestamp_seconds(F.max("s")).alias("last_play"), F.timestamp_seconds(F.min("s")).alias("first_play"))
    j = s.join(rollup, "root_id")
    return j.select("root_id", "play_count", "last_play", "first_play", "rating", F.when(F.col("rating").isNotNull(), F.col("date_added")).alias("rated_at"), "loved", F.when(F.col("loved"), F.col("date_added")).alias("starred_at"), F.least("first_play", "date_added").alias("created_at"))


def album_stats(stats: DataFrame, albums: DataFrame) -> DataFrame:
    """Totals of each album over its groups."""
    return stats.join(albums, "root_id").groupBy("album").agg(F.sum("play_count").alias("play_count"), F.max("last_play").alias("last_play"), F.min("created_at").alias("created_at"), F.count("*").alias("n_groups"))


def artist_stats(stats: DataFrame, albums: DataFrame, roles: DataFrame, once: bool = False) -> DataFrame:
    """Totals of each artist over the albums where they have a role; an artist with two roles counts twice, unless ``once``."""
    r = roles.where(F.col("role").isin("albumartist", "artist")).select("album", "artist")
    r = r.distinct() if once else r
    return stats.join(albums, "root_id").join(r, "album").groupBy("artist").agg(F.sum("play_count").alias("play_count"), F.max("last_play").alias("last_play"))


def by_platform(scrobbles: DataFrame) -> DataFrame:
    return scrobbles.groupBy("platform").agg(F.count("*").alias("n_scrobbles"), F.countDistinct("date").alias("n_dates"))


def status(tracks: DataFrame, files: DataFrame, scrobbles: DataFrame, canon: DataFrame) -> DataFrame:
    """One row of pipeline counts and guarded ratios."""
    t = tracks.agg(F.count("*").alias("tracks"), F.count_if(F.col("loved")).alias("loved"), F.count_if(F.coalesce("rating", F.lit(0)) != 0).alias("rated"))
    f = files.agg(F.count("*").alias("files"), F.count_if(F.col("track_id").isNotNull()).alias("bound"))
    s = scrobbles.agg(F.count("*").alias("scrobbles"))
    c = canon.agg(F.count_if(F.col("canon_id").isNotNull()).alias("twins"), F.countDistinct("canon_id").alias("groups"))
    one = t.crossJoin(f).crossJoin(s).crossJoin(c)  # four single rows
    return one.withColumn("bound_share", F.coalesce(F.try_divide(F.col("bound").cast("double"), F.col("files").cast("double")), F.lit(0.0)))


def status_report(
    source_tracks: DataFrame, source_playlists: DataFrame, scrobbles: DataFrame, tracks: DataFrame, aliases: DataFrame, plays: DataFrame, playlists: DataFrame, files: DataFrame, groups: DataFrame, links: DataFrame,
) -> DataFrame:
    """(section, item, part, n, of, share): where a library stands, a row for each count.

    ``part`` is null for a total, else the provider or platform that it is of. ``of`` is what a count is a share of, null where it is none; the share of nothing is 0. Empty
    tables count 0. ``source_playlists``: folder (null: none); ``tracks``: canon_id; ``aliases`` and ``files``: track_id; ``files``: library_path; ``groups``: group_id.
    """
    none = F.lit(None)

    def row(section: str, item: str, rows: DataFrame, n=None, of=None) -> DataFrame:
        return rows.agg((F.count("*") if n is None else n).cast("long").alias("n"), (none if of is None else of).cast("long").alias("of")).select(F.lit(section).alias("section"), F.lit(item).alias("item"), none.cast("string").alias("part"), "n", "of")

    def parts(section: str, item: str, rows: DataFrame, by: str) -> DataFrame:
        each = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
        return each.select(F.lit(section).alias("section"), F.lit(item).alias("item"), F.col(by).alias("part"), "n", none.cast("long").alias("of"))

    has = lambda c: F.count_if(F.col(c).isNotNull())
    report = [
        row("imported", "source tracks", source_tracks), parts("imported", "source tracks", source_tracks, "provider"), row("imported", "source playlists", source_playlists.where(~F.coalesce("folder", F.lit(False)))),
        row("imported", "scrobbles", scrobbles), parts("imported", "scrobbles", scrobbles, "platform"), row("canonical", "tracks", tracks), row("canonical", "aliases matched", aliases, has("track_id"), F.count("*")), row("canonical", "plays", plays),
        row("canonical", "playlists", playlists), row("files", "bound to tracks", files, has("track_id"), F.count("*")), row("files", "organised", files, has("library_path")), row("duplicates", "twins", tracks, has("canon_id")),
        row("duplicates", "groups", tracks, F.countDistinct("canon_id")), row("duplicates", "confirmed groups", groups, F.countDistinct("group_id")), row("synced", "playlist links", links),
    ]
    out = report[0]
    for r in report[1:]:
        out = out.union(r)
    return out.withColumn("share", F.when(F.col("of").isNotNull(), F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("of").cast("double")), F.lit(0.0))))
