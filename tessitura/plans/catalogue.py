"""Named queries over the driver's tables and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import text as X
from tessitura.operators import dedup, history, match, playlists, review, unify
from tessitura.plans import databases, imports, streams, syncing
from tessitura.plans import views as V
from tessitura.plans.oracle import SQL
from tessitura.plans.scratch import written


def _norm(df: DataFrame, *fields: str) -> DataFrame:
    """Comparison forms of ASCII columns (the domain views hold no other), without the Python step."""
    return df.withColumns({f"{f}_norm": X.normalize_name(F.col(f), nfkc=False) for f in fields})


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with their comparison forms, written once: several steps of a query read them."""
    return written(_norm(V.track_v(spark, sf), "title", "artist", "album", "album_artist"), "tracks")


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    a = _norm(V.alias_v(spark, sf), "title", "artist", "album")
    return a.withColumn("alias_key", X.alias_label(F.col("title"), F.col("artist"), F.col("album")))


def normalize_name(spark, sf):
    return _norm(V.track_v(spark, sf), "title", "artist", "album", "album_artist").select("id", "title_norm", "artist_norm", "album_norm", "album_artist_norm")


def canon(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.find_duplicates(tracks(spark, sf)).select("id", "canon_id")


def trigram_similarity(spark, sf):
    t = V.track_v(spark, sf)
    other = F.concat(F.substring("title", 1, 3), F.substr(F.col("title"), F.lit(5)))
    return t.select("id", X.similarity(F.col("title"), other).cast("double").alias("to_typo"), X.similarity(F.col("title"), F.col("album")).cast("double").alias("to_album"))


def path_generate(spark, sf):
    return unify.candidate_paths(V.source_track_v(spark, sf))


def text_scalars(spark, sf):
    t = V.track_v(spark, sf)
    return t.select(
        "id", X.alias_label(F.col("title"), F.col("artist"), F.col("album")).alias("label"), X.playlist_comment(F.col("album"), F.col("id").cast("string"), F.col("artist")).alias("comment"),
        X.server_path(F.concat(F.when(F.col("id") % 2 == 0, F.lit("Library/")).otherwise(F.lit("Other/")), F.col("title"))).alias("path"), X.minutes(F.col("duration") * 37).alias("length"),
        X.group_label(F.col("artist"), F.col("title")).alias("group_label"), X.path_artist(F.col("id") % 13 == 0, F.col("album_artist"), F.col("artist")).alias("path_artist"),
        X.half_even_seconds(F.col("duration") * 1000 + (F.col("id") % 2) * 500).alias("seconds"), X.duration_bucket(F.col("duration")).alias("bucket"),
    )


def duplicate_hash(spark, sf):
    return dedup.hashed(V.track_v(spark, sf)).select("id", "duplicate_hash")


def status_counts(spark, sf):
    return history.status(V.track_v(spark, sf), V.file_v(spark, sf), V.scrobble_v(spark, sf), canon(spark, sf))


def scrobbles_by_platform(spark, sf):
    return history.by_platform(V.scrobble_v(spark, sf))


def dedup_single_set(spark, sf):
    return dedup.find_duplicates(tracks(spark, sf), (("artist", "duration"),))


def dedup_union_sets(spark, sf):
    return dedup.find_duplicates(tracks(spark, sf))


def dedup_canon_year(spark, sf):
    return dedup.find_duplicates(tracks(spark, sf), strategy="year")


def _stored(spark, sf):
    """Stored decisions: of every group's component the member with the largest id is canon; one member of every sixth is unknown."""
    g = dedup.find_duplicates(tracks(spark, sf)).select("id", "component")
    h = dedup.hashed(V.track_v(spark, sf)).select("id", "duplicate_hash")
    j = g.join(h, "id")
    top = j.groupBy("component").agg(F.max_by("duplicate_hash", "id").alias("canon_hash"))
    gone = F.when((F.col("component") % 6 == 0) & (F.col("id") == F.col("component")), F.concat(F.lit("gone"), F.col("duplicate_hash"))).otherwise(F.col("duplicate_hash"))
    return j.join(top, "component").select(F.col("component").alias("group_id"), gone.alias("member_hash"), "canon_hash")


def _whole(spark, sf):
    files = V.file_v(spark, sf).withColumn("is_main", F.col("id") % 100000 % 7 == 0)
    return dedup.auto_dedup(tracks(spark, sf), files, _stored(spark, sf))


def auto_dedup(spark, sf):
    """Deduplication from nothing to flattened canons."""
    return _whole(spark, sf).canon


def auto_dedup_mains(spark, sf):
    return _whole(spark, sf).mains


def auto_dedup_summary(spark, sf):
    return _whole(spark, sf).summary


def _review(spark, sf):
    t = tracks(spark, sf)
    g = dedup.find_duplicates(t)
    return t, review.pages(t, g.select("id", "canon_id").where("component % 2 = 1"), _stored(spark, sf), sets=dedup.DEFAULT_SETS)


def review_pages(spark, sf):
    """Duplicate groups as pages, with what is confirmed and chosen; half of them aren't decided yet."""
    page = _review(spark, sf)[1]
    chosen = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["id"].cast("string"), F.coalesce(m["canon"].cast("string"), F.lit("-")))), ",")
    return page.select("component", "label", "n_tracks", "confirmed", "auto_resolved", chosen.alias("members"))


def review_filter(spark, sf):
    """How many pages each of the four filters shows, with and without a part of a name, and the first of them in review order."""
    t, page = _review(spark, sf)
    out = None
    for mode in review.FILTERS:
        for partial in ("", "1"):
            kept = review.filtered(page, t, mode, partial)
            first = F.min(F.struct(~F.col("confirmed"), F.array_join("hashes", "\x00"), "component"))["component"]
            one = kept.agg(F.lit(mode).alias("mode"), F.lit(partial).alias("partial"), F.count("*").alias("n_pages"), first.alias("first_page"))
            out = one if out is None else out.union(one)
    return out


def dedup_manual_override(spark, sf):
    return dedup.apply_overrides(canon(spark, sf), V.track_v(spark, sf), _stored(spark, sf))


def stored_groups(spark, sf):
    s = dedup.stored_groups(_stored(spark, sf))
    return s.select("group_id", F.array_join("hashes", "|").alias("hashes"))


def _chain(spark, sf):
    """Every track points to the one four below it in its hundred."""
    k = F.col("id")
    return V.track_v(spark, sf).select("id", F.when(k % 100 >= 4, k - 4).alias("canon_id"))


def canon_flatten(spark, sf):
    return dedup.flatten(_chain(spark, sf))


def main_file_pick(spark, sf):
    return dedup.main_files(V.file_v(spark, sf), canon(spark, sf))


def group_rollup(spark, sf):
    return dedup.group_rollup(V.track_v(spark, sf), canon(spark, sf))


def scrobble_fresh(spark, sf):
    return history.fresh_scrobbles(V.scrobble_v(spark, sf))


def scrobble_import_stats(spark, sf):
    s = V.scrobble_v(spark, sf)
    return history.import_stats(s, history.fresh_scrobbles(s))


def alias_augment(spark, sf):
    return match.augment(aliases(spark, sf))


def alias_match_exact(spark, sf):
    t = tracks(spark, sf)
    c = canon(spark, sf).withColumnRenamed("id", "own")
    t = t.join(c, t["id"] == c["own"], "left").drop("own")
    a = _norm(V.scrobble_v(spark, sf).select("title", "artist", "album").distinct(), "title", "artist", "album")
    return match.match_exact(a.withColumn("alias_key", X.alias_label(F.col("title"), F.col("artist"), F.col("album"))), t)


def alias_match_fuzzy(spark, sf):
    return match.match_fuzzy(aliases(spark, sf), tracks(spark, sf)).withColumn("score", F.round("score", 6))


def alias_match_misspelt(spark, sf):
    """The same with every artist misspelt, so that no alias is settled by its own artist's tracks."""
    a = V.alias_v(spark, sf).withColumn("artist", F.concat(F.substring("artist", 1, 3), F.substr(F.col("artist"), F.lit(5)))).distinct()
    a = _norm(a, "title", "artist", "album").withColumn("alias_key", X.alias_label(F.col("title"), F.col("artist"), F.col("album")))
    return match.match_fuzzy(a, tracks(spark, sf)).withColumn("score", F.round("score", 6))


def _links(spark, sf):
    t = V.track_v(spark, sf).groupBy("title").agg(F.min("id").alias("track_id"))
    return V.scrobble_v(spark, sf).select("title", "artist", "album").distinct().join(t, "title").select("title", "artist", "album", F.when(F.col("track_id") % 4 != 0, F.col("track_id")).alias("track_id"))


def plays_copy(spark, sf):
    return history.copy_plays(history.fresh_scrobbles(V.scrobble_v(spark, sf)), _links(spark, sf))


def unify_tracks(spark, sf):
    return unify.unify_tracks(V.source_track_v(spark, sf), F.timestamp_seconds(F.lit(V.RUN_TS)))


def _disk_files(spark, sf):
    """One file for each candidate path of a source track, under one of two roots, some in upper case."""
    c = unify.candidate_paths(V.source_track_v(spark, sf))
    low = F.concat(F.when(F.col("id") % 4 == 0, F.lit("/music/Library/")).otherwise(F.lit("/backup/old ")), F.when(F.col("id") % 3 == 0, F.upper("path")).otherwise(F.col("path")))
    return c.select(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("path")).alias("id"), low.alias("source_path"))


def bind_files(spark, sf):
    return unify.bind_files(V.source_track_v(spark, sf), _disk_files(spark, sf))


def orphan_files(spark, sf):
    f = V.source_track_v(spark, sf)
    title = F.when(F.col("id") % 5 == 0, F.concat(F.col("title"), F.lit("?"))).otherwise(F.col("title"))
    date = F.when(F.col("id") % 7 == 0, F.lit("n/a")).otherwise(F.concat(F.col("year").cast("string"), F.lit("-01-01")))
    f = f.select("id", title.alias("title"), "artist", "album", "album_artist", date.alias("date"), F.lit(None).cast("long").alias("track_id"))
    return unify.orphan_files(f, V.track_v(spark, sf))


def _mine(spark, sf):
    return V.playlist_item_v(spark, sf, "ours").drop("side")


def playlists_seed(spark, sf):
    items = _mine(spark, sf).select("playlist_id", "pos", (F.col("track_id") * 2).alias("source_track"))
    source = V.source_track_v(spark, sf).where("provider = 'apple_xml'").select(F.col("id").alias("source_id"), F.when(F.col("id") % 14 != 0, F.col("source_id")).alias("track_id"), "date_added")
    lists = items.select("playlist_id").distinct().select("playlist_id", (F.col("playlist_id") % 9 == 0).alias("folder"), F.when(F.col("playlist_id") % 2 == 0, F.timestamp_seconds(F.lit(V.RUN_TS))).alias("created_at"))
    return unify.seed_playlists(lists, items, source)


def list_dedup_inflated(spark, sf):
    return unify.list_without_repeats(_mine(spark, sf))


def playlists_by_name(spark, sf):
    items = _mine(spark, sf)
    lists = items.select("playlist_id").distinct().select("playlist_id", F.concat(F.lit("list "), (F.col("playlist_id") % 40).cast("string")).alias("name"), F.when(F.col("playlist_id") % 5 != 0, F.timestamp_seconds(F.col("playlist_id") % 97)).alias("created_at"))
    return unify.merge_playlists_by_name(lists, items)


def merge_with_base(spark, sf):
    return playlists.merge(V.playlist_item_v(spark, sf))


def merge_no_base(spark, sf):
    return playlists.merge(V.playlist_item_v(spark, sf), use_base=False)


def _states(spark, sf):
    """Two remotes: one is 'theirs', the other reads 'ours'; both share the base."""
    c = playlists.counts(V.playlist_item_v(spark, sf))
    two = F.explode(F.array(*[F.struct(F.lit(remote).alias("remote"), F.col(side).alias("theirs")) for remote, side in (("a", "theirs"), ("b", "ours"))]))
    return c.select("playlist_id", "track_id", "base", two.alias("x")).select("playlist_id", "x.remote", "track_id", "base", "x.theirs")


def conflicts_detect(spark, sf):
    return playlists.conflicts(_states(spark, sf))


def touched_tracks(spark, sf):
    return playlists.touched(V.playlist_item_v(spark, sf))


def resolve_auto(spark, sf):
    ours = playlists.counts(V.playlist_item_v(spark, sf)).select("playlist_id", "track_id", F.col("base").alias("copies"))
    return playlists.resolve_auto(ours, _states(spark, sf), ["a", "b"])


def ref_count_ops(spark, sf):
    items = V.playlist_item_v(spark, sf)
    side = lambda s: items.where(F.col("side") == s).select("playlist_id", F.concat(F.lit("ref"), F.col("track_id").cast("string")).alias("ref"))
    return playlists.ref_operations(side("ours"), side("theirs"))


def playlist_totals(spark, sf):
    """Totals of lists a quarter of whose members isn't known."""
    items = _mine(spark, sf).withColumn("track_id", F.when(F.col("track_id") % 4 == 0, -1).otherwise(F.col("track_id")))
    return playlists.playlist_totals(items, V.track_v(spark, sf).withColumn("size", (F.col("duration") * 1000 + F.col("track_n")).cast("long")))


def backend_only(spark, sf):
    items = V.playlist_item_v(spark, sf)
    return playlists.remote_only(items.where("side = 'theirs'").select("playlist_id").distinct(), items.where("side = 'base'").select("playlist_id").distinct())


def resolved_refs(spark, sf):
    items = V.playlist_item_v(spark, sf).where("side = 'theirs'")
    return playlists.resolved_refs(items.select("playlist_id", "pos", (F.col("track_id") + 100).alias("track_id")), _chain(spark, sf))


def _play_stats(spark, sf):
    c = canon(spark, sf)
    plays = V.scrobble_v(spark, sf).select(F.col("date").alias("played_at"), "title").join(V.track_v(spark, sf).select(F.col("id").alias("track_id"), "title"), "title")
    return history.play_stats(plays, c, dedup.group_rollup(V.track_v(spark, sf), c))


def play_stats(spark, sf):
    return _play_stats(spark, sf)


def _albums(spark, sf):
    return V.track_v(spark, sf).select(F.col("id").alias("root_id"), "album")


def album_stats(spark, sf):
    return history.album_stats(_play_stats(spark, sf), _albums(spark, sf))


def artist_stats(spark, sf):
    roles = V.track_v(spark, sf).where("album_artist is not null").select("album", F.col("album_artist").alias("artist"), F.when(F.col("id") % 2 == 0, "albumartist").otherwise("artist").alias("role")).distinct()
    return history.artist_stats(_play_stats(spark, sf), _albums(spark, sf), roles)


QUERIES = (
    normalize_name, trigram_similarity, path_generate, text_scalars, duplicate_hash, status_counts, scrobbles_by_platform, dedup_single_set, dedup_union_sets, dedup_canon_year, dedup_manual_override,
    auto_dedup, auto_dedup_mains, auto_dedup_summary, review_pages, review_filter, stored_groups, canon_flatten, main_file_pick, group_rollup, scrobble_fresh, scrobble_import_stats, alias_augment, alias_match_exact, alias_match_fuzzy, alias_match_misspelt, plays_copy, unify_tracks, bind_files, orphan_files, playlists_seed,
    list_dedup_inflated, playlists_by_name, merge_with_base, merge_no_base, conflicts_detect, touched_tracks, resolve_auto, ref_count_ops, playlist_totals, backend_only, resolved_refs, play_stats, album_stats, artist_stats,
)


def queries() -> dict:
    from tessitura.plans import library

    return {f.__name__: f for f in (*QUERIES, *imports.QUERIES, *syncing.QUERIES, *streams.QUERIES, *databases.QUERIES, *library.QUERIES)}


def oracle_sql() -> dict[str, str]:
    from tessitura.plans import library

    return {**SQL, **imports.SQL, **syncing.SQL, **streams.SQL, **databases.SQL, **library.SQL}
