"""Playlists edited by several parties: multiset three-way merge, conflicts, resolution and operations on the remote list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.plans.scratch import partitions

COUNT = lambda side: F.count_if(F.col("side") == side)


def counts(items: DataFrame) -> DataFrame:
    """Copies of each track of each playlist in base, ours and theirs, in one shuffle, and whether the playlist has a base."""
    rows = items.select("playlist_id", "track_id", "side").repartition(partitions(items.sparkSession), "playlist_id", "track_id")
    c = rows.groupBy("playlist_id", "track_id").agg(COUNT("base").alias("base"), COUNT("ours").alias("ours"), COUNT("theirs").alias("theirs"))
    return c


def _target(use_base: bool) -> Column:
    """Copies of a track that a merge keeps, from its numbers on the three sides and ``has_base``."""
    larger, merged = F.greatest("ours", "theirs"), F.greatest(F.lit(0).cast("long"), F.col("ours") + F.col("theirs") - F.col("base"))
    return F.when(F.col("has_base"), merged).otherwise(larger) if use_base else larger


def targets(items: DataFrame, use_base: bool = True) -> DataFrame:
    """(playlist_id, track_id, target): ours + theirs - base, 0 at least; without a base (or with an empty one) the larger of both."""
    c = counts(items)
    has = c.groupBy("playlist_id").agg(F.max(F.col("base") > 0).alias("has_base"))
    c = c.join(has, "playlist_id")
    return c.select("playlist_id", "track_id", "base", "ours", "theirs", _target(use_base).alias("target"))


def merge(items: DataFrame, use_base: bool = True) -> DataFrame:
    """(playlist_id, position, track_id): ours kept up to the target, then what theirs has beyond, each in its own order."""
    # one shuffle, by playlist: all windows below are within a playlist
    rows = items.select("playlist_id", "side", "track_id", "pos").repartition(partitions(items.sparkSession), "playlist_id").withColumn("has_base", F.max(F.col("side") == "base").over(W.partitionBy("playlist_id")))
    track = W.partitionBy("playlist_id", "track_id")
    rows = rows.withColumns({n: COUNT(n).over(track) for n in ("base", "ours", "theirs")}).where("side <> 'base'")
    rows = rows.withColumn("target", _target(use_base)).where("playlist_id is not null and track_id is not null and target > 0")
    rows = rows.withColumn("occ", F.row_number().over(W.partitionBy("playlist_id", "side", "track_id").orderBy("pos")))
    keep = F.when(F.col("side") == "ours", F.col("occ") <= F.col("target")).otherwise(F.col("occ") <= F.col("target") - F.least("ours", "target"))
    return rows.where(keep).select("playlist_id", F.row_number().over(W.partitionBy("playlist_id").orderBy("side", "pos")).alias("position"), "track_id")


def conflicts(states: DataFrame) -> DataFrame:
    """(playlist_id, track_id): added by one remote and removed by another. ``states``: playlist_id, remote, track_id, base, theirs (copies)."""
    # windows sort and hold one track of one list; aggregates would hold all of a task's, and several times for a distinct count
    w = W.partitionBy("playlist_id", "track_id")
    delta = F.col("theirs") - F.col("base")
    d = states.select("playlist_id", "track_id", "remote", F.max(delta).over(w).alias("up"), F.min(delta).over(w).alias("down"))
    return d.where("up > 0 and down < 0").groupBy("playlist_id", "track_id").agg(F.countDistinct("remote").alias("n_remotes"))


def touched(items: DataFrame) -> DataFrame:
    """Tracks that any side changed against the base."""
    return counts(items).where("ours <> base or theirs <> base").select("playlist_id", "track_id")


def resolve_auto(ours: DataFrame, states: DataFrame, order: list[str]) -> DataFrame:
    """(playlist_id, track_id, copies): fold the remotes in list order, each a three-way merge against its own base; an empty base is none."""
    now = ours.select("playlist_id", "track_id", "copies")
    for remote in order:
        s = states.where(F.col("remote") == remote)
        has = s.groupBy("playlist_id").agg(F.max(F.col("base") > 0).alias("has_base"))
        j = now.join(s.select("playlist_id", "track_id", "base", "theirs"), ["playlist_id", "track_id"], "full").join(has, "playlist_id", "left").fillna(0, ["copies", "base", "theirs"])
        merged = F.when(F.col("has_base"), F.greatest(F.lit(0).cast("long"), F.col("copies") + F.col("theirs") - F.col("base"))).when(F.col("has_base").isNull(), F.col("copies")).otherwise(F.greatest("copies", "theirs"))
        now = j.select("playlist_id", "track_id", merged.alias("copies"))
    return now.where("copies > 0")


def ref_operations(want: DataFrame, have: DataFrame) -> DataFrame:
    """(playlist_id, ref, have, want): refs whose number differs; the remote list removes all copies and adds ``want`` again."""
    w = want.groupBy("playlist_id", "ref").agg(F.count("*").alias("want"))
    h = have.groupBy("playlist_id", "ref").agg(F.count("*").alias("have"))
    return w.join(h, ["playlist_id", "ref"], "full").fillna(0, ["want", "have"]).where("want <> have")


def playlist_totals(items: DataFrame, tracks: DataFrame) -> DataFrame:
    """Songs, seconds and, where tracks have a size, bytes of each list; a list without known tracks has zeros."""
    sums = [c for c in ("duration", "size") if c in tracks.columns]
    t = tracks.select(F.col("id").alias("track_id"), *sums)
    named = {"duration": "seconds", "size": "size"}
    known = items.join(t.withColumn("known", F.lit(1)), "track_id", "left")
    return known.groupBy("playlist_id").agg(F.count("known").alias("song_count"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(named[c]) for c in sums])


def remote_only(remote: DataFrame, known: DataFrame) -> DataFrame:
    """Lists of a remote that no local list is linked with."""
    return remote.join(known, "playlist_id", "left_anti")


def resolved_refs(items: DataFrame, canon: DataFrame) -> DataFrame:
    """Items with each track replaced by its canon, one hop."""
    c = canon.where("canon_id is not null").select(F.col("id").alias("twin"), "canon_id")
    return items.join(c, items["track_id"] == c["twin"], "left").withColumn("track_id", F.coalesce("canon_id", "track_id")).drop("twin", "canon_id")
