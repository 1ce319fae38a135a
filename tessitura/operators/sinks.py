"""Write operators as plans: what to insert, fill or change; ``commits`` writes them, so a dry run is free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.text import library_path, path_album, path_artist
from tessitura.operators.ranked import numbered


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows that get-or-create would insert: no existing row has their key, nulls equal; one for each key."""
    return incoming.dropDuplicates(keys).join(existing, _same(incoming, existing, keys), "left_anti")


def one_of_each(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row for each key, nulls equal: of every field the smallest value that isn't null."""
    return rows.groupBy(*keys).agg(*[F.min(f).alias(f) for f in fields])


def fill_nulls(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Existing rows with null fields filled from the incoming rows of their key; nothing else changes, and no row is added or repeated."""
    right = one_of_each(incoming, keys, fields).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f).alias(f"_{f}") for f in fields])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    j = existing.join(right, cond, "left")
    return j.select(*[F.coalesce(c, F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in existing.columns])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The new state of a keyed table: incoming rows replace existing ones. Of several incoming rows of a key the last in the order of all
    their columns is taken, so a key stays unique."""
    rest = [c for c in incoming.columns if c not in keys]
    if rest:
        last = incoming.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r"))
        incoming = last.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in incoming.columns])
    else:
        incoming = incoming.distinct()
    return existing.join(incoming, _same(existing, incoming, keys), "left_anti").unionByName(incoming)


def appended(items: DataFrame, more: DataFrame, by: str = "playlist_id") -> DataFrame:
    """New members placed after each list's last position, in the order of ``more.ord``."""
    last = items.groupBy(by).agg(F.max("position").alias("last"))
    placed = numbered(more.select(by, "track_id", "ord"), [by], ["ord"], "r")
    return placed.join(last, by, "left").select(by, "track_id", (F.coalesce("last", F.lit(0)) + F.col("r").cast("int")).alias("position"))


def replaced(items: DataFrame, merged: DataFrame, by: str = "playlist_id") -> DataFrame:
    """The members of all lists once those of ``merged`` are overwritten; ``merged`` has their members in order, from ``position`` 1."""
    return items.join(merged.select(by).distinct(), by, "left_anti").unionByName(merged.select(*items.columns))


def emptied(tables: dict[str, DataFrame], name: str, parents: dict[str, str]) -> dict[str, DataFrame]:
    """The tables with ``name`` and all that depend on it empty. ``parents``: child table -> the table that it refers to."""
    gone, more = {name}, True
    while more:
        more = {c for c, p in parents.items() if p in gone} - gone
        gone |= more
    return {n: t.where("false") if n in gone else t for n, t in tables.items()}


def rebuilt_playlists(playlists: DataFrame, items: DataFrame, links: DataFrame, new_playlists: DataFrame, new_items: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All canonical playlists deleted, with members and links, and built anew; and one row, ``n_deleted``."""
    state = emptied({"playlist": playlists, "item": items, "link": links}, "playlist", {"item": "playlist", "link": "playlist"})
    state |= {"playlist": state["playlist"].unionByName(new_playlists), "item": state["item"].unionByName(new_items)}
    return state, playlists.agg(F.count("*").alias("n_deleted"))


def pending_tracks(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Tracks with any file that has no place in the library yet."""
    return tracks.join(files.where("library_path is null").select(F.col("track_id").alias("id")), "id", "left_semi")


def file_plan(files: DataFrame, tracks: DataFrame, mains: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, role, target): the group's best file goes to Library/Music, the others to Copies/Music with a number from 0, which isn't shown.

    A missing source or an existing target is for the executor of the plan to refuse. ``files``: id, root_id, ext. ``mains``: root_id, file_id. ``keep``: columns of the tracks, or root_id, that
    the plan has too. All meet by group, so files that are dealt by group already don't move.
    """
    f = files.join(mains.select("root_id", F.col("file_id").alias("main_id")), "root_id", "left").withColumn("main", F.when(F.col("id") == F.col("main_id"), True))
    t = tracks.select(F.col("id").alias("root_id"), "title", path_artist(F.col("compilation"), F.col("album_artist"), F.col("artist")).alias("pa"), path_album(F.col("album")).alias("pl"), "track_n", "disc_n", *[c for c in keep if c != "root_id"])
    j = f.join(t, "root_id").withColumn("n", F.row_number().over(W.partitionBy("root_id", "main").orderBy("id")) - 1)
    path = library_path(F.col("pa"), F.col("pl"), F.col("title"), F.col("ext"), F.col("track_n"), F.col("disc_n"), F.when(F.col("main"), 0).otherwise(F.col("n")), F.lit(35))
    role = F.when(F.col("main"), "main").otherwise("copy")
    return j.select(F.col("id").alias("file_id"), role.alias("role"), F.concat(F.when(F.col("main"), "Library/Music/").otherwise("Copies/Music/"), path).alias("target"), *keep)
