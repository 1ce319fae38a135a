"""Duplicate tracks: rule sets, components, canon choice, stored overrides, flattening and best files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.text import duration_bucket, duplicate_hash
from tessitura.operators.components import components
from tessitura.plans.scratch import partitions, written

FIELDS = ("artist", "album_artist", "album", "track_n", "disc_n", "year", "duration")
DEFAULT_SETS = (("artist", "duration"), ("artist", "year"), ("album_artist", "duration"))
REVIEW_SETS = (("artist",), ("album_artist",), ("album",))


def blank(c: Column, text: bool) -> Column:
    """Null, or text of white space; 0 isn't blank."""
    return c.isNull() | (F.trim(c) == "") if text else c.isNull()


def buckets(tracks: DataFrame, sets: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(title_norm, id, least): the smallest id of each bucket with two tracks or more that ``id`` is in, one shuffle for all sets.

    ``tracks`` has title_norm, the three normalised fields (artist_norm ...), numbers and duration. Nulls are equal in a key; rows whose chosen
    fields are all blank, or whose title is, are left out.
    """
    value = {f: F.col(f"{f}_norm") if f in ("artist", "album_artist", "album") else duration_bucket(F.col("duration")) if f == "duration" else F.col(f) for f in FIELDS}
    keys = []
    for n, chosen in enumerate(sets):
        empty = F.lit(True)
        for f in chosen:
            empty = empty & blank(value[f], f in ("artist", "album_artist", "album"))
        key = F.struct(F.lit(n).alias("n"), *[F.coalesce(value[f].cast("string"), F.lit("\x00")).alias(f"k{i}") for i, f in enumerate(chosen)], *[F.lit("").alias(f"k{i}") for i in range(len(chosen), len(FIELDS))])
        keys.append(F.when(~empty, key))
    rows = tracks.where(~blank(F.col("title_norm"), True)).select("title_norm", "id", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k"))
    least = rows.groupBy("title_norm", "k").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("title_norm", "k", "least")
    return rows.join(least, ["title_norm", "k"]).select("title_norm", "id", "least")


def united(links: DataFrame) -> DataFrame:
    """(id, component) of the bucket rows; all rows of a bucket point to its smallest id, so buckets that share a row are one component."""
    links = written(links.select("id", "least").distinct(), "bucket_links")
    roots = components(links.select(F.col("id").alias("u"), F.col("least").alias("v")))
    nodes = links.select("id").union(links.select("least")).distinct()
    return nodes.join(roots, nodes["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("component"))


def rank_key(strategy: str = "added") -> Column:
    """Order of the canon choice: earliest added (or year) first, nulls last, then id."""
    added, year = (F.col("date_added").isNull(), F.col("date_added")), (F.col("year").isNull(), F.col("year"))
    first, second = (added, year) if strategy == "added" else (year, added)
    return F.struct(first[0].alias("a0"), first[1].alias("a1"), second[0].alias("b0"), second[1].alias("b1"), F.col("id").alias("id"))


def find_duplicates(tracks: DataFrame, sets=DEFAULT_SETS, strategy: str = "added") -> DataFrame:
    """(id, component, canon_id) of every track in a group; canon_id is null for the canon itself."""
    groups = united(buckets(tracks, sets))
    ranked = groups.join(tracks.select("id", "date_added", "year"), "id")
    canon = ranked.groupBy("component").agg(F.min(rank_key(strategy)).alias("k")).select("component", F.col("k.id").alias("canon"))
    return groups.join(canon, "component").select("id", "component", F.nullif("canon", "id").alias("canon_id"))


def hashed(tracks: DataFrame) -> DataFrame:
    """``tracks`` with duplicate_hash over the raw fields."""
    return tracks.withColumn("duplicate_hash", duplicate_hash(F.col("title"), F.col("artist"), F.col("album_artist"), F.col("album"), F.col("track_n"), F.col("disc_n"), F.col("year"), duration_bucket(F.col("duration"))))


def apply_overrides(canon: DataFrame, tracks: DataFrame, members: DataFrame) -> DataFrame:
    """``canon`` (id, canon_id) with stored decisions on top. ``members``: group_id, member_hash, canon_hash.

    A group counts only if every member hash is there. A canon hash names the first track that has it; a track's own
    means none; an unknown one leaves the track as it is.
    """
    n = partitions(tracks.sparkSession)  # every join and group is dealt by number; no side is small enough for a broadcast at size
    own = hashed(tracks).select("id", "duplicate_hash").repartition(n, "duplicate_hash")
    first = own.groupBy("duplicate_hash").agg(F.min("id").alias("first"))
    same = written(own.join(first.hint("merge"), "duplicate_hash").select("id", "duplicate_hash", "first"), "hashes")
    # from here on a hash is the first track that has it
    named = lambda rows, key, name: rows.repartition(n, key).join(same.where("id = first").select(F.col("duplicate_hash").alias(key), F.col("first").alias(name)).hint("merge"), key, "left")
    met = named(members.select("group_id", "member_hash", "canon_hash"), "member_hash", "first").select("group_id", "first", "canon_hash")
    met = written(named(met, "canon_hash", "target").select("group_id", "first", "target", F.col("canon_hash").isNull().alias("unsaid")), "decisions").repartition(n, "group_id")
    whole = met.groupBy("group_id").agg(F.bool_and(F.col("first").isNotNull()).alias("ok")).where("ok").select("group_id")
    decided = met.join(whole.hint("merge"), "group_id").where("unsaid or target is not null").select("first", F.struct("group_id", "target").alias("t"))
    last = decided.repartition(n, "first").groupBy("first").agg(F.max("t").alias("t"))
    ids = same.select("id", "first").join(last.hint("merge"), "first").select(F.col("id").alias("own"), F.nullif(F.col("t.target"), F.col("id")).alias("chosen"))
    j = canon.repartition(n, "id").join(ids.hint("merge"), canon["id"] == ids["own"], "left")
    return j.select("id", F.when(F.col("own").isNotNull(), F.col("chosen")).otherwise(F.col("canon_id")).alias("canon_id"))


def flatten(canon: DataFrame, rounds: int = 40) -> DataFrame:
    """Re-point every twin to the end of its chain by pointer doubling; a cycle raises."""
    now = canon
    for _ in range(rounds):
        up = now.select(F.col("id").alias("up"), F.col("canon_id").alias("over")).where("over is not null")
        now = written(now.join(up, now["canon_id"] == up["up"], "left").select("id", F.coalesce("over", "canon_id").alias("canon_id"), F.col("over").isNotNull().alias("moved")), "flat")
        if now.where("id = canon_id").limit(1).count():
            raise ValueError("canon chain with a cycle")
        if not now.where("moved").limit(1).count():
            return now.select("id", "canon_id")
        now = now.select("id", "canon_id")
    raise ValueError("canon chain with a cycle")


@dataclass(frozen=True)
class Deduplicated:
    """``canon`` (id, canon_id) of every track, ``mains`` (root_id, file_id, n_files) and ``summary``, one row of counts."""

    canon: DataFrame
    mains: DataFrame
    summary: DataFrame


def auto_dedup(tracks: DataFrame, files: DataFrame, stored: DataFrame | None = None, sets=DEFAULT_SETS, strategy: str = "added") -> Deduplicated:
    """Deduplicate from nothing: what was decided before is forgotten; rule sets, components and canon choice, then stored decisions on top, chains
    flattened and the main file of every group chosen anew.

    ``tracks`` with comparison forms; ``files``: id, track_id, bitrate, ext and ``is_main``, the mark as it was. The summary counts groups, twins, tracks that
    a stored decision changed, twins that were re-pointed to the end of a chain, and groups whose main files changed.
    """
    found = find_duplicates(tracks, sets, strategy).select(F.col("id").alias("_f"), F.col("canon_id").alias("_c"))
    auto = written(tracks.select("id").join(found, F.col("id") == F.col("_f"), "left").select("id", F.col("_c").alias("canon_id")), "auto")
    told = auto if stored is None else written(apply_overrides(auto, tracks, stored), "told")
    canon = flatten(told)
    mains = written(main_files(files, canon), "mains")
    moved = lambda a, b, name: a.join(b.select("id", F.col("canon_id").alias("_b")), "id").agg(F.count_if(~F.col("canon_id").eqNullSafe(F.col("_b"))).alias(name))
    groups = canon.agg(F.countDistinct("canon_id").alias("n_groups"), F.count("canon_id").alias("n_twins"))
    one = groups.crossJoin(moved(auto, told, "n_overridden")).crossJoin(moved(told, canon, "n_flattened")).crossJoin(changed_mains(files, canon, mains))  # four single rows
    return Deduplicated(canon, mains, one)


def changed_mains(files: DataFrame, canon: DataFrame, mains: DataFrame) -> DataFrame:
    """One row, ``n_mains_changed``: groups whose files marked as main were not just the one that is chosen now."""
    twins = canon.where("canon_id is not null").select(F.col("id").alias("twin"), "canon_id")
    owned = files.join(twins, files["track_id"] == twins["twin"], "left").select(F.coalesce("canon_id", "track_id").alias("root_id"), "id", "is_main")
    j = owned.join(mains.select("root_id", "file_id"), "root_id")
    per = j.groupBy("root_id").agg(F.bool_and(F.coalesce("is_main", F.lit(False)) == (F.col("id") == F.col("file_id"))).alias("same"))
    return per.agg(F.count_if(~F.col("same")).alias("n_mains_changed"))


def file_rank() -> Column:
    """Best file: kbit/s, then flac, m4a, mp3, other, then the smallest id."""
    ext = F.lower("ext")
    container = F.when(ext == "flac", 3).when(ext == "m4a", 2).when(ext == "mp3", 1).otherwise(0)
    return F.struct((-F.floor(F.coalesce("bitrate", F.lit(0)) / 1000)).alias("a"), (-container).alias("b"), F.col("id").alias("id"))


def main_files(files: DataFrame, canon: DataFrame) -> DataFrame:
    """(root_id, file_id): the best file of each group. ``canon``: id, canon_id of all tracks that are twins."""
    twins = canon.where("canon_id is not null").select(F.col("id").alias("twin"), "canon_id")
    owned = files.join(twins, files["track_id"] == twins["twin"], "left").withColumn("root_id", F.coalesce("canon_id", "track_id"))
    return best_files(owned)


def best_files(owned: DataFrame) -> DataFrame:
    """(root_id, file_id, n_files) of files that have their group's root_id."""
    return owned.groupBy("root_id").agg(F.min(file_rank()).alias("k"), F.count("*").alias("n_files")).select("root_id", F.col("k.id").alias("file_id"), "n_files")


def group_rollup(tracks: DataFrame, canon: DataFrame) -> DataFrame:
    """Rating (largest but 0), loved (any) and earliest added date of each group."""
    twins = canon.select(F.col("id").alias("twin"), "canon_id")
    rows = tracks.join(twins, tracks["id"] == twins["twin"], "left").withColumn("root_id", F.coalesce("canon_id", "id"))
    return rows.groupBy("root_id").agg(F.count("*").alias("n_tracks"), F.max(F.when(F.col("rating") != 0, F.col("rating"))).alias("rating"), F.coalesce(F.bool_or("loved"), F.lit(False)).alias("loved"), F.min("date_added").alias("date_added"))


def stored_groups(members: DataFrame) -> DataFrame:
    """(group_id, hashes): a group's identity is the sorted multiset of its member hashes."""
    return members.groupBy("group_id").agg(F.array_sort(F.collect_list("member_hash")).alias("hashes"))
