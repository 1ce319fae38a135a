"""Duplicate groups as review pages: labels, stored confirmations, filters and order, as one report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators.dedup import REVIEW_SETS, find_duplicates, hashed, stored_groups

NORMS = ("title_norm", "artist_norm", "album_artist_norm", "album_norm")
#: The four filters over pages: confirmed and auto (decided without a person).
FILTERS = {
    "resolved all": lambda confirmed, auto: ~auto,
    "resolved unconfirmed": lambda confirmed, auto: ~auto & ~confirmed,
    "resolved confirmed": lambda confirmed, auto: ~auto & confirmed,
    "auto-resolved": lambda confirmed, auto: auto & ~confirmed,
}


def page_label(artist_norm: Column, album_artist_norm: Column, title_norm: Column) -> Column:
    """Who and title of the canon candidate; '?' for nobody."""
    blank = F.lit("")
    return F.concat(F.coalesce(F.nullif(artist_norm, blank), F.nullif(album_artist_norm, blank), F.lit("?")), F.lit(" — "), title_norm)


def numbered_labels(rows: DataFrame, label: str, order: str, first: str = " #") -> DataFrame:
    """``rows`` with equal labels told apart: the first keeps it, the k-th is given ``first`` and k."""
    k = F.row_number().over(W.partitionBy(label).orderBy(order))
    return rows.withColumn("_k", k).withColumn(label, F.when(F.col("_k") == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(first), F.col("_k").cast("string")))).drop("_k")


def pages(tracks: DataFrame, canon: DataFrame, stored: DataFrame, sets=REVIEW_SETS, strategy: str = "added") -> DataFrame:
    """One row for each duplicate group: component, label, n_tracks, confirmed, auto_resolved, hashes and members (id, chosen canon).

    ``tracks`` with comparison forms; ``canon`` (id, canon_id): what is decided now; ``stored`` (group_id, member_hash, canon_hash). A page is confirmed if a
    stored group has the same multiset of member hashes and every stored canon is on the page; its choices are then the stored
    ones, else the present ones. A page is auto-resolved if any member points somewhere and it isn't confirmed.
    """
    groups = find_duplicates(tracks, sets, strategy).select("id", "component", F.col("canon_id").alias("candidate"))
    now = canon.select(F.col("id").alias("_own"), F.col("canon_id").alias("now"))
    rows = hashed(tracks).join(groups, "id").join(now, F.col("id") == F.col("_own"), "left").select("component", "id", "candidate", "now", "duplicate_hash", *NORMS)
    member = F.struct("id", "duplicate_hash", "now")
    page = rows.groupBy("component").agg(
        F.count("*").alias("n_tracks"), F.array_sort(F.collect_list("duplicate_hash")).alias("hashes"), F.array_sort(F.collect_list(member)).alias("m"),
        F.max(F.col("now").isNotNull()).alias("pointed"), F.max_by(page_label(F.col("artist_norm"), F.col("album_artist_norm"), F.col("title_norm")), F.col("candidate").isNull()).alias("label"),
    )
    page = numbered_labels(page, "label", "component")
    known = stored_groups(stored).groupBy("hashes").agg(F.max("group_id").alias("group_id"))
    picks = stored.groupBy("group_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("member_hash", F.coalesce("canon_hash", F.lit("")).alias("c"))))).alias("picks"))
    j = page.join(known, "hashes", "left").join(picks, "group_id", "left")
    ids = F.map_from_entries(F.transform(F.array_distinct(F.transform("m", lambda x: x["duplicate_hash"])), lambda h: F.struct(h.alias("h"), F.array_max(F.transform(F.filter("m", lambda x: x["duplicate_hash"] == h), lambda x: x["id"])).alias("i"))))
    j = j.withColumn("ids", ids)
    whole = F.col("picks").isNotNull() & F.forall("m", lambda x: (F.element_at("picks", x["duplicate_hash"]) == "") | F.map_contains_key("ids", F.element_at("picks", x["duplicate_hash"])))
    confirmed = F.coalesce(whole, F.lit(False))
    chosen = F.when(F.col("confirmed"), F.transform("m", lambda x: F.struct(x["id"].alias("id"), F.try_element_at("ids", F.element_at("picks", x["duplicate_hash"])).alias("canon"))))
    chosen = F.coalesce(chosen, F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["now"].alias("canon"))))
    j = j.withColumn("confirmed", confirmed)
    return j.select("component", "label", "n_tracks", "confirmed", (F.col("pointed") & ~F.col("confirmed")).alias("auto_resolved"), "hashes", chosen.alias("members"))


def filtered(page: DataFrame, tracks: DataFrame, mode: str = "resolved all", partial: str = "") -> DataFrame:
    """Pages of a filter, and of those the ones with a member that has ``partial`` in one of its four comparison forms; numbered in review order:
    confirmed first, then by the sorted hashes."""
    kept = page.where(FILTERS[mode](F.col("confirmed"), F.col("auto_resolved")))
    if partial:
        has = F.lit(False)
        for n in NORMS:
            has = has | F.coalesce(F.col(n).contains(partial), F.lit(False))
        hit = tracks.where(has).select(F.col("id").alias("_hit"))
        members = page.select("component", F.explode("members.id").alias("_hit")).join(hit, "_hit").select("component").distinct()
        kept = kept.join(members, "component", "left_semi")
    return kept


def review_order() -> list[Column]:
    """Confirmed pages first, then by the multiset of hashes, which outlives a rebuild of the tables."""
    return [(~F.col("confirmed")).asc(), F.array_join("hashes", "\x00").asc(), F.col("component").asc()]
