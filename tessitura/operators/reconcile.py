"""Playlists against remotes: one pass with a single remote, decisions on conflicts, and the whole reconcile as plans.

Everything is set-at-a-time over all playlists: a pass is a handful of shuffles by playlist, whatever the number of lists. Nothing is
written here: the plans are DataFrames, so a dry run is free. Sides are long tables (playlist_id, pos, track_id) with repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators.ranked import numbered
from tessitura.operators.playlists import conflicts, merge
from tessitura.plans.scratch import written


@dataclass(frozen=True)
class Remote:
    """A remote as tables. A source is read only; a server can be written to.

    ``lists``: external_id, name. ``items``: external_id, pos, ref. ``known``: ref, canon (the track that a ref reads as). ``offered``: canon, ref
    (the ref that a track is pushed as); the two need not be inverse to each other.
    """

    name: str
    lists: DataFrame
    items: DataFrame
    known: DataFrame
    offered: DataFrame | None = None

    @property
    def writable(self) -> bool:
        return self.offered is not None


@dataclass(frozen=True)
class Pass:
    """What one pass does: ``merged`` (playlist_id, pos, track_id), ``ops`` (playlist_id, ord, ref, have, want), ``links`` (playlist_id,
    external_id, base) of the lists that are linked afterwards and ``created`` (playlist_id) of lists that the remote gets."""

    merged: DataFrame
    ops: DataFrame
    links: DataFrame
    created: DataFrame


def in_order(rows: DataFrame, by: str, pos: str, item: str, name: str) -> DataFrame:
    """(by, name): each list's items as an array in order."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(item).alias("x")))).alias("_l")).select(by, F.col("_l.x").alias(name))


def json_base(text: Column) -> Column:
    """A stored merge base, a JSON list of track ids, as an array; null for null."""
    return F.from_json(text, "array<bigint>")


def server_refs(media: DataFrame, files: DataFrame, canon: DataFrame) -> DataFrame:
    """(ref, canon): a media file reads as the root of the track whose organised file has its path below ``Library/``."""
    owned = files.where("library_path is not null and track_id is not null").select(F.col("library_path").alias("_path"), F.col("track_id").alias("_track"))
    twins = canon.where("canon_id is not null").select(F.col("id").alias("_twin"), "canon_id")
    met = media.join(owned, F.concat(F.lit("Library/"), F.col("path")) == owned["_path"]).join(twins, F.col("_track") == F.col("_twin"), "left")
    return met.select(media["id"].alias("ref"), F.coalesce("canon_id", "_track").alias("canon"))


def offered_refs(media: DataFrame, files: DataFrame) -> DataFrame:
    """(canon, ref): a track is pushed as the media file at the path of its main file."""
    main = files.where("is_main and library_path is not null").select(F.col("track_id").alias("canon"), F.regexp_replace("library_path", "^Library/", "").alias("_path"))
    return main.join(media, main["_path"] == media["path"]).select("canon", media["id"].alias("ref"))


def source_refs(source: DataFrame, canon: DataFrame) -> DataFrame:
    """(ref, canon): a source track reads as the root of the track that it is linked with."""
    twins = canon.where("canon_id is not null").select(F.col("id").alias("_twin"), "canon_id")
    linked = source.where("track_id is not null")
    return linked.join(twins, linked["track_id"] == twins["_twin"], "left").select(linked["id"].cast("string").alias("ref"), F.coalesce("canon_id", "track_id").alias("canon"))


def current_links(playlists: DataFrame, links: DataFrame, remote: Remote) -> DataFrame:
    """(playlist_id, external_id, base, linked) of every playlist. A writable remote's link whose list is gone is dropped; a source's keeps its base."""
    there = remote.lists.select(F.col("external_id").alias("_there")).distinct()
    own = links.where(F.col("remote") == remote.name).select(F.col("playlist_id").alias("_p"), F.col("external_id").alias("_ext"), "base")
    j = playlists.select("playlist_id").join(own, F.col("playlist_id") == F.col("_p"), "left").join(there, F.col("_ext") == F.col("_there"), "left")
    stale = F.col("_there").isNull() if remote.writable else F.lit(False)
    base = F.when(F.col("_p").isNotNull() & ~stale, F.col("base"))
    return j.select("playlist_id", F.col("_there").alias("external_id"), F.coalesce(base, F.array().cast("array<bigint>")).alias("base"), (F.col("_p").isNotNull() & ~stale).alias("linked"))


def membership(linked: DataFrame, remote: Remote) -> DataFrame:
    """(playlist_id, pos, ref, canon): what the remote holds of each list now; canon is null where a ref reads as no track."""
    there = linked.where("external_id is not null").select("playlist_id", "external_id")
    known = remote.known.where("canon is not null").dropDuplicates(["ref"])
    return there.join(remote.items, "external_id").join(known, "ref", "left").select("playlist_id", "pos", "ref", "canon")


def pair_sync(ours: DataFrame, linked: DataFrame, remote: Remote) -> Pass:
    """Merge every list with one remote. ``ours``: playlist_id, pos, track_id (roots). ``linked``: playlist_id, external_id, base.

    A source is pulled from only: its lists are merged, its base becomes what it holds, and a list that it doesn't have stays as it is. For a
    server, each merged copy is pushed as the ref that the list already has for the track (the one that appears last, if several do),
    or else as the offered one; a track without a ref stays local and out of the base. A ref whose number differs is removed and added again
    as often as wanted: wanted refs first, in merged order. The base becomes what the remote will read back.
    """
    here = linked if remote.writable else linked.where("external_id is not null")
    there = written(membership(here, remote), "membership")
    read = there.where("canon is not null")
    touched = here.select("playlist_id").distinct()
    base = here.select("playlist_id", F.posexplode("base").alias("pos", "track_id")).select("playlist_id", F.lit("base").alias("side"), "track_id", F.col("pos").cast("long").alias("pos"))
    mine = ours.join(touched, "playlist_id", "left_semi").select("playlist_id", F.lit("ours").alias("side"), "track_id", F.col("pos").cast("long").alias("pos"))
    theirs = read.select("playlist_id", F.lit("theirs").alias("side"), F.col("canon").alias("track_id"), F.col("pos").cast("long").alias("pos"))
    merged = written(merge(base.union(mine).union(theirs)), "merged").select("playlist_id", F.col("position").cast("long").alias("pos"), "track_id")
    apart = ours.join(touched, "playlist_id", "left_anti").select("playlist_id", F.col("pos").cast("long").alias("pos"), "track_id")
    ext = here.select("playlist_id", "external_id")
    empty = F.array().cast("array<bigint>")
    if not remote.writable:
        held = in_order(read, "playlist_id", "pos", "canon", "base")
        links = ext.join(held, "playlist_id", "left").select("playlist_id", "external_id", F.coalesce("base", empty).alias("base"))
        none = there.where("false")
        return Pass(merged.union(apart), none.select("playlist_id", F.lit(1).alias("ord"), "ref", F.lit(0).cast("long").alias("have"), F.lit(0).cast("long").alias("want")), links, none.select("playlist_id"))
    first = read.groupBy("playlist_id", "canon", "ref").agg(F.min("pos").alias("first"))
    own = first.groupBy("playlist_id", F.col("canon").alias("track_id")).agg(F.max_by("ref", "first").alias("own"))
    offer = remote.offered.where("ref is not null").groupBy(F.col("canon").alias("track_id")).agg(F.min("ref").alias("offer"))
    want = merged.join(own, ["playlist_id", "track_id"], "left").join(offer, "track_id", "left").select("playlist_id", "pos", F.coalesce("own", "offer").alias("ref")).where("ref is not null")
    want = written(want, "wanted")
    w = want.groupBy("playlist_id", "ref").agg(F.count("*").alias("want"), F.min("pos").alias("w"))
    h = there.groupBy("playlist_id", "ref").agg(F.count("*").alias("have"), F.min("pos").alias("h"))
    differ = w.join(h, ["playlist_id", "ref"], "full").fillna(0, ["want", "have"]).where("want <> have")
    ord_ = F.row_number().over(W.partitionBy("playlist_id").orderBy(F.col("w").isNull(), F.coalesce("w", "h"), "ref"))
    known = remote.known.where("canon is not null").dropDuplicates(["ref"])
    back = in_order(want.join(known, "ref"), "playlist_id", "pos", "canon", "base")
    created = ext.where("external_id is null").select("playlist_id").join(want.select("playlist_id").distinct(), "playlist_id")
    new = created.select(F.col("playlist_id").alias("_new"), F.concat(F.lit("new:"), F.col("playlist_id").cast("string")).alias("_id"))
    links = ext.join(new, F.col("playlist_id") == F.col("_new"), "left").select("playlist_id", F.coalesce("external_id", "_id").alias("external_id")).where("external_id is not null")
    links = links.join(back, "playlist_id", "left").select("playlist_id", "external_id", F.coalesce("base", empty).alias("base"))
    return Pass(merged.union(apart), differ.select("playlist_id", ord_.alias("ord"), "ref", "have", "want"), links, created)


def remote_after(there: DataFrame, ops: DataFrame) -> DataFrame:
    """(playlist_id, pos, ref): the remote's lists once the operations are done. ``there``: playlist_id, pos, ref."""
    kept = there.join(ops.select("playlist_id", "ref"), ["playlist_id", "ref"], "left_anti").select("playlist_id", F.lit(0).alias("later"), F.col("pos").cast("long").alias("at"), "ref")
    added = ops.where("want > 0").select("playlist_id", F.lit(1).alias("later"), F.col("ord").cast("long").alias("at"), F.explode(F.array_repeat("ref", F.col("want").cast("int"))).alias("ref"))
    return kept.union(added).select("playlist_id", F.row_number().over(W.partitionBy("playlist_id").orderBy("later", "at")).alias("pos"), "ref")


def states_of(playlists: DataFrame, links: DataFrame, remotes: list[Remote]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each remote its links as they are now and its membership, both written once."""
    out = {}
    for r in remotes:
        linked = written(current_links(playlists, links, r), "linked")
        out[r.name] = (linked, written(membership(linked, r), "theirs"))
    return out


def conflicted(states: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(playlist_id, track_id, n_remotes): tracks that one remote has added and another removed."""
    rows = None
    for name, (linked, theirs) in states.items():
        base = linked.select("playlist_id", F.explode("base").alias("track_id"), F.lit(1).alias("b"), F.lit(0).alias("t"))
        own = base.union(theirs.where("canon is not null").select("playlist_id", F.col("canon").alias("track_id"), F.lit(0).alias("b"), F.lit(1).alias("t")))
        own = own.groupBy("playlist_id", "track_id").agg(F.sum("b").alias("base"), F.sum("t").alias("theirs")).withColumn("remote", F.lit(name))
        rows = own if rows is None else rows.union(own)
    return conflicts(rows)


def changes(ours: DataFrame, states: dict[str, tuple[DataFrame, DataFrame]], auto: DataFrame) -> DataFrame:
    """(playlist_id): lists that a pass by itself would touch: a remote differs from its base, or the merge from ours."""
    empty = F.array().cast("array<bigint>")
    rows = None
    for linked, theirs in states.values():
        held = in_order(theirs.where("canon is not null"), "playlist_id", "pos", "canon", "t")
        own = linked.join(held, "playlist_id", "left").where(F.coalesce("t", empty) != F.col("base")).select("playlist_id")
        rows = own if rows is None else rows.union(own)
    a, b = in_order(ours, "playlist_id", "pos", "track_id", "a"), in_order(auto, "playlist_id", "pos", "track_id", "b")
    own = a.join(b, "playlist_id", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("playlist_id")
    return (own if rows is None else rows.union(own)).distinct()


def auto_fold(ours: DataFrame, states: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(playlist_id, pos, track_id): the remotes merged one after the other, each against its own base, in order."""
    now = ours.select("playlist_id", F.col("pos").cast("long").alias("pos"), "track_id")
    for linked, theirs in states.values():
        side = lambda rows, name, pos, track: rows.select("playlist_id", F.lit(name).alias("side"), F.col(track).alias("track_id"), F.col(pos).cast("long").alias("pos"))
        base = linked.select("playlist_id", F.posexplode("base").alias("pos", "track_id"))
        items = side(base, "base", "pos", "track_id").union(side(now, "ours", "pos", "track_id")).union(side(theirs.where("canon is not null"), "theirs", "pos", "canon"))
        now = written(merge(items), "folded").select("playlist_id", F.col("position").cast("long").alias("pos"), "track_id")
    return now


def resolve(ours: DataFrame, states: dict[str, tuple[DataFrame, DataFrame]], decisions: DataFrame) -> DataFrame:
    """(playlist_id, pos, track_id) of every list by its decision (playlist_id, strategy, remote): ``ours`` keeps the list, ``take`` gives the
    remote's, anything else folds the remotes in order. Raises if a list takes a remote that isn't there."""
    names = list(states)
    lost = decisions.where((F.col("strategy") == "take") & ~F.coalesce(F.col("remote").isin(names), F.lit(False)))
    if not lost.isEmpty():
        raise ValueError("a decision takes a remote that is no part of the reconcile")
    forced = decisions.where(F.col("strategy").isin("ours", "take")).select("playlist_id")
    out = auto_fold(ours, states).join(forced, "playlist_id", "left_anti").unionByName(
        ours.join(decisions.where("strategy = 'ours'").select("playlist_id"), "playlist_id", "left_semi").select("playlist_id", F.col("pos").cast("long").alias("pos"), "track_id"))
    for name, (_, theirs) in states.items():
        taken = decisions.where((F.col("strategy") == "take") & (F.col("remote") == name)).select("playlist_id")
        own = theirs.where("canon is not null").join(taken, "playlist_id", "left_semi")
        out = out.unionByName(own.select("playlist_id", F.row_number().over(W.partitionBy("playlist_id").orderBy("pos")).cast("long").alias("pos"), F.col("canon").alias("track_id")))
    return out


@dataclass(frozen=True)
class Reconciled:
    """The state after a reconcile: ``items`` (playlist_id, pos, track_id), ``links`` (playlist_id, remote, external_id, base), ``ops`` of each writable
    remote, ``pulled`` (playlist_id, remote, external_id, name): lists that came from a server, and ``aborted``."""

    items: DataFrame
    links: DataFrame
    ops: dict[str, DataFrame]
    pulled: DataFrame | None
    aborted: bool = False


def reconcile(playlists: DataFrame, ours: DataFrame, links: DataFrame, remotes: list[Remote], decisions: DataFrame | None = None, review: bool = False) -> Reconciled:
    """Reconcile all lists with the remotes in order. ``playlists``: playlist_id. ``links``: playlist_id, remote, external_id, base.

    Without ``decisions``, a conflict (or with ``review`` any change) aborts the whole run and nothing changes. A list that is decided by ``ours`` or
    ``take`` is forced: every link's base becomes what its remote holds, so that the pass pushes the decided list. Lists of a writable
    remote that no playlist is linked with are pulled at the end, numbered after the largest id; sources create no lists.
    """
    states = states_of(playlists, links, remotes)
    found = conflicted(states).select("playlist_id").distinct()
    if review:
        found = found.union(changes(ours, states, auto_fold(ours, states))).distinct()
    if decisions is None:
        if not found.isEmpty():
            return Reconciled(ours, links, {}, None, aborted=True)
        decisions = found.select("playlist_id", F.lit("auto").alias("strategy"), F.lit(None).cast("string").alias("remote"))
    decided = decisions.join(found, "playlist_id", "left_semi")
    forced = written(decided.where(F.col("strategy").isin("ours", "take")).select("playlist_id"), "forced")
    final = resolve(ours.join(forced, "playlist_id", "left_semi"), {n: tuple(x.join(forced, "playlist_id", "left_semi") for x in s) for n, s in states.items()}, decided.where(F.col("strategy").isin("ours", "take")))
    now = written(ours.join(forced, "playlist_id", "left_anti").select("playlist_id", F.col("pos").cast("long").alias("pos"), "track_id").unionByName(final), "start")
    empty = F.array().cast("array<bigint>")
    kept, ops, pulled = links.where(~F.col("remote").isin([r.name for r in remotes])).select("playlist_id", "remote", "external_id", "base"), {}, None
    after = {}
    for r in remotes:
        linked, theirs = states[r.name]
        held = in_order(theirs.where("canon is not null"), "playlist_id", "pos", "canon", "held").join(forced, "playlist_id", "left_semi")
        mark = forced.select(F.col("playlist_id").alias("_f"))
        rebased = linked.join(held, "playlist_id", "left").join(mark, F.col("playlist_id") == F.col("_f"), "left")
        rebased = rebased.select("playlist_id", "external_id", F.when(F.col("_f").isNotNull() & F.col("linked"), F.coalesce("held", empty)).otherwise(F.col("base")).alias("base"), "linked")
        done = pair_sync(now, rebased, r)
        now = written(done.merged, "items")
        ops[r.name] = written(done.ops, "ops")
        own = written(done.links, "links")
        untouched = links.where(F.col("remote") == r.name).join(linked.where("linked").select("playlist_id"), "playlist_id", "left_semi").join(own.select("playlist_id"), "playlist_id", "left_anti")
        after[r.name] = own.select("playlist_id", F.lit(r.name).alias("remote"), "external_id", "base").unionByName(untouched.select("playlist_id", "remote", "external_id", "base"))
        kept = kept.unionByName(after[r.name])
    for r in (r for r in remotes if r.writable):
        new = r.lists.join(after[r.name].select("external_id"), "external_id", "left_anti")
        new = numbered(new, [], ["external_id"], "rank")
        last = playlists.agg(F.max("playlist_id")).first()[0] if pulled is None else pulled.agg(F.max("playlist_id")).first()[0] or playlists.agg(F.max("playlist_id")).first()[0]
        own = written(new.select((F.col("rank") + F.lit(last or 0)).cast("long").alias("playlist_id"), F.lit(r.name).alias("remote"), "external_id", "name"), "pulled")
        done = pair_sync(now.where("false"), own.select("playlist_id", "external_id", empty.alias("base")), r)
        now = now.unionByName(done.merged)
        kept = kept.unionByName(done.links.select("playlist_id", F.lit(r.name).alias("remote"), "external_id", "base"))
        ops[r.name] = ops[r.name].unionByName(done.ops)
        pulled = own if pulled is None else pulled.union(own)
    return Reconciled(now, kept, ops, pulled)
