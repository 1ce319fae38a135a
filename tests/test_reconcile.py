"""Remotes on small literal tables: repeats, translations that aren't inverse, decisions and aborts."""

import pytest
from pyspark.sql import functions as F

from tessitura.operators import reconcile as R


@pytest.fixture(scope="module")
def make(spark):
    def items(d, key="playlist_id long"):
        return spark.createDataFrame([(k, i + 1, x) for k, xs in d.items() for i, x in enumerate(xs)], f"{key}, pos long, track_id long")

    def links(rows):
        return spark.createDataFrame(rows, "playlist_id long, remote string, external_id string, base array<long>")

    def remote(name, lists, known, offered=None):
        rows = [(k, i + 1, x) for k, xs in lists.items() for i, x in enumerate(xs)]
        return R.Remote(
            name, spark.createDataFrame([(k, k) for k in lists], "external_id string, name string"), spark.createDataFrame(rows, "external_id string, pos long, ref string"),
            spark.createDataFrame(list(known.items()), "ref string, canon long"), None if offered is None else spark.createDataFrame(list(offered.items()), "canon long, ref string"),
        )

    def ids(*n):
        return spark.createDataFrame([(i,) for i in n], "playlist_id long")

    return items, links, remote, ids


def lists(df, item="track_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["playlist_id"], r["pos"])):
        out.setdefault(r["playlist_id"], []).append(r[item])
    return out


def test_repeats_survive_and_a_second_pass_changes_nothing(make):
    items, links, remote, ids = make
    known, offered = {"r1": 1, "r2": 2, "r3": 3}, {1: "r1", 2: "r2", 3: "r3"}
    server = remote("s", {"x": ["r1", "r2"]}, known, offered)
    first = R.pair_sync(items({1: [1, 1, 2]}), R.current_links(ids(1), links([(1, "s", "x", [1, 2])]), server), server)
    assert lists(first.merged) == {1: [1, 1, 2]} and [tuple(r) for r in first.ops.collect()] == [(1, 1, "r1", 1, 2)]
    there = R.membership(R.current_links(ids(1), links([(1, "s", "x", [1, 2])]), server), server)
    after = lists(R.remote_after(there, first.ops), "ref")
    assert after == {1: ["r2", "r1", "r1"]}
    again = remote("s", {"x": after[1]}, known, offered)
    base = first.links.first()["base"]
    second = R.pair_sync(items(lists(first.merged)), R.current_links(ids(1), links([(1, "s", "x", base)]), again), again)
    assert lists(second.merged) == {1: [1, 1, 2]} and second.ops.isEmpty()


def test_translations_need_not_be_inverse(make):
    """A track that can't be pushed stays local and out of the base; one that reads back as another doesn't come back as new."""
    items, links, remote, ids = make
    server = remote("s", {"x": []}, {"r1": 1, "odd": 3}, {1: "r1", 2: "odd"})
    done = R.pair_sync(items({1: [1, 2, 9]}), R.current_links(ids(1), links([(1, "s", "x", [])]), server), server)
    assert lists(done.merged) == {1: [1, 2, 9]} and done.links.first()["base"] == [1, 3]
    assert [r["ref"] for r in done.ops.orderBy("ord").collect()] == ["r1", "odd"]


def test_a_source_is_pulled_only(make):
    items, links, remote, ids = make
    source = remote("a", {"x": ["1", "3"]}, {"1": 1, "3": 3})
    done = R.pair_sync(items({1: [1, 2], 2: [5]}), R.current_links(ids(1, 2), links([(1, "a", "x", [1, 2])]), source), source)
    assert lists(done.merged) == {1: [1, 3], 2: [5]} and done.ops.isEmpty()
    assert [(r["playlist_id"], r["base"]) for r in done.links.collect()] == [(1, [1, 3])]


def test_conflicts_abort_and_decisions_force(make):
    items, links, remote, ids = make
    ours, link = items({1: [1, 2]}), links([(1, "a", "x", [1, 2]), (1, "s", "y", [1])])
    source = remote("a", {"x": ["1"]}, {"1": 1, "2": 2})  # has removed 2
    server = remote("s", {"y": ["r1", "r2"], "new": ["r2", "zz"]}, {"r1": 1, "r2": 2}, {1: "r1", 2: "r2"})  # has added 2
    stopped = R.reconcile(ids(1), ours, link, [source, server])
    assert stopped.aborted and lists(stopped.items) == {1: [1, 2]}
    decide = lambda how, remote=None: ids(1).select("playlist_id", F.lit(how).alias("strategy"), F.lit(remote).cast("string").alias("remote"))
    for how, name, want in (("ours", None, [1, 2]), ("take", "a", [1])):
        done = R.reconcile(ids(1), ours, link, [source, server], decide(how, name))
        assert lists(done.items) == {1: want, 2: [2]}
        base = {(r["playlist_id"], r["remote"]): r["base"] for r in done.links.collect()}
        assert base == {(1, "a"): [1], (1, "s"): want, (2, "s"): [2]}
        assert [(r["external_id"], r["playlist_id"]) for r in done.pulled.collect()] == [("new", 2)]
    with pytest.raises(ValueError):
        R.reconcile(ids(1), ours, link, [source, server], decide("take", "nobody"))


def test_review_asks_for_any_change(make):
    items, links, remote, ids = make
    source = remote("a", {"x": ["1", "2"]}, {"1": 1, "2": 2})
    link = links([(1, "a", "x", [1])])
    assert R.reconcile(ids(1), items({1: [1]}), link, [source], review=True).aborted
    assert not R.reconcile(ids(1), items({1: [1]}), link, [source]).aborted
    same = links([(1, "a", "x", [1, 2])])
    assert not R.reconcile(ids(1), items({1: [1, 2]}), same, [source], review=True).aborted
