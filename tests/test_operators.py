"""Operators on small literal tables: goldens, hazards and sequential models."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessitura.operators import components, dedup, history, match, playlists, sinks, unify
from tessitura.plans import views as V

TRACK = "id long, title string, artist string, album string, album_artist string, track_n int, disc_n int, year int, duration int, date_added timestamp, loved boolean, rating int"


def tracks(spark, rows):
    full = [(i, t, a, b, None, 1, 1, y, d, datetime(added, 1, 1) if added else None, loved, rating) for i, t, a, b, y, d, added, loved, rating in rows]
    df = spark.createDataFrame(full, TRACK)
    return df.withColumns({f"{c}_norm": F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "artist", "album", "album_artist")})


def test_dedup_and_canon(spark):
    t = tracks(spark, [(1, "a", "x", None, 2010, 248, 2020, None, 0), (2, "a", "x", None, 2000, 251, 2024, True, 40), (3, "a", "y", None, 2000, 100, None, None, None), (4, "", "x", None, 1, 1, 2000, None, None), (5, "", "x", None, 1, 1, 2000, None, None), (6, "b", None, None, None, None, None, None, None), (7, "b", None, None, None, None, None, None, None)])
    rows = lambda **k: {r["id"]: r["canon_id"] for r in dedup.find_duplicates(t, **k).collect()}
    assert rows() == {1: None, 2: 1}
    assert rows(strategy="year") == {1: 2, 2: None}
    assert rows(sets=(("album",),)) == {}
    canon = dedup.find_duplicates(t).select("id", "canon_id")
    r = {x["root_id"]: x for x in dedup.group_rollup(t, canon).collect()}[1]
    assert (r["n_tracks"], r["rating"], r["loved"]) == (2, 40, True)


@pytest.mark.parametrize("limit", [400_000, 9])
def test_components_equal_union_find(spark, limit, monkeypatch):
    """In one task, and in several with rounds behind them."""
    monkeypatch.setattr(components, "LOCAL", limit)
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "y", "z", None]), None, rng.choice([None, 2000, 2001, 2002]), rng.randrange(100, 160), 2000 + i % 20, None, None) for i in range(60)]
    got = {r["id"]: r["component"] for r in dedup.find_duplicates(tracks(spark, rows)).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    for i, t, a, _, y, d, *_ in rows:
        b = 5 * round(d / 5)
        for key in (("s1", t, a, b), ("s2", t, a, y) if a or y else None, ("s3", t, None, b)):
            if key:
                j = seen.setdefault(key, i)
                x, z = sorted((find(i), find(j)))
                root[z] = x
    size = {}
    for i in root:
        size.setdefault(find(i), []).append(i)
    assert got == {i: r for r, m in size.items() if len(m) > 1 for i in m}


def test_flatten_and_cycles(spark):
    df = spark.createDataFrame([(i, i - 1 if i % 9 else None) for i in range(60)], "id long, canon_id long")
    assert {r["id"]: r["canon_id"] for r in dedup.flatten(df).collect()} == {i: i - i % 9 if i % 9 else None for i in range(60)}
    with pytest.raises(ValueError, match="cycle"):
        dedup.flatten(spark.createDataFrame([(1, 2), (2, 1)], "id long, canon_id long"))
    with pytest.raises(ValueError, match="cycle"):
        dedup.flatten(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, canon_id long"))


def test_main_files(spark):
    f = spark.createDataFrame([(1, 1, 320000, "mp3"), (2, 1, 320900, "flac"), (3, 2, None, "wav"), (4, 3, 999000, "mp3")], "id long, track_id long, bitrate int, ext string")
    canon = spark.createDataFrame([(3, 2)], "id long, canon_id long")
    assert {r["root_id"]: r["file_id"] for r in dedup.main_files(f, canon).collect()} == {1: 2, 2: 4}


def test_overrides_need_every_member(spark):
    t = tracks(spark, [(1, "a", None, None, None, 1, None, None, None), (2, "b", None, None, None, 1, None, None, None), (3, "c", None, None, None, 1, None, None, None)])
    h = {r["id"]: r["duplicate_hash"] for r in dedup.hashed(t).collect()}
    m = spark.createDataFrame([("g", h[1], h[2]), ("g", h[2], h[2]), ("k", h[3], h[1]), ("k", "gone", None)], "group_id string, member_hash string, canon_hash string")
    canon = spark.createDataFrame([(1, None), (2, 1), (3, None)], "id long, canon_id long")
    assert {r["id"]: r["canon_id"] for r in dedup.apply_overrides(canon, t, m).collect()} == {1: 2, 2: None, 3: None}


def merged(base, ours, theirs):
    want = {}
    for t in {*base, *ours, *theirs}:
        b, o, h = base.count(t), ours.count(t), theirs.count(t)
        want[t] = max(0, o + h - b) if base else max(o, h)
    out, left = [], dict(want)
    for side in (ours, theirs):
        seen = {}
        for t in side:
            seen[t] = seen.get(t, 0) + 1
            if side is ours and left[t] > 0 or side is theirs and seen[t] <= want[t] - min(ours.count(t), want[t]):
                out.append(t)
                left[t] -= 1
    return out


def test_merge_against_model(spark):
    rng = random.Random(2)
    cases = [([1, 2], [1, 1, 2], [1, 2]), ([1, 2], [1, 2], [1]), ([], [1, 1], [1, 2]), ([1, 2, 3], [1, 2, 3], [1, 3, 4])]
    cases += [tuple([rng.randrange(4) for _ in range(rng.randrange(5))] for _ in range(3)) for _ in range(150)]
    rows = [(p, s, pos, t) for p, c in enumerate(cases) for s, x in zip(("base", "ours", "theirs"), c, strict=True) for pos, t in enumerate(x, 1)]
    items = spark.createDataFrame(rows, "playlist_id long, side string, pos int, track_id long")
    got = {}
    for r in playlists.merge(items).orderBy("playlist_id", "position").collect():
        got.setdefault(r["playlist_id"], []).append(r["track_id"])
    for p, c in enumerate(cases):
        assert got.get(p, []) == merged(*c), c
    again = [(p, s, i, t) for p, x in got.items() for s in ("base", "ours", "theirs") for i, t in enumerate(x, 1)]
    same = playlists.merge(spark.createDataFrame(again, items.schema)).count()
    assert same == sum(map(len, got.values()))  # idempotent


def test_conflicts_and_operations(spark):
    s = spark.createDataFrame([(1, "a", 7, 1, 2), (1, "b", 7, 1, 0), (1, "a", 8, 1, 0), (2, "a", 7, 0, 1)], "playlist_id long, remote string, track_id long, base long, theirs long")
    assert [tuple(r) for r in playlists.conflicts(s).collect()] == [(1, 7, 2)]
    w = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "playlist_id long, ref string")
    h = spark.createDataFrame([(1, "x"), (1, "z"), (1, "y")], "playlist_id long, ref string")
    assert sorted((r["ref"], r["have"], r["want"]) for r in playlists.ref_operations(w, h).collect()) == [("x", 1, 2), ("z", 1, 0)]


def test_auto_fold_with_empty_bases_depends_on_order(spark):
    ours = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "playlist_id long, track_id long, copies long")
    s = spark.createDataFrame([(1, "a", 1, 0, 3), (1, "b", 2, 3, 1), (1, "b", 1, 0, 1)], "playlist_id long, remote string, track_id long, base long, theirs long")
    fold = lambda o: sorted((r["track_id"], r["copies"]) for r in playlists.resolve_auto(ours, s, o).collect())
    assert fold(["a", "b"]) == [(1, 4)] and fold(["b", "a"]) == [(1, 3)]


def test_inflated_list(spark):
    ids = ["a", "b", "a", "c"] + ["b"] * 191 + ["a"]
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate(ids)], "playlist_id long, track_id string, pos int")
    assert [(r["track_id"], r["position"]) for r in unify.list_without_repeats(df).orderBy("position").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_playlists_by_name(spark):
    day = lambda d: datetime(2020, 1, d)
    p = spark.createDataFrame([(1, "x", day(3)), (2, "x", day(2)), (3, "y", day(1)), (4, "z", None)], "playlist_id long, name string, created_at timestamp")
    i = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 1, 6), (2, 2, 6), (3, 1, 6), (3, 2, 5), (4, 1, 9)], "playlist_id long, pos int, track_id long")
    got = [(r["playlist_id"], r["position"], r["track_id"]) for r in unify.merge_playlists_by_name(p, i).collect()]
    assert sorted(got) == [(1, 1, 5), (1, 2, 5), (1, 3, 6), (4, 1, 9)]


def test_fuzzy_matches(spark):
    t = spark.createDataFrame([(1, "none shall pass radio edit", "aesop rock", "", "", None), (2, "clarity", "zedd", "", "", None), (3, "crickets in the rain", "q", "", "", None)], "id long, title_norm string, artist_norm string, album_artist_norm string, album_norm string, canon_id long")
    a = spark.createDataFrame([("k1", "none shall pass", "aesop rock", ""), ("k2", "clarity!", "zedd", ""), ("k3", "caught in the rain", "", ""), ("k4", "clarity", "nobody at all", ""), ("k5", "clarity", "", "")], "alias_key string, title_norm string, artist_norm string, album_norm string")
    assert {r["alias_key"]: r["track_id"] for r in match.match_fuzzy(a, t).collect()} == {"k1": 1, "k2": 2}
    assert {r["alias_key"]: r["track_id"] for r in match.match_exact(a, t).collect()} == {"k5": 2}


def test_scrobbles(spark):
    d = lambda h: datetime(2020, 1, 1, h)
    s = spark.createDataFrame([(1, d(1), "p", "t", None, ""), (2, d(1), "p", "u", "a", "b"), (3, d(2), "p", "u", "a", "b"), (4, d(1), "p", "t", "", None)], "id long, date timestamp, platform string, title string, artist string, album string")
    got = {r["date"].hour: r["title"] for r in history.fresh_scrobbles(s).collect()}
    assert got == {1: "t", 2: "u"}
    assert history.fresh_scrobbles(s, s.where("id = 3")).count() == 1


def test_artist_counted_once_for_each_role(spark):
    s = spark.createDataFrame([(1, 5, datetime(2020, 1, 1))], "root_id long, play_count long, last_play timestamp")
    al = spark.createDataFrame([(1, "x")], "root_id long, album string")
    r = spark.createDataFrame([("x", "q", "artist"), ("x", "q", "albumartist"), ("x", "q", "composer")], "album string, artist string, role string")
    assert history.artist_stats(s, al, r).first()["play_count"] == 10 and history.artist_stats(s, al, r, once=True).first()["play_count"] == 5


def test_sinks(spark):
    old = spark.createDataFrame([("a", None, 1, None), ("b", "x", None, 5)], "title string, artist string, year int, rating int")
    new = spark.createDataFrame([("a", None, 2, 7), ("c", None, 3, None), ("c", None, 3, None), ("b", "x", 9, 9)], old.schema)
    assert sinks.missing(old, new, ["title", "artist"]).count() == 1
    got = {r["title"]: (r["year"], r["rating"]) for r in sinks.fill_nulls(old, new, ["title", "artist"], ["year", "rating"]).collect()}
    assert got == {"a": (1, 7), "b": (9, 5)}
    assert sinks.upsert(old, new.dropDuplicates(), ["title", "artist"]).count() == 3
    f = spark.createDataFrame([(1, 1, "mp3"), (2, 1, "flac"), (3, 1, "mp3")], "id long, root_id long, ext string")
    t = tracks(spark, [(1, "song", "art", "alb", None, 1, None, None, None)]).withColumn("compilation", F.lit(False))
    plan = {r["file_id"]: r["target"] for r in sinks.file_plan(f, t, spark.createDataFrame([(1, 2)], "root_id long, file_id long")).collect()}
    assert plan == {1: "Copies/Music/art/alb/1-01 song.mp3", 2: "Library/Music/art/alb/1-01 song.flac", 3: "Copies/Music/art/alb/1-01 song 1.mp3"}
    items = spark.createDataFrame([(1, 5, 3)], "playlist_id long, track_id long, position int")
    more = spark.createDataFrame([(1, 8, 1), (1, 9, 2), (2, 9, 1)], "playlist_id long, track_id long, ord int")
    assert sorted(map(tuple, sinks.appended(items, more).collect())) == [(1, 8, 4), (1, 9, 5), (2, 9, 1)]


def test_keyed_sinks_stay_unique(spark):
    """Several incoming rows of a key neither repeat nor multiply a row; a plan is written only when it is committed."""
    old = spark.createDataFrame([(1, None, 5), (2, "b", None)], "id long, a string, n int")
    new = spark.createDataFrame([(1, "y", 7), (1, "x", None), (3, "z", 1), (3, "z", 2)], "id long, a string, n int")
    assert sorted(map(tuple, sinks.fill_nulls(old, new, ["id"], ["a", "n"]).collect())) == [(1, "x", 5), (2, "b", None)]
    assert sorted(map(tuple, sinks.upsert(old, new, ["id"]).collect())) == [(1, "y", 7), (2, "b", None), (3, "z", 2)]


def test_truncate_cascade(spark):
    t = spark.range(3)
    state = sinks.emptied({"a": t, "b": t, "c": t, "d": t}, "a", {"b": "a", "c": "b", "d": "x"})
    assert {n: x.count() for n, x in state.items()} == {"a": 0, "b": 0, "c": 0, "d": 3}


def test_bind_files_inside_longer_names(spark):
    """A path is found in the middle of another one: behind any root, before any ending, in any letter case."""
    kind = "id long, title string, artist string, album string, album_artist string, track_number int, disc_number int, compilation boolean"
    source = spark.createDataFrame([(1, "Song.mp3 x", "A", "B", None, 1, None, False), (2, "Song", "A", "B", None, 1, None, False), (3, "Song", "A", "B", None, 1, None, False)], kind)
    names = ["/r/A/B/01 Song.mp3", "/r/xa/b/01 SONG.M4A.bak", "/r/A/B/01 Song.mp3 x.m4a", "/r/A/C/01 Song.mp3", "A/B/01 Song 1.mp3/more", "/r/A/B/01 Song.flac"]
    files = spark.createDataFrame(list(enumerate(names)), "id long, source_path string")
    paths = [(r["id"], r["path"].lower()) for r in unify.candidate_paths(source).collect()]
    want = {i: min(x) for i, n in enumerate(names) if (x := [s for s, p in paths if p in n.lower()])}
    assert {r["file_id"]: r["source_id"] for r in unify.bind_files(source, files).collect()} == want and set(want) == {0, 1, 2, 4}


def test_bind_files_moves_no_paths(spark, monkeypatch):
    """Only keys, artists and ids are dealt out for the join, of tracks with the same paths one; a file without a folder above its album's binds to none."""
    kind = "id long, title string, artist string, album string, album_artist string, track_number int, disc_number int, compilation boolean"
    source = spark.createDataFrame([(i, "Song", "A", "B", None, 1, None, False) for i in range(9, 3, -1)], kind)
    files = spark.createDataFrame([(1, "/x a/b/01 song.mp3"), (2, "b/01 song.mp3"), (3, "c/b/01 song.mp3"), (4, "")], "id long, source_path string")
    seen = []
    monkeypatch.setattr(unify, "written", lambda df, name: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    assert [tuple(r) for r in unify.bind_files(source, files).collect()] == [(1, 4)]
    ends = files.select("id", F.explode(unify.ends(F.element_at(F.split("source_path", "/"), -1))).alias("e"))
    assert sorted(r["id"] for r in ends.collect()) == [1, 2, 3]
    assert "k1" in seen[0] and "source_low" not in seen[0] and "Contains(" not in seen[0].split("Join Inner")[0]


def test_bind_files_joins_without_broadcast(spark, sf, monkeypatch):
    """Tables that look small to Spark give many options of each track: neither side may go through the driver."""
    from tessitura.plans import catalogue

    seen = []
    monkeypatch.setattr(unify, "written", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    catalogue.bind_files(spark, sf)
    assert "SortMergeJoin" in seen[0] and "Broadcast" not in seen[0]


def test_overrides_are_dealt_by_number(spark, sf):
    """Stored decisions meet tracks in as many tasks as the session deals out, none of them by a broadcast; a group with an unknown member doesn't count, the last group of a track does."""
    t = spark.createDataFrame([(i, f"t{i}", "a", None, "b", 1, 1, 2000, 100) for i in range(6)], "id long, title string, artist string, album_artist string, album string, track_n int, disc_n int, year int, duration int")
    h = {r["id"]: r["duplicate_hash"] for r in dedup.hashed(t).collect()}
    told = [(1, h[0], h[1]), (1, h[1], h[1]), (2, h[2], h[3]), (2, "gone", h[3]), (3, h[4], "gone"), (4, h[0], None), (5, h[5], h[0])]
    canon = spark.createDataFrame([(0, None), (1, 0), (2, None), (3, 2), (4, 5), (5, None)], "id long, canon_id long")
    out = dedup.apply_overrides(canon, t, spark.createDataFrame(told, "group_id long, member_hash string, canon_hash string"))
    assert {r["id"]: r["canon_id"] for r in out.collect()} == {0: None, 1: None, 2: None, 3: 2, 4: 5, 5: 0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Broadcast" not in plan


def test_fold_by_name_equals_one_fold(spark):
    """Folding connected names apart gives what one fold over all lists gives."""
    rng = random.Random(5)
    lists = [(i, rng.choice("abcdefgh"), datetime(2020, 1, rng.randrange(1, 28)) if rng.random() > 0.2 else None) for i in range(60)]
    items = [(i, at, rng.randrange(4) + 10 * (ord(name) % 3)) for i, name, _ in lists for at in range(rng.randrange(1, 5))]
    import pandas as pd

    group = pd.DataFrame([(i, n, d, [t for j, _, t in items if j == i]) for i, n, d in lists], columns=["playlist_id", "name", "created_at", "tracks"])
    want = sorted(map(tuple, unify.fold_lists(group).itertuples(index=False)))
    p, m = spark.createDataFrame(lists, "playlist_id long, name string, created_at timestamp"), spark.createDataFrame(items, "playlist_id long, pos int, track_id long")
    assert sorted(map(tuple, unify.merge_playlists_by_name(p, m).collect())) == want


def test_fold_by_name_of_many_lists(spark):
    """A name's many lists take a few aggregations, no pass over all spans of them; skipped names move on one after another, null names count as one."""
    import pandas as pd

    day = datetime(2020, 1, 1)
    for seed in range(4):
        rng = random.Random(seed)
        lists = [(i, rng.choice([*"abcdefghijkl", None]), datetime(2020, 1, rng.randrange(1, 28)) if rng.random() > 0.2 else None) for i in range(80)]
        items = [(i, at, rng.choice([0, 1, 2])) for i, _, _ in lists for at in range(rng.randrange(1, 3 + seed))]
        if seed == 0:  # a chain: each name is skipped by what the one before holds
            lists = [(i, f"n{i // 2}", day) for i in range(60)]
            items = [(i, 0, (i + 1) // 2) for i in range(60)]
        group = pd.DataFrame([(i, n, d, [t for j, _, t in items if j == i]) for i, n, d in lists], columns=["playlist_id", "name", "created_at", "tracks"])
        group["created_at"] = pd.to_datetime(group["created_at"])
        group["name"] = [n for _, n, _ in lists]
        key = lambda r: (r[0], r[2])
        want = sorted(((a, n if isinstance(n, str) else None, p, t) for a, n, p, t in unify.fold_lists(group).itertuples(index=False)), key=key)
        p, m = spark.createDataFrame(lists, "playlist_id long, name string, created_at timestamp"), spark.createDataFrame(items, "playlist_id long, pos int, track_id long")
        assert sorted(map(tuple, unify.merge_playlists_by_name(p, m).collect()), key=key) == want
    m = spark.range(0, 120_000).select((F.col("id") % 20_000).alias("playlist_id"), F.floor(F.col("id") / 20_000).cast("int").alias("pos"), (F.xxhash64("id") % 9).alias("track_id"))
    p = m.select("playlist_id").distinct().select("playlist_id", F.concat(F.lit("n"), F.col("playlist_id") % 2).alias("name"), F.timestamp_seconds(F.col("playlist_id") % 97).alias("created_at"))
    assert unify.merge_playlists_by_name(p, m).select("name").distinct().count() == 2


def test_fuzzy_matches_in_shards(spark, monkeypatch):
    """Tracks of the alias's own artist and album settle it without pairs of all titles; the rest, and any number of shards, give what all pairs give."""
    rng = random.Random(3)
    word = lambda: rng.choice(["large", "old", "cold", "blue", "ring", "bolt", "ringbolt", "x", "!"])
    title, name = lambda: " ".join(word() for _ in range(rng.randrange(1, 4))) + f" {rng.randrange(30)}", lambda: rng.choice(["", "a b", "b a", "cc", "ccd", "?"])
    t = spark.createDataFrame([(i, title(), name(), name(), name()) for i in range(400)], "id long, title_norm string, artist_norm string, album_artist_norm string, album_norm string")
    a = spark.createDataFrame([(f"k{i % 140}", title()[rng.randrange(3) :], name(), name()) for i in range(150)], "alias_key string, title_norm string, artist_norm string, album_norm string")
    rows = a.where("artist_norm <> '' and title_norm <> ''").select("alias_key", F.col("title_norm").alias("a"), F.col("artist_norm").alias("a_artist"), F.col("album_norm").alias("a_album"))
    want = {r["alias_key"]: (r["k"]["id"], -r["k"]["a"]) for r in match._match_all(rows, t).collect() if -r["k"]["a"] >= match.THRESHOLD}
    for shard, block in ((100_000, 200_000), (7, 5)):
        monkeypatch.setattr(match, "SHARD", shard)
        monkeypatch.setattr(match, "BLOCK", block)
        assert {r["alias_key"]: (r["track_id"], r["score"]) for r in match.match_fuzzy(a, t).collect()} == want
    monkeypatch.setattr(match, "title_pairs", lambda *_: 1 / 0)
    own = t.where("artist_norm in ('cc', 'ccd') and title_norm not like '!%'").select(F.col("id").cast("string").alias("alias_key"), "title_norm", "artist_norm", F.lit("").alias("album_norm"))
    got = match.match_fuzzy(own, t).collect()
    assert len(got) == own.count() > 50 and {r["score"] for r in got} == {0.875}


@pytest.mark.parametrize("threshold,shard", [(0.4, 100_000), (0.26, 11)])
def test_bounded_matches_equal_all_pairs(spark, monkeypatch, threshold, shard):
    """Falling bounds of the artist's similarity give what the comparison of all pairs gives: misspelt, unlike and blank names, titles within others, ties."""
    rng = random.Random(9)
    word = lambda: rng.choice(["large", "old", "cold", "blue", "ring", "bolt", "ringbolt", "x", "!", "é"])
    title = lambda: " ".join(word() for _ in range(rng.randrange(1, 5)))
    names = ["", "?", "the long name", "the lng name", "the long names", "other band", "othr band", "band", "ab", "a b", "quite different"]
    t = spark.createDataFrame([(i, title(), rng.choice(names), rng.choice(["", None, *names]), rng.choice(names)) for i in range(300)], "id long, title_norm string, artist_norm string, album_artist_norm string, album_norm string")
    a = spark.createDataFrame([(f"k{i % 190}", title()[rng.randrange(2) :], rng.choice(names) + rng.choice(["", "s", " q"]), rng.choice(names)) for i in range(200)], "alias_key string, title_norm string, artist_norm string, album_norm string")
    rows = a.where("artist_norm <> '' and title_norm <> ''").select("alias_key", F.col("title_norm").alias("a"), F.col("artist_norm").alias("a_artist"), F.col("album_norm").alias("a_album"))
    want = {r["alias_key"]: (r["k"]["id"], -r["k"]["a"]) for r in match._match_all(rows, t).collect() if -r["k"]["a"] >= threshold}
    monkeypatch.setattr(match, "SHARD", shard)
    monkeypatch.setattr(match, "BLOCK", shard)
    if threshold > 0.25:
        monkeypatch.setattr(match, "title_pairs", lambda *_: 1 / 0)
        monkeypatch.setattr(match, "ROUNDS", (1.1,))  # nothing is settled beforehand
    got = {r["alias_key"]: (r["track_id"], r["score"]) for r in match.match_fuzzy(a, t, threshold).collect()}
    assert got == want and len(got) > 20


@pytest.mark.parametrize("settled", [True, False])
def test_nearest_artist_comes_first(spark, monkeypatch, settled):
    """Misspelt artists' aliases with a similar title and their own album are settled by the nearest name alone; the others, ties among names and blank albums included, as all pairs would."""
    rng = random.Random(4)
    word = lambda: rng.choice(["large", "old", "cold", "blue", "ring", "bolt", "ringbolt", "seven", "winter"])
    rows = [(i, " ".join([word(), word(), word(), str(i)]), rng.choice(["the long name", "other band"]), rng.choice(["", "the long names", "quite different"]), rng.choice(["", "one", "two", "three four"])) for i in range(200)]
    t = spark.createDataFrame(rows, "id long, title_norm string, artist_norm string, album_artist_norm string, album_norm string")
    wrong = [(f"k{r[0]}", r[1] if settled else r[1][rng.randrange(12) :], r[2].replace("a", "", 1), r[4] if settled else rng.choice(["", r[4], "one"])) for r in rows if r[0] % 3 == 0]
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(wrong)], "ref long, alias_key string, a string, a_artist string, a_album string")
    want = {r["alias_key"]: (r["k"]["id"], -r["k"]["a"]) for r in match._match_all(a.drop("ref"), t).collect() if -r["k"]["a"] >= 0.4}
    if settled:
        monkeypatch.setattr(match, "_best_by_score", lambda aliases, tracks: 1 / 0)
    got = {f"k{wrong[r['ref']][0][1:]}": (r["id"], r["score"]) for r in match.bounded_matches(a, t, 0.4).collect()}
    assert got == want and len(got) > 40


def test_merge_moves_rows_once(spark):
    """A merge is one shuffle of the items, whatever it compares them by; lists without a base keep the larger number, null tracks go."""
    rows = [(1, "base", 7, 1), (1, "ours", 7, 1), (1, "ours", 8, 2), (1, "theirs", 9, 1), (1, "ours", None, 3), (2, "ours", 5, 1), (2, "theirs", 5, 1), (2, "theirs", 5, 2), (None, "ours", 1, 1)]
    items = spark.createDataFrame(rows, "playlist_id long, side string, track_id long, pos long")
    merged = playlists.merge(items)
    assert merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1
    assert sorted(map(tuple, merged.collect())) == [(1, 1, 8), (1, 2, 9), (2, 1, 5), (2, 2, 5)]


def test_items_are_placed_with_one_shuffle_of_the_join(spark, sf):
    """The places on all sides come from one sort of the rows, not from one of a row for each side."""
    plan = V.playlist_item_v(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window [")
    assert "Window [" not in V.playlist_item_v(spark, sf).drop("pos")._jdf.queryExecution().optimizedPlan().toString()


def test_conflicts_hold_one_track_at_a_time(spark):
    """Only tracks in conflict are aggregated; a remote's repeated rows count once, null keys are one group."""
    rows = [(1, "a", 7, 1, 2), (1, "b", 7, 1, 0), (1, "b", 7, 1, 0), (1, "c", 7, 1, 1), (1, "a", 8, 0, 1), (1, "b", 8, 0, 1), (None, "a", None, 0, 1), (None, "b", None, 1, 0)]
    found = playlists.conflicts(spark.createDataFrame(rows, "playlist_id long, remote string, track_id long, base long, theirs long"))
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 7, 3), (None, None, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter") < plan.index("Window")
