"""Keyed streams: restarts, rows that come again, empty and shared lists, and dates that the watermark lets go of."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

from tessitura.streaming import keyed


@pytest.fixture
def run(spark, tmp_path):
    """Write rows as one more file of the input, run the stream to its end, and give back all it has ever written."""

    def go(make, schema, rows, name="s"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
        keyed.append(make(keyed.watch(spark, f"{tmp_path}/{name}-in", schema, 1)), f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-checkpoint").awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}-out").collect()), key=repr)

    return go


def snapshot(version, tracks, playlist=1, remote="a"):
    return [(playlist, remote, version, None, 0)] + [(playlist, remote, version, t, n) for t, n in Counter(tracks).items()]


@pytest.mark.parametrize("shares", [1, 5])
def test_changes_survive_restarts(run, shares):
    lists = {1: [7, 7, 8, 9], 2: [], 3: [9, 8, 8], 4: list(range(40)), 5: [3]}
    make = lambda s: keyed.list_changes(s, shares)
    files = [snapshot(1, lists[1]) + snapshot(1, [5], 2) + [(None, "a", 1, 4, 1), (1, "a", None, 4, 1)], snapshot(2, lists[2]) + snapshot(3, lists[3]), snapshot(2, [1, 2, 3]) + snapshot(3, [6]), snapshot(4, lists[4]) + snapshot(5, lists[5])]
    for f in files:  # each in a run of its own; the third brings old versions only
        got = run(make, keyed.SNAPSHOT, f)
    want, had = [(2, "a", 1, 5, 1)], Counter()
    for v, tracks in lists.items():
        now = Counter(tracks)
        want += [(1, "a", v, t, now[t] - had[t]) for t in now | had if now[t] != had[t]]
        had = now
    assert got == sorted(want, key=repr)


def test_dates_are_taken_once(run):
    day, row = datetime(2024, 1, 1), lambda i, d: (i, d, "p", f"t{i}", None, "")
    files = [[row(5, day), row(3, day), row(4, None)], [row(1, day), row(9, day + timedelta(hours=1))], [row(2, day - timedelta(days=900))]]
    for f in files:
        got = run(keyed.first_of_dates, keyed.SCROBBLE, f)
    assert sorted(r[0] for r in got) == [2, 3, 9]


def test_watermark_lets_go_of_dates(run):
    day, row = datetime(2024, 1, 1), lambda i, d: (i, d, "p", "t", "", "")
    for f in ([row(1, day)], [row(2, day), row(3, day + timedelta(days=90))], [row(4, day + timedelta(days=90)), row(5, day)], [row(6, day + timedelta(days=91))]):
        got = run(lambda s: keyed.first_of_dates(s, "30 days"), keyed.SCROBBLE, f)
    assert sorted(r[0] for r in got) == [1, 3, 6]


def test_many_lists_share_a_state(spark, run, tmp_path):
    """There is a state, and a call of Python, for each of ``tables``, however many lists there are; large ids and lists that don't come again stay as they are."""
    big = 2**60 + 1
    make = lambda s: keyed.list_changes(s, 1, 3)
    run(make, keyed.SNAPSHOT, [r for p in range(500) for r in snapshot(1, [p, big], p)])
    spark.createDataFrame([r for p in range(0, 500, 2) for r in snapshot(2, [p], p)], keyed.SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/s-in")
    stream = keyed.append(make(keyed.watch(spark, f"{tmp_path}/s-in", keyed.SNAPSHOT, 1)), f"{tmp_path}/s-out", f"{tmp_path}/s-checkpoint")
    stream.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress) <= 3
    last = run(make, keyed.SNAPSHOT, [r for p in range(1, 500, 2) for r in snapshot(3, [big], p)] + snapshot(4, [], 8))
    want = [(p, "a", 2, big, -1) for p in range(0, 500, 2)] + [(p, "a", 3, p, -1) for p in range(1, 500, 2)] + [(8, "a", 4, 8, -1)]
    assert [r for r in last if r[2] > 1] == sorted(want, key=repr)
