"""Row numbers within groups, by windows and over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import ranked, sinks


@pytest.mark.parametrize("large", [10**6, 50, 0])
def test_numbers(spark, monkeypatch, large):
    monkeypatch.setattr(ranked, "LARGE", large)
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), None if i == 5 else i * 7919 % 1000, f"x{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, v string").repartition(7)
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        want += [(*r, i + 1) for i, r in enumerate(own)]
    out = ranked.numbered(df, ["g"], ["o"], "n")
    assert out.columns == ["g", "o", "v", "n"] and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert sorted(r["n"] for r in ranked.numbered(df, [], ["g", "o"], "n").collect()) == list(range(1, 901))
    assert ranked.numbered(df.limit(0), ["g"], ["o"], "n").count() == 0 and ranked.numbered(df.limit(0), [], ["o"], "n").count() == 0


def test_one_group_is_many_tasks(spark, monkeypatch):
    """All rows in one group: no partition numbers more than a part of them."""
    monkeypatch.setattr(ranked, "LARGE", 1000)
    n = 40_000
    df = spark.range(n).select(F.lit("one").alias("g"), (F.col("id") * 7919 % n).alias("o"))
    out = ranked.numbered(df, ["g"], ["o"], "n")
    assert out.where(F.col("n") != F.col("o") + 1).count() == 0 and out.count() == n
    most = ranked.over_ranges(df, ["g"], ["o"], "n").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= n  # the join may coalesce; what is numbered lies in ranges
    items = spark.createDataFrame([("one", 5, 3)], "playlist_id string, track_id long, position int")
    more = df.select(F.col("g").alias("playlist_id"), F.col("o").alias("track_id"), F.col("o").alias("ord"))
    got = sinks.appended(items, more)
    assert got.where(F.col("position") != F.col("track_id") + 4).count() == 0 and got.count() == n
