"""Queries over streams: files are written from the driver's tables into the shared folder, and streams with keyed state read them, stopped midway and started again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.plans import views as V
from tessitura.plans.scratch import shared_dir, written
from tessitura.plans.views import ITEM, SCROBBLE, TRACK
from tessitura.streaming import keyed

SIDES = ("base", "ours", "theirs")  # versions 1 to 3 of a list
PARTS = 3  # files of scrobbles, in order of id


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, folder: str, schema: str, make) -> None:
    keyed.append(make(keyed.watch(spark, f"{folder}/in", schema)), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()


def stream_list_changes(spark, sf):
    """What three snapshots of every list change, one after the other; the stream is started anew for the third, and the second comes again with it."""
    items = written(V.playlist_item_v(spark, sf).groupBy("playlist_id", "side", "track_id").agg(F.count("*").alias("n")), "counts")
    version = F.array_position(F.array(*map(F.lit, SIDES)), F.col("side"))
    rows = items.select("playlist_id", F.lit("server").alias("remote"), version.cast("long").alias("version"), "track_id", "n")
    heads = items.select("playlist_id").distinct().select("playlist_id", F.lit("server").alias("remote"), F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 2, 3)])).alias("version"), F.lit(None).cast("long").alias("track_id"), F.lit(0).cast("long").alias("n"))
    # all rows of a list's snapshot are in one file
    snapshots, folder = rows.union(heads).repartition("playlist_id"), _folder(spark)
    snapshots.where("version < 3").write.mode("append").parquet(f"{folder}/in")
    make = lambda s: keyed.list_changes(s, shares=2)
    _run(spark, folder, keyed.SNAPSHOT, make)
    snapshots.where("version > 1").write.mode("append").parquet(f"{folder}/in")
    _run(spark, folder, keyed.SNAPSHOT, make)
    return spark.read.schema(keyed.CHANGE).parquet(f"{folder}/out")


def stream_dates(spark, sf):
    """The scrobble that takes each date, from a stream that is stopped after the first part and started anew for all others and the first once more."""
    s = V.scrobble_v(spark, sf)
    rows, folder = s.select("id", "date", "platform", "title", "artist", "album"), _folder(spark)
    part = F.col("id") % PARTS  # an earlier part has the smaller numbers
    numbered = rows.withColumn("id", part * 1_000_000_000_000 + F.col("id"))
    of = lambda i: numbered.where((F.col("id") >= i * 1_000_000_000_000) & (F.col("id") < (i + 1) * 1_000_000_000_000))
    for parts in ((0,), (1, 0), (2,)):
        for i in parts:
            of(i).write.mode("append").parquet(f"{folder}/in")
        _run(spark, folder, keyed.SCROBBLE, keyed.first_of_dates)
    return spark.read.schema(keyed.SCROBBLE).parquet(f"{folder}/out")


SQL = {
    "stream_list_changes": f"""WITH {ITEM}, n AS (SELECT playlist_id, track_id, list_position({list(SIDES)}, side) AS version, count(*) AS n FROM item_v GROUP BY ALL),
      g AS (SELECT playlist_id, track_id, v AS version FROM (SELECT DISTINCT playlist_id, track_id FROM n), (SELECT unnest([1, 2, 3]) AS v)),
      c AS (SELECT playlist_id, version, track_id, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (playlist_id, track_id, version))
      SELECT playlist_id, 'server' AS remote, CAST(version AS BIGINT) AS version, track_id, n - lag(n, 1, 0) OVER (PARTITION BY playlist_id, track_id ORDER BY version) AS change FROM c QUALIFY change <> 0""",
    "stream_dates": f"""WITH {TRACK}, {SCROBBLE}, s AS (SELECT id % {PARTS} * 1000000000000 + id AS id, date, platform, title, artist, album FROM scrobble_v WHERE date IS NOT NULL)
      SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY date ORDER BY id) = 1""",
}

QUERIES = (stream_list_changes, stream_dates)
