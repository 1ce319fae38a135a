"""Domain views: deterministic projections that let the driver's tables stand in for a music library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.plans.scratch import partitions
from tessitura.session import spread, table

RUN_TS = 1_600_000_000  # the time that is passed to operators as "now"


def _int(c: Column) -> Column:
    return c.cast("int")


def track_v(spark: SparkSession, sf: str) -> DataFrame:
    p = spread(table(spark, sf, "part"))
    k, size = F.col("p_partkey"), F.col("p_size")
    base = F.concat(F.col("p_name"), F.lit(" vol "), F.floor(k / 100).cast("long").cast("string"))
    title = F.when(k % 5 == 0, F.concat(base, F.lit(" (Remastered)"))).when(k % 5 == 1, F.concat(base, F.lit(" - Single"))).when(k % 5 == 2, F.upper(base)).otherwise(base)
    by_size = F.concat(F.lit("artist "), (size % 3).cast("string"))
    return p.select(
        k.alias("id"), title.alias("title"), F.when(k % 11 != 0, by_size).alias("artist"), F.when(k % 3 == 0, by_size).alias("album_artist"),
        F.col("p_type").alias("album"), _int(size).alias("track_n"), _int(1 + k % 2).alias("disc_n"), F.when(k % 7 != 0, _int(1990 + size % 8)).alias("year"),
        _int(120 + (k * 37) % 40).alias("duration"), F.timestamp_seconds(1262304000 + ((k * 7919) % 3650) * 86400).alias("date_added"),
        F.when(k % 9 == 0, True).when(k % 9 == 1, False).alias("loved"), F.when(k % 4 != 0, _int((k % 6) * 20)).alias("rating"),
    )


def file_v(spark: SparkSession, sf: str, by_track: bool = False) -> DataFrame:
    """``by_track``: files of tracks only, dealt by track for what comes together by track next; few rows are of one file, so hardly more of them move."""
    li = table(spark, sf, "lineitem")
    li = (li.where("l_partkey is not null").repartition(partitions(spark), "l_partkey") if by_track else li).groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first_order"))
    s = F.col("l_suppkey")
    ext = F.when(s % 5 == 0, "flac").when(s % 5 == 1, "m4a").when(s % 5 == 2, "wav").otherwise("mp3")
    return li.select((F.col("l_partkey") * 100000 + s).alias("id"), F.col("l_partkey").alias("track_id"), _int(128000 + (s % 4) * 64000).alias("bitrate"), ext.alias("ext"), "first_order")


def scrobble_v(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    t = track_v(spark, sf).select(F.col("id").alias("user_id"), "title", "artist", "album")
    kind = F.col("event_type")
    platform = F.when(kind == "click", "spotify").when(kind == "view", "lastfm").when(kind == "purchase", "apple_ms").otherwise("listenbrainz")
    return e.join(t, "user_id").select(
        F.col("event_id").alias("id"), F.date_trunc("hour", "ts").alias("date"), platform.alias("platform"), "title",
        F.when(kind.isin("purchase", "error"), "").otherwise(F.coalesce("artist", F.lit(""))).alias("artist"), F.when(kind.isin("view", "error"), "").otherwise(F.col("album")).alias("album"),
    )


def playlist_item_v(spark: SparkSession, sf: str, side: str | None = None) -> DataFrame:
    """Items of all sides, or of one: then only the rows that are on it move."""
    j = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    c = F.col("o_custkey")
    on = {"base": (F.col("l_returnflag") != "R") & (c % 10 != 0), "ours": F.col("l_linestatus") == "F", "theirs": F.col("l_quantity") > 20}
    rows = j.withColumn("track_id", F.col("l_partkey") % 20)
    order = ["l_orderkey", "l_linenumber", "track_id", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    if side:
        pos = F.row_number().over(W.partitionBy("o_custkey").orderBy(*order))
        return rows.where(on[side]).select(c.alias("playlist_id"), F.lit(side).alias("side"), "track_id", pos.alias("pos"))
    # each row moves and is sorted once, not once for each side that it is on; its place on a side is a running count
    before = W.partitionBy("o_custkey").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select(c, "track_id", *order[:2], *order[3:], *[x.alias(f"on_{n}") for n, x in on.items()])
    rows = rows.select("o_custkey", "track_id", *[f"on_{n}" for n in on], *[F.count_if(f"on_{n}").over(before).cast("int").alias(n) for n in on])
    sides = F.explode(F.filter(F.array(*[F.when(F.col(f"on_{n}"), n) for n in on]), lambda x: x.isNotNull()))  # not by place, so that who needs none sorts none
    rows = rows.select(c.alias("playlist_id"), "track_id", *on, sides.alias("side"))
    return rows.select("playlist_id", "side", "track_id", F.coalesce(*[F.when(F.col("side") == n, F.col(n)) for n in on]).alias("pos"))


def source_track_v(spark: SparkSession, sf: str) -> DataFrame:
    t = track_v(spark, sf).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    i, k = F.col("id"), F.col("k")
    return t.select(
        (i * 2 + k).alias("id"), F.when(k == 0, "apple_xml").otherwise("apple_ms").alias("provider"), i.alias("source_id"), "title", "artist", "album", "album_artist",
        F.when((k == 0) | (i % 4 != 0), F.col("track_n")).alias("track_number"), F.when((k == 1) | (i % 6 != 0), F.col("disc_n")).alias("disc_number"),
        F.when((k == 1) | (i % 3 != 0), F.col("year")).alias("year"), _int(F.when(i % 17 == 0, 0).otherwise(F.col("duration") * 1000 + (i % 2) * 500)).alias("duration_ms"),
        (i % 13 == 0).alias("compilation"), "loved", "rating", (i % 10 == 0).alias("rating_computed"), F.when((k == 1) | (i % 5 != 0), F.col("date_added")).alias("date_added"),
    )


def alias_v(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (title, artist, album) of the scrobbles with the title's fourth character dropped; the triple is the key."""
    typo = F.concat(F.substring("title", 1, 3), F.substr(F.col("title"), F.lit(5)))
    return scrobble_v(spark, sf).select(typo.alias("title"), "artist", "album").distinct()


TRACK = """track_v AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN base || ' (Remastered)' WHEN 1 THEN base || ' - Single' WHEN 2 THEN upper(base) ELSE base END AS title,
  CASE WHEN p_partkey % 11 <> 0 THEN 'artist ' || (p_size % 3) END AS artist, CASE WHEN p_partkey % 3 = 0 THEN 'artist ' || (p_size % 3) END AS album_artist, p_type AS album,
  CAST(p_size AS INT) AS track_n, CAST(1 + p_partkey % 2 AS INT) AS disc_n, CASE WHEN p_partkey % 7 <> 0 THEN CAST(1990 + p_size % 8 AS INT) END AS year,
  CAST(120 + (p_partkey * 37) % 40 AS INT) AS duration, make_timestamp((1262304000 + ((p_partkey * 7919) % 3650) * 86400) * 1000000) AS date_added,
  CASE p_partkey % 9 WHEN 0 THEN true WHEN 1 THEN false END AS loved, CASE WHEN p_partkey % 4 <> 0 THEN CAST((p_partkey % 6) * 20 AS INT) END AS rating
  FROM (SELECT *, p_name || ' vol ' || CAST(floor(p_partkey / 100.0) AS BIGINT) AS base FROM part))"""
FILE = """file_v AS (SELECT l_partkey * 100000 + l_suppkey AS id, l_partkey AS track_id, CAST(128000 + (l_suppkey % 4) * 64000 AS INT) AS bitrate,
  CASE l_suppkey % 5 WHEN 0 THEN 'flac' WHEN 1 THEN 'm4a' WHEN 2 THEN 'wav' ELSE 'mp3' END AS ext, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey, l_suppkey)"""
SCROBBLE = """scrobble_v AS (SELECT event_id AS id, date_trunc('hour', ts)::TIMESTAMP AS date, CASE event_type WHEN 'click' THEN 'spotify' WHEN 'view' THEN 'lastfm' WHEN 'purchase' THEN 'apple_ms' ELSE 'listenbrainz' END AS platform,
  title, CASE WHEN event_type IN ('purchase', 'error') THEN '' ELSE coalesce(artist, '') END AS artist, CASE WHEN event_type IN ('view', 'error') THEN '' ELSE album END AS album
  FROM events JOIN track_v ON track_v.id = user_id)"""
ITEM = """item_v AS (SELECT playlist_id, side, track_id, row_number() OVER (PARTITION BY playlist_id, side ORDER BY l_orderkey, l_linenumber, track_id, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS pos FROM (
  SELECT o_custkey AS playlist_id, l_partkey % 20 AS track_id, unnest(list_filter([CASE WHEN l_returnflag <> 'R' AND o_custkey % 10 <> 0 THEN 'base' END, CASE WHEN l_linestatus = 'F' THEN 'ours' END, CASE WHEN l_quantity > 20 THEN 'theirs' END], lambda x: x IS NOT NULL)) AS side, lineitem.*
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey))"""
SOURCE = """source_v AS (SELECT id * 2 + k AS id, CASE k WHEN 0 THEN 'apple_xml' ELSE 'apple_ms' END AS provider, id AS source_id, title, artist, album, album_artist,
  CASE WHEN k = 0 OR id % 4 <> 0 THEN track_n END AS track_number, CASE WHEN k = 1 OR id % 6 <> 0 THEN disc_n END AS disc_number, CASE WHEN k = 1 OR id % 3 <> 0 THEN year END AS year,
  CAST(CASE WHEN id % 17 = 0 THEN 0 ELSE duration * 1000 + (id % 2) * 500 END AS INT) AS duration_ms, id % 13 = 0 AS compilation, loved, rating, id % 10 = 0 AS rating_computed,
  CASE WHEN k = 1 OR id % 5 <> 0 THEN date_added END AS date_added FROM track_v, (SELECT unnest([0, 1]) AS k))"""
ALIAS = """alias_v AS (SELECT DISTINCT title[1:3] || title[5:] AS title, artist, album FROM scrobble_v)"""
