"""Text functions: goldens and hazards."""

import re
import unicodedata

from pyspark.sql import functions as F

from tessitura.functions import text as X


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def plain(v):
    if not v:
        return ""
    for p in X.DECORATIONS:
        v = re.sub(p, "", v, flags=re.IGNORECASE)
    v = v.replace("/", " ").replace("\\", " ")
    for ch in X.PUNCTUATION:
        if len(v) < 2:
            break
        v = v.replace(ch, "")
    v = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v).strip()).lower()
    return v.replace("ё", "e").replace("é", "e")


def test_normalize_name(spark):
    names = [None, "", "-", "…", "(Live) (feat. X)", "Song (Explicit)", "Album [2001]", "Album - EP", "01. Song", "12 - Song", "|3| Song", "A/B\\C", "Ёлка É", "Ｆｕｌｌ  width", "Song (2011 Remaster) (explicit)", "Альбом (Переиздание)", "x (Deluxe Edition)", " pad ", "’‘quotes", "K (from the Motion Picture)", "a feat. b", "Don't-Stop…", "ﬁn", "line\nbreak (explicit)\n"]
    assert apply(spark, X.normalize_name, names) == [plain(n) for n in names]


def test_similarity_goldens(spark):
    cases = [("none shall pass", "none shall pass radio edit", 16 / 27), ("clarity!", "clarity", 1.0), ("mediate", "meditate", 6 / 11), ("crickets in the rain", "caught in the rain", 12 / 26), ("slowthai", "tyler the creator", 0.0), ("", "a", 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r["s"] for r in df.select("i", X.similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert all(abs(g - w) < 1e-6 for g, (_, _, w) in zip(got, cases, strict=True))


def test_float4_boundaries(spark):
    """9/20 as a 4-byte float is below 0.45; 3/10 is above 0.3."""
    r = spark.range(1).select((F.lit(9 / 20).cast("float").cast("double") >= 0.45).alias("a"), (F.lit(3 / 10).cast("float").cast("double") >= 0.3).alias("b")).first()
    assert (r["a"], r["b"]) == (False, True)


def test_buckets_and_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (247, 248, 251, 253, 255)], "d int")
    assert [r[0] for r in df.select(X.duration_bucket(F.col("d"))).collect()] == [245, 250, 250, 255, 255]
    df = spark.createDataFrame([(500,), (1500,), (2500,), (0,), (None,)], "ms int")
    assert [r[0] for r in df.select(X.half_even_seconds(F.col("ms"))).collect()] == [0, 2, 2, None, None]


def test_paths(spark):
    part = lambda c: X.path_part(c, 10)
    assert apply(spark, part, ["AC/DC", ".hidden", "dots.", "   ", "", None, "a long name of one", 'q"?*']) == ["AC_DC", "_hidden", "dots_", "_", "_", "_", "a long nam", "q___"]
    one = spark.range(1).select(X.library_path(F.lit("A"), F.lit("B."), F.lit("T" * 50), F.lit("mp3"), F.lit(7), F.lit(2), F.lit(1), F.lit(20)).alias("p")).first()["p"]
    assert one == "A/B_/2-07 TTTTTTTTT 1.mp3"


def test_labels(spark):
    r = spark.range(1).select(X.alias_label(F.lit("t"), F.lit(None), F.lit("b")).alias("a"), X.server_path(F.lit("Library/x")).alias("s"), X.server_path(F.lit("a/Library/x")).alias("s2"), X.minutes(F.lit(3725.9)).alias("m"), X.masked_dsn(F.lit("pg://u:p@h/db")).alias("d"), X.playlist_comment(F.lit("apple"), F.lit(""), F.lit("hi")).alias("c"), X.group_label(F.lit(""), F.lit("x")).alias("g")).first()
    assert tuple(r) == ("[t /  / b]", "x", "a/Library/x", "62:05", "pg://h/db", "apple\nhi", "? — x")
