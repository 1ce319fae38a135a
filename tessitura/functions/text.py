"""Text functions: comparison names, trigrams, paths, hashes and labels. All but the optional NFKC step stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is deleted from a name, in this order.
DECORATIONS = [
    r"\[\d{4}\]$",
    r"\s+\-\s+ep$",
    r"\s+ep$",
    r"\s+\-\s+single$",
    r"\(.*?feat\..*?\)",
    r"\(.*?ft\s+.*?\)",
    r"\[.*?feat\..*?\]",
    r"\(bonus track\)",
    r"\(.*?remastered.*?\)",
    r"feat\. .*?$",
    r"\(explicit\)$",
    r"\[re-recorded\]$",
    r"\(re-recorded\)$",
    r"\(переиздание\)$",
    r"\(золотое издание\)$",
    r"\(.*?edition\)$",
    r"\- remaster$",
    r"\- re-recorded$",
    r"\(.*?remaster\)$",
    r"\[.*?remaster\]$",
    r"\(.*?version.*?\)$",
    r"\(.*?deluxe.*?\)$",
    r"\[.*?deluxe.*?\]$",
    r"\(.*?motion picture.*?\)$",
    r"\(.*?extended play.*?\)$",
    r"\(.*?from.*?\)$",
    r"\(.*?soundtrack.*?\)$",
    r"^\d+\.\s+",
    r"^\d+\s+\-\s+",
    r"^\|\d+\|\s+",
    "collectors edition",
]
#: What every one of them needs somewhere: a name without it goes through one pattern instead of all.
DECORATED = r"(?iuUd)[\[(|-]|\s+ep$|feat\. |^\d|collectors edition"
# Characters deleted from names, and characters replaced in path parts.
PUNCTUATION = "-–,.:\"*[]()'’‘…►™"
UNSAFE = '*<>:"/\\|?’“”'
SIMILAR = 0.3  # the trigram index's own threshold


@F.pandas_udf(T.StringType())
def _nfkc(names):
    import unicodedata

    return names.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def normalize_name(name: Column, nfkc: bool = True) -> Column:
    """The comparison form of a name; '' for null. ``nfkc=False`` leaves out the one step that needs Python (no change for ASCII)."""
    plain = F.coalesce(name, F.lit(""))
    c = plain
    for pattern in DECORATIONS:
        c = F.regexp_replace(c, f"(?iuUd){pattern}", "")
    c = F.when(plain.rlike(DECORATED), c).otherwise(plain)
    c = F.translate(c, "/\\", "  ")
    # one at a time, each only while two characters are left
    chars = F.array(*[F.lit(x) for x in PUNCTUATION])
    c = F.aggregate(chars, c, lambda acc, x: F.when(F.length(acc) < 2, acc).otherwise(F.replace(acc, x, F.lit(""))))
    if nfkc:
        c = _nfkc(c)
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.translate(F.lower(c), "ёé", "ee")


def renormalized(df: DataFrame, fields: tuple[str, ...] = ("title", "artist", "album", "album_artist"), nfkc: bool = True) -> DataFrame:
    """``df`` with every comparison form (``<field>_norm``) worked out anew from its name, for the fields that it has."""
    own = {f"{f}_norm": normalize_name(F.col(f), nfkc) for f in fields if f in df.columns}
    return df.withColumns(own)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each word with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def gram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram arrays, as a 4-byte float; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared)).cast("float")


def similarity(a: Column, b: Column) -> Column:
    return gram_similarity(trigrams(a), trigrams(b))


def path_part(text: Column, limit: int | Column, file_name: bool = False) -> Column:
    """Cut, trim on the right and replace what a file system doesn't take; an empty directory part is '_'."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    c = F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), F.lit(1), limit), r"(?U)\s+$", "")
    c = F.translate(c, UNSAFE, "_" * len(UNSAFE))
    c = F.when(c.startswith("."), F.concat(F.lit("_"), F.substr(c, F.lit(2)))).otherwise(c)
    if not file_name:
        c = F.when(c == "", F.lit("_")).when(c.endswith("."), F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.lit("_"))).otherwise(c)
    return c


def two_digits(n: Column) -> Column:
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def file_name(title: Column, ext: Column, track_n: Column, disc_n: Column, suffix: Column, limit: Column) -> Column:
    """[disc-]NN Title[ suffix].ext, cut to ``limit``."""
    number = F.when(track_n.isNotNull(), F.concat(F.when(disc_n.isNotNull(), F.concat(disc_n.cast("string"), F.lit("-"))).otherwise(F.lit("")), two_digits(track_n), F.lit(" "))).otherwise(F.lit(""))
    tail = F.concat(F.when(suffix > 0, F.concat(F.lit(" "), suffix.cast("string"))).otherwise(F.lit("")), F.lit("."), ext)
    return F.concat(path_part(F.concat(number, F.coalesce(title, F.lit(""))), limit - F.length(tail), True), tail)


def library_path(artist: Column, album: Column, title: Column, ext: Column, track_n: Column, disc_n: Column, suffix: Column, limit: Column) -> Column:
    """Artist/Album/[disc-]NN Title[ suffix].ext, each part cut to ``limit``."""
    return F.concat_ws("/", path_part(artist, limit), path_part(album, limit), file_name(title, ext, track_n, disc_n, suffix, limit))


def path_artist(compilation: Column, album_artist: Column, artist: Column) -> Column:
    return F.when(F.coalesce(compilation, F.lit(False)), F.lit("Compilations")).otherwise(F.coalesce(F.nullif(album_artist, F.lit("")), F.nullif(artist, F.lit("")), F.lit("Unknown Artist")))


def path_album(album: Column) -> Column:
    return F.coalesce(F.nullif(album, F.lit("")), F.lit("Unknown Album"))


def duration_bucket(seconds: Column) -> Column:
    return (F.bround(seconds / 5) * 5).cast("int")


def duplicate_hash(*fields: Column) -> Column:
    """Raw fields joined by ';', null as ''. The separator isn't escaped."""
    return F.concat_ws(";", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def alias_label(title: Column, artist: Column, album: Column) -> Column:
    e = F.lit("")
    return F.concat(F.lit("["), title, F.lit(" / "), F.coalesce(artist, e), F.lit(" / "), F.coalesce(album, e), F.lit("]"))


def playlist_comment(service: Column, source_id: Column, description: Column) -> Column:
    more = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c)).otherwise(F.lit(""))
    return F.concat(service, more(" #", source_id), more("\n", description))


def server_path(path: Column) -> Column:
    return F.when(path.startswith("Library/"), F.substr(path, F.lit(9))).otherwise(path)


def minutes(seconds: Column) -> Column:
    """m:ss; minutes aren't wrapped to hours."""
    s = F.floor(seconds).cast("long")
    return F.when(seconds.isNotNull(), F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")))


def masked_dsn(dsn: Column) -> Column:
    return F.regexp_replace(dsn, r"://[^/@]*@", "://")


def full_name(artist: Column, album: Column, title: Column) -> Column:
    """Artist, [album] and title for messages; null as nothing."""
    return F.concat(F.coalesce(artist, F.lit("")), F.lit(" ["), F.coalesce(album, F.lit("")), F.lit("] "), title)


def group_label(artist: Column, title: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(artist, F.lit("")), F.lit("?")), F.lit(" — "), F.coalesce(F.nullif(title, F.lit("")), F.lit("?")))


def half_even_seconds(ms: Column) -> Column:
    return F.bround(F.nullif(ms, F.lit(0)) / 1000).cast("int")


def tag_year(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")
