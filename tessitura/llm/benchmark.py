"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Each item is cut into windows (``size`` consecutive words; a shorter item is one window of its own length). A window is a set of
word shingles, ``GRAM`` words each. A document that contains the window contains all of them, so with the shingles in order of
rarity over the whole corpus, the prefix that must be joined is the rarest one alone. Length and position bounds drop
candidates whose window would not fit into the document; the rest is verified word by word over the item-sized window.

One scan of the texts keeps the places whose shingle is one of the items', together with the words around them;
everything after that works on these places only. Tables of shingles and windows are broadcast if they have at most
BROADCAST_ROWS rows, counted beforehand, and joined by shuffle beyond that.

Documents go by a number of their own (``numbering``), not by their key, so keys may be null, repeated or of any type.

Defined results: null and empty texts have no words; an item without words has no window; rows with one key and different texts are different
documents, each judged by itself; rows equal in both are judged alike; null item ids are left out; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.numbering import numbered
from tessitura.llm.scratch import written

GRAM = 5
BROADCAST_ROWS = 1_000_000  # shingles or windows, about 100 bytes each
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    """A-Z in lower case and nothing else changed."""
    plain = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(F.translate(plain, string.ascii_uppercase, string.ascii_lowercase))


def words(text):
    """The words of a lower-cased text; none for a null or empty one."""
    return F.filter(F.split(lowered(text), SEPARATORS), lambda w: w != "")


def gram_hash(ws, at, k: int):
    """Hash of the ``k`` words from index ``at`` on."""
    return F.xxhash64(F.lit(k), *[F.get(ws, at + j) for j in range(k)])


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """Distinct windows: ``win`` (its words, space-joined), ``len`` and the hashed id ``win_id``, with one row for each item that has it."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.col("item").isNotNull() & (F.size("w") > 0))
    cut = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size))))
    return cut.select("item", F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("win"), F.least(F.size("w"), F.lit(size)).alias("len")).distinct()


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if its counted rows are at most BROADCAST_ROWS; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def places(docs: DataFrame, grams: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """One row with ``at`` = -1 for each document (its number, key and number of words), and one for each place whose shingle is an item's."""
    wanted = grams.select("k", "gram").distinct()
    per_k = {r["k"]: r["count"] for r in wanted.groupBy("k").count().collect()}  # at most GRAM rows
    ws, at = F.col("w"), F.col("at")
    rows = numbered(docs, key, text)[0].select(F.col("_no").alias("doc"), "_key", words(F.col("_text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    rows = rows.select("doc", "_key", "n_words", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    each = [F.struct(F.lit(k).alias("k"), F.when((at >= 0) & (at + k <= F.size(ws)), gram_hash(ws, at, k)).alias("gram")) for k in sorted(per_k)]
    if not each:
        return rows.where("at = -1").select("doc", "_key", "n_words", "at", F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram"), F.lit(None).cast("array<string>").alias("near"))
    if len(each) == 1:
        rows = rows.select("*", each[0]["k"].alias("k"), each[0]["gram"].alias("gram"))
    else:
        rows = rows.select("*", F.explode(F.when(at == -1, F.array(each[0])).otherwise(F.array(*each))).alias("x")).select("doc", "_key", "n_words", "w", "at", "x.k", "x.gram")
    near = F.when(at >= 0, F.slice(ws, F.greatest(at - (size - 1), F.lit(0)) + 1, 2 * size))
    held = small(wanted.select(F.col("gram").alias("wanted"), F.col("k").alias("wanted_k")), total := sum(per_k.values()))
    if total > BROADCAST_ROWS:  # the rows move: carry the words nearby instead of the document
        rows = rows.select("doc", "_key", "n_words", "at", "k", "gram", near.alias("near"))
        near = F.col("near")
    met = rows.join(held, (F.col("gram") == F.col("wanted")) & (F.col("k") == F.col("wanted_k")), "left").where((at == -1) | F.col("wanted").isNotNull())
    return met.select("doc", "_key", "n_words", "at", "k", "gram", near.alias("near"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """For each document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    owned = written(windows(benchmark, item, item_text, size), "windows")
    wins = owned.select("win", "len").distinct().withColumn("ww", F.split("win", " "))
    cut = wins.withColumn("k", F.least(F.lit(GRAM), F.col("len"))).withColumn("offset", F.explode(F.expr("sequence(0, len - k)")))
    hashed = F.coalesce(*[F.when(F.col("k") == k, gram_hash(F.col("ww"), F.col("offset"), k)) for k in range(1, GRAM + 1)])
    grams = written(cut.select("win", "len", "offset", "k", hashed.alias("gram")), "grams")

    spots = written(places(docs, grams, key, text, size), "places")
    counted = grams.select("k", "gram").distinct().join(spots.where("at >= 0").groupBy("k", "gram").agg(F.count("*").alias("n")), ["k", "gram"], "left").fillna(0, ["n"])
    ordered = grams.join(counted, ["k", "gram"])
    prefix = ordered.groupBy("win", "len").agg(F.min(F.struct("n", "offset", "k", "gram")).alias("p")).where("p.n > 0").select("win", "len", "p.offset", "p.k", "p.gram")
    prefix = written(prefix, "prefix")
    prefix_rows = prefix.count()

    start = F.col("at") - F.col("offset")
    pairs = spots.where("at >= 0").join(small(prefix, prefix_rows), ["k", "gram"])
    fits = pairs.where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    shift = F.least(F.col("at"), F.lit(size - 1)) - F.col("offset")
    exact = fits.where(F.array_join(F.slice("near", shift + 1, F.col("len")), " ") == F.col("win")).select("doc", start.alias("start"), "len", "win")
    hits = written(exact, "hits")

    # Covered words: the union of the verified windows of each document.
    order = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    merged = F.aggregate(order, zero, lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["stop"]).alias("to")))
    covered = hits.select("doc", "start", "len").distinct().groupBy("doc").agg(merged["n"].cast("long").alias("n_hit"))
    names = hits.select("doc", "win").distinct().join(owned.select("win", "item"), "win").select("doc", "item").distinct()
    items = names.groupBy("doc").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    every = spots.where("at = -1").select("doc", "_key", "n_words")
    out = every.join(covered, "doc", "left").join(items, "doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("_key").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
