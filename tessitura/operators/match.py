"""Which track a free-text listen means: exact titles, or trigram similarity through a prefix-filtered join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.text import SIMILAR, gram_similarity, trigrams
from tessitura.plans.scratch import written

TITLE_SIMILAR, LEAST_LENGTH, THRESHOLD = 0.45, 4, 0.4
NAMES = (0.8, 0.6, 0.4)  # similarities down to which artists are tried one after the other, before the least that can be accepted
ROUNDS = (0.7, TITLE_SIMILAR)  # title similarities down to which the best tracks of the highest score are looked for
SHARD, BLOCK = 100_000, 200_000  # tracks and aliases that a task compares
EDGE = 1e-6  # above the rounding of a 4-byte float


def match_exact(aliases: DataFrame, tracks: DataFrame) -> DataFrame:
    """(alias_key, track_id): aliases without an artist, by title; canons first, then album artist, artist, album, id."""
    a = aliases.where((F.col("artist_norm") == "") & (F.col("title_norm") != "")).select("alias_key", F.col("title_norm").alias("t"))
    order = F.struct(F.col("canon_id").isNotNull().alias("a"), F.coalesce("canon_id", F.lit(0)).alias("b"), F.col("album_artist_norm").alias("c"), F.col("artist_norm").alias("d"), F.col("album_norm").alias("e"), F.col("id").alias("id"))
    best = tracks.groupBy("title_norm").agg(F.min(order).alias("k")).select("title_norm", F.col("k.id").alias("track_id"))
    return a.join(best, a["t"] == best["title_norm"]).select("alias_key", "track_id")


def near_titles(titles: DataFrame) -> DataFrame:
    """(ia, ib) of titles that may reach TITLE_SIMILAR.

    Prefix filter for Jaccard t = 9/20: with grams in order of rarity a pair that similar shares one of the first ``n - ceil(t n) + 1`` grams of each side; its
    sizes differ by the same factor at most; and from the places of the shared gram on there must be enough grams left on both sides.
    """
    grams = titles.select("id", "l", "r", F.size("g").alias("n"), F.explode("g").alias("gram"))
    freq = grams.groupBy("gram").agg(F.count("*").alias("f"))
    ranked = grams.join(freq, "gram").groupBy("id", "l", "r", "n").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("o"))
    keep = (F.col("n") - F.expr("(9 * n + 19) div 20") + 1).cast("int")
    prefix = written(ranked.select("id", "l", "r", "n", F.posexplode(F.slice(F.col("o.gram"), F.lit(1), keep)).alias("at", "gram")), "prefixes")
    a = prefix.where("l").select(F.col("id").alias("ia"), F.col("n").alias("na"), F.col("at").alias("pa"), "gram")
    b = prefix.where("r").select(F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("at").alias("pb"), "gram")
    left = "least(pa, pb) + least(na - pa, nb - pb)"  # shared grams before this one stand before it on both sides
    met = a.join(b, "gram").where(f"20 * na >= 9 * nb and 20 * nb >= 9 * na and 29 * ({left}) >= 9 * (na + nb)")
    return met.select("ia", "ib").distinct()


def containing_titles(titles: DataFrame) -> DataFrame:
    """(ia, ib) of titles of LEAST_LENGTH characters or more of which one contains the other, and perhaps others: the shorter one's first characters, 4, 8, 16 or
    32 of them as its length allows, are characters of the longer one somewhere."""
    widths = (LEAST_LENGTH, 8, 16, 32)
    long = titles.where(F.length("t") >= LEAST_LENGTH).select("id", "l", "r", "t", F.length("t").alias("n"))
    wide = F.lit(widths[0])
    for w in widths[1:]:
        wide = F.when(F.col("n") >= w, w).otherwise(wide)
    inner = long.select(F.col("id").alias("i"), F.col("l").alias("il"), F.col("r").alias("ir"), F.col("n").alias("m"), F.substring("t", F.lit(1), wide).alias("head"))
    def cuts(w: int) -> Column:  # the lambda takes one argument: Spark would give a second one the index
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - w + 1, F.lit(1))), lambda i: F.substring("t", i, F.lit(w)))
        return F.when(F.col("n") >= w, every).otherwise(F.array().cast("array<string>"))

    outer = long.select(F.col("id").alias("o"), F.col("l").alias("ol"), F.col("r").alias("or_"), "n", F.explode(F.array_distinct(F.concat(*[cuts(w) for w in widths]))).alias("head"))
    met = inner.join(outer, "head").where("m <= n")
    first = met.where("il and or_").select(F.col("i").alias("ia"), F.col("o").alias("ib"))
    return first.union(met.where("ol and ir").select(F.col("o").alias("ia"), F.col("i").alias("ib"))).distinct()


def title_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, sim): all pairs of distinct titles that pass the title gate, exactly: at least SIMILAR, and equal, at least TITLE_SIMILAR, or one within the other."""
    sides = left.select("t", F.lit(True).alias("l")).union(right.select("t", F.lit(False).alias("l"))).where("t <> ''")
    titles = sides.groupBy("t").agg(F.bool_or("l").alias("l"), F.bool_or(~F.col("l")).alias("r")).withColumn("g", F.transform(trigrams(F.col("t")), lambda x: F.xxhash64(x)))
    titles = written(titles.withColumn("id", F.xxhash64("t")), "titles")  # equal hashes only bring a pair more to verify
    met = near_titles(titles).union(containing_titles(titles)).distinct()  # narrow rows move; arrays join afterwards
    whole = met.join(titles.select(F.col("id").alias("ia"), F.col("t").alias("a"), F.col("g").alias("ga")), "ia").join(titles.select(F.col("id").alias("ib"), F.col("t").alias("b"), F.col("g").alias("gb")), "ib")
    sim = gram_similarity(F.col("ga"), F.col("gb"))
    long = (F.length("a") >= LEAST_LENGTH) & (F.length("b") >= LEAST_LENGTH)
    gate = (F.col("a") == F.col("b")) | (F.col("sim").cast("double") >= TITLE_SIMILAR) | (long & (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))))
    return whole.select("a", "b", sim.alias("sim")).where((F.col("sim") >= F.lit(SIMILAR).cast("float")) & gate)


class Index:
    """Titles by gram, to find those of a least similarity to a title."""

    def __init__(self, grams: list[np.ndarray]) -> None:
        self.n = np.array([len(g) for g in grams])
        self.vocabulary, flat = np.unique(np.concatenate(grams), return_inverse=True)
        row = np.repeat(np.arange(len(grams)), self.n)
        self.rows = row[np.argsort(flat, kind="stable")]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(self.vocabulary)))])
        self.grams = np.full((len(grams), self.n.max()), len(self.vocabulary), np.int32)
        self.grams[row, np.arange(len(row)) - np.repeat(np.cumsum(self.n) - self.n, self.n)] = flat
        self.mark, self.met = np.zeros(len(self.vocabulary) + 1, bool), np.zeros(len(grams), np.int16)

    def near(self, title: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows at ``least`` or more, with their similarity: they have one of the title's rarest grams, and enough of these for the others to do."""
        n, at = len(title), np.searchsorted(self.vocabulary, title)
        at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == title]
        known = at[np.argsort(self.ends[at + 1] - self.ends[at], kind="stable")]
        rare = known[: max(0, n - int(np.ceil(least * n - EDGE)) + 1 - (n - len(known)))]  # grams that no title has come first
        lists = [self.rows[self.ends[g] : self.ends[g + 1]] for g in rare]
        if not lists:
            return np.zeros(0, int), np.zeros(0)
        for x in lists:
            self.met[x] += 1
        rows = np.concatenate(lists)
        enough = rows[self.met[rows] + len(known) - len(rare) >= least / (1 + least) * (n + self.n[rows]) - EDGE]
        self.met[rows] = 0
        rows = np.unique(enough)
        self.mark[known] = True
        shared = self.mark[self.grams[rows]].sum(1)
        self.mark[known] = False
        sim = shared / (n + self.n[rows] - shared)
        return rows[sim >= least], sim[sim >= least]


    def every(self, grams: np.ndarray) -> np.ndarray:
        """The similarity of each row, as the 4-byte float that it is compared as."""
        at = np.searchsorted(self.vocabulary, grams)
        at = at[at < len(self.vocabulary)] if not len(self.vocabulary) else at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == grams]
        lists = [self.rows[self.ends[g] : self.ends[g + 1]] for g in at]
        shared = np.bincount(np.concatenate(lists), minlength=len(self.n)) if lists else np.zeros(len(self.n), np.int64)
        return (shared / np.maximum(len(grams) + self.n - shared, 1)).astype(np.float32)


def _signature(grams: Column) -> Column:
    """Equal for texts of the same grams, that is of similarity 1; null for a text without any."""
    return F.when(F.size(grams) > 0, F.xxhash64(F.array_sort(grams)))


def _best_of(least: float):
    def run(aliases: pd.DataFrame, tracks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(aliases) and len(tracks):
            index, ids, albums = Index(list(tracks["g"])), tracks["id"].to_numpy(), tracks["album"].to_numpy()
            for _, same in aliases.groupby("a", sort=False):
                rows, sim = index.near(np.asarray(same["g"].iloc[0]), least)
                sim = sim.astype(np.float32)
                for ref, blank, album in zip(same["ref"], same["blank"], same["album"], strict=True):
                    own = np.ones(len(rows), bool) if blank else albums[rows] == album
                    if own.any() and (top := sim[own].max()) >= least + EDGE:
                        out.append((ref, top, ids[rows[own & (sim == top)]].min()))
        return pd.DataFrame(out, columns=["ref", "sim", "id"]).astype({"sim": np.float32})

    return run


def top_matches(aliases: DataFrame, tracks: DataFrame, least: float) -> DataFrame:
    """(ref, sim, id): for each alias the best of the tracks that have its artist, and its album if it has one, if a title of ``least`` similarity is among them.

    No other track scores as high, and of these a less similar title never wins, so a match is final. Tracks of an artist are dealt out in shards, each with all the artist's
    aliases; pairs exist within a task only. ``aliases``: ref, a, g, artist, album (signatures), blank. ``tracks``: id, g, artist, album_artist, album.
    """
    by = lambda c: tracks.select(F.col(c).alias("artist"), "id", "g", "album").where("artist is not null")
    t = by("artist").union(by("album_artist").where("artist is not null")).groupBy("artist", "album", "g").agg(F.min("id").alias("id"))
    a = aliases.where("artist is not null and size(g) > 0 and (blank or album is not null)")
    t, a = t.where("size(g) > 0"), a.withColumn("h", F.xxhash64("a"))
    parts = t.groupBy("artist").agg(F.ceil(F.count("*") / SHARD).alias("shards")).join(a.groupBy("artist").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "artist")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    t = t.join(parts, "artist").withColumn("shard", F.pmod(F.xxhash64("g"), "shards")).withColumn("block", every("blocks"))
    a = a.join(parts, "artist").withColumn("block", F.pmod("h", "blocks")).withColumn("shard", every("shards"))
    keys = ["artist", "shard", "block"]
    found = a.select(*keys, "ref", "a", "g", "album", "blank").groupBy(*keys).cogroup(t.select(*keys, "id", "g", F.coalesce("album", F.lit(0)).alias("album")).groupBy(*keys)).applyInPandas(_best_of(least), "ref long, sim float, id long")
    return found.groupBy("ref").agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col("id").alias("id"))).alias("k")).select("ref", (-F.col("k.s")).alias("sim"), F.col("k.id").alias("id"))


def name_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(x, y, s): names of both sides whose similarity is ``least`` or more. ``left``: x, gx; ``right``: y, gy, distinct names with their grams.

    Prefix filter: with grams in order of rarity such a pair shares one of the first ``n - ceil(least n) + 1`` of each side, and its sizes differ by that factor at most.
    """
    grams = left.select(F.col("gx").alias("g")).union(right.select("gy")).select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("f"))

    def prefix(names: DataFrame, name: str, g: str) -> DataFrame:
        each = names.select(name, F.size(g).alias("n"), F.explode(g).alias("gram")).join(grams, "gram")
        ranked = each.groupBy(name, "n").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("o"))
        keep = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - EDGE) + 1).cast("int")
        return ranked.select(name, F.col("n").alias(f"n{name}"), F.explode(F.slice(F.col("o.gram"), F.lit(1), F.least(keep, F.col("n")))).alias("gram"))

    near = F.least("nx", "ny") >= F.lit(least) * F.greatest("nx", "ny") - EDGE
    met = prefix(left, "x", "gx").join(prefix(right, "y", "gy"), "gram").where(near).select("x", "y").distinct()
    both = met.join(left, "x").join(right, "y")
    return both.select("x", "y", gram_similarity(F.col("gx"), F.col("gy")).alias("s")).where(F.col("s").cast("double") >= least)


def _best_by_score(aliases: pd.DataFrame, tracks: pd.DataFrame) -> pd.DataFrame:
    """Of the tracks of one artist's name the best of each alias, whose artist has the similarity ``s`` to that name."""
    out = []
    if len(aliases) and len(tracks):
        index, ids, titles = Index(list(tracks["g"])), tracks["id"].to_numpy(), tracks["t"].to_numpy(object)
        _, first, album = np.unique(tracks["album"].to_numpy(str), return_index=True, return_inverse=True)
        albums, known = Index([tracks["ga"].iloc[i] for i in first]), {}
        for title, same in aliases.groupby("a", sort=False):
            rows, sim = index.near(np.asarray(same["g"].iloc[0]), SIMILAR - EDGE)
            sim = sim.astype(np.float32)
            long = len(title) >= LEAST_LENGTH
            within = np.array([t == title or (long and len(t) >= LEAST_LENGTH and (t in title or title in t)) for t in titles[rows]], bool)
            gate = (sim >= np.float32(SIMILAR)) & ((sim.astype(np.float64) >= TITLE_SIMILAR) | within)
            rows, sim = rows[gate], sim[gate]
            if not len(rows):
                continue
            for ref, s, own, grams in zip(same["ref"], same["s"], same["album"], same["ga"], strict=True):
                if own and own not in known:
                    known[own] = albums.every(np.asarray(grams, np.int64)).astype(np.float64)
                score = float(np.float32(s)) * 0.75 + (known[own][album[rows]] if own else np.full(len(rows), 0.5)) * 0.25
                top = score == score.max()
                top &= sim == sim[top].max()
                out.append((ref, score[top][0], sim[top][0], ids[rows[top]].min()))
    return pd.DataFrame(out, columns=["ref", "score", "sim", "id"]).astype({"ref": np.int64, "score": np.float64, "sim": np.float32, "id": np.int64})


def _nearest_matches(open_: DataFrame, pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """(ref, k): final matches by the most similar name of an alias's artist and by its own album: no other track scores as high, as with the artist itself in ``top_matches``."""
    nearest = pairs.groupBy("x").agg(F.max("s").alias("most")).join(pairs, "x").where("s = most").select("x", "s", _signature(trigrams(F.col("y"))).alias("artist")).distinct()
    own = open_.join(nearest, open_["a_artist"] == nearest["x"])
    own = written(own.select("ref", "a", "g", "artist", _signature(trigrams(F.col("album"))).alias("album"), (F.col("album") == "").alias("blank"), "s"), "nearest")
    scores = own.select("ref", (F.col("s").cast("double") * 0.75 + F.when(F.col("blank"), 0.125).otherwise(0.25)).alias("score")).distinct()
    found = None
    for least in ROUNDS:
        more = written(top_matches(own.drop("s"), tracks, least), "matched")
        found = more if found is None else found.union(more)
        own = own.join(more.select("ref"), "ref", "left_anti")
    return found.join(scores, "ref").select("ref", F.struct((-F.col("score")).alias("a"), (-F.col("sim")).alias("b"), F.col("id").alias("id")).alias("k"))


def bounded_matches(aliases: DataFrame, tracks: DataFrame, threshold: float) -> DataFrame:
    """(ref, score, sim, id): the best track of each alias by score, similarity of title and id, if it scores ``threshold`` or more.

    Falling bounds: artists are tried from the most similar names down. A track whose artist is less similar than ``least`` scores less than 0.75 least + 0.25 (0.125 for an
    alias without album), so an alias whose best reaches that is done and leaves; the last bound is the one below which nothing is accepted. Titles are compared within a task only,
    so no pair of titles is written, and an alias meets the tracks of the artists near its own instead of all. Before that, the name most similar to an alias's artist is taken for it: a similar
    title with the alias's own album is final then, by far fewer comparisons (``_nearest_matches``). ``aliases``: ref, a, a_artist, a_album; ``tracks``: id, title_norm, artist_norm,
    album_artist_norm, album_norm. ``threshold`` must be over 0.25, or artists without anything in common would count.
    """
    hashed = lambda c: F.transform(trigrams(F.col(c)), lambda x: F.xxhash64(x))
    open_ = written(aliases.select("ref", "a", hashed("a").alias("g"), "a_artist", hashed("a_artist").alias("gx"), F.col("a_album").alias("album"), hashed("a_album").alias("ga")).where("size(g) > 0 and size(gx) > 0"), "open_aliases")
    by = lambda c: tracks.where("title_norm <> ''").select(F.col(c).alias("y"), "id", F.col("title_norm").alias("t"), F.col("album_norm").alias("album")).where("y <> ''")
    named = by("artist_norm").union(by("album_artist_norm")).groupBy("y", "t", "album").agg(F.min("id").alias("id"))
    named = written(named.select("y", "t", "id", F.coalesce("album", F.lit("")).alias("album"), hashed("t").alias("g"), hashed("album").alias("ga")).where("size(g) > 0"), "named_tracks")
    names = written(named.groupBy("y").agg(F.count("*").alias("n")).withColumn("gy", hashed("y")).where("size(gy) > 0"), "names")
    signed = tracks.where("title_norm <> ''").select("id", hashed("title_norm").alias("g"), *[_signature(trigrams(F.col(f"{c}_norm"))).alias(c) for c in ("artist", "album_artist", "album")])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    order = F.struct((-F.col("score")).alias("a"), (-F.col("sim")).alias("b"), F.col("id").alias("id"))
    last, best, above, tried = (threshold - 0.25) / 0.75 - EDGE, None, None, None
    for least in [x for x in NAMES if x > last] + [last]:
        pairs = name_pairs(open_.groupBy(F.col("a_artist").alias("x")).agg(F.first("gx").alias("gx")), names.select("y", "gy"), least)
        pairs = written(pairs if above is None else pairs.where(F.col("s").cast("double") < above), "name_pairs")
        if pairs.isEmpty():
            above = least
            continue
        nearest = written(_nearest_matches(open_, pairs if tried is None else pairs.join(tried, "x", "left_anti"), signed), "nearest_matches")
        tried = pairs.select("x").distinct() if tried is None else tried.union(pairs.select("x").distinct())
        best = nearest if best is None else best.union(nearest)
        open_ = written(open_.join(nearest, "ref", "left_anti"), "open_aliases")
        if open_.isEmpty():
            break
        met = open_.join(pairs, open_["a_artist"] == pairs["x"])
        parts = written(met.groupBy("y").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(names.select("y", F.ceil(F.col("n") / SHARD).alias("shards")), "y"), "parts")
        left = met.select("y", "s", "ref", "a", "g", "album", "ga").join(parts, "y").withColumn("block", F.pmod(F.xxhash64("a"), "blocks")).withColumn("shard", every("shards"))
        right = named.join(parts, "y").withColumn("shard", F.pmod(F.xxhash64("t"), "shards")).withColumn("block", every("blocks"))
        keys = ["y", "shard", "block"]
        found = left.select(*keys, "s", "ref", "a", "g", "album", "ga").groupBy(*keys).cogroup(right.select(*keys, "t", "id", "album", "g", "ga").groupBy(*keys)).applyInPandas(_best_by_score, "ref long, score double, sim float, id long")
        found = found.groupBy("ref").agg(F.min(order).alias("k"))
        best = written(found.union(best).groupBy("ref").agg(F.min("k").alias("k")), "best")
        bound = F.lit(0.75 * least) + F.when(F.col("album") == "", 0.125).otherwise(0.25)
        done = open_.join(best, "ref").where(-F.col("k.a") >= bound).select("ref")
        open_, above = written(open_.join(done, "ref", "left_anti"), "open_aliases"), least
        if open_.isEmpty():
            break
    if best is None:
        return open_.select("ref", F.lit(0.0).alias("score"), F.lit(0).cast("float").alias("sim"), F.lit(0).cast("long").alias("id")).where("false")
    return best.select("ref", (-F.col("k.a")).alias("score"), (-F.col("k.b")).alias("sim"), "k.id").where(F.col("score") >= threshold)


def match_fuzzy(aliases: DataFrame, tracks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(alias_key, track_id, score): aliases with an artist, best track by score, title similarity, id; accepted from ``threshold`` on.

    Most aliases have a similar title among the tracks of their own artist and album, which no other track outscores; what is left goes through falling
    bounds of the artist's similarity (``bounded_matches``). Only where ``threshold`` lets artists without anything in common count are all pairs of titles written.
    """
    a = aliases.where((F.col("artist_norm") != "") & (F.col("title_norm") != "")).select("alias_key", F.col("title_norm").alias("a"), F.col("artist_norm").alias("a_artist"), F.col("album_norm").alias("a_album"))
    grams = lambda c: F.transform(trigrams(F.col(c)), lambda x: F.xxhash64(x))
    a = written(a.withColumn("ref", F.monotonically_increasing_id()), "aliases")
    open_ = a.select("ref", "a", grams("a").alias("g"), _signature(trigrams(F.col("a_artist"))).alias("artist"), _signature(trigrams(F.col("a_album"))).alias("album"), (F.col("a_album") == "").alias("blank"))
    t = tracks.where("title_norm <> ''").select("id", grams("title_norm").alias("g"), *[_signature(trigrams(F.col(f"{c}_norm"))).alias(c) for c in ("artist", "album_artist", "album")])
    settled = None
    for least in ROUNDS:
        found = written(top_matches(open_, t, least), "matched")
        settled = found if settled is None else settled.union(found)
        left = written(a.join(settled.select("ref"), "ref", "left_anti"), "left")
        if left.isEmpty():
            break
        open_ = open_.join(left.select("ref"), "ref", "left_semi")
    score = F.when(F.col("a_album") == "", 0.875).otherwise(1.0)
    best = a.join(settled, "ref").select("alias_key", F.struct((-score).alias("a"), (-F.col("sim")).alias("b"), F.col("id").alias("id")).alias("k"))
    if not left.isEmpty():
        if threshold > 0.25:
            rest = left.join(bounded_matches(left, tracks, threshold), "ref")
            best = best.union(rest.select("alias_key", F.struct((-F.col("score")).alias("a"), (-F.col("sim")).alias("b"), F.col("id").alias("id")).alias("k")))
        else:
            best = best.union(_match_all(left.drop("ref"), tracks))
    best = best.groupBy("alias_key").agg(F.min("k").alias("k"))
    return best.select("alias_key", F.col("k.id").alias("track_id"), (-F.col("k.a")).alias("score")).where(F.col("score") >= threshold)


def _match_all(a: DataFrame, tracks: DataFrame) -> DataFrame:
    """(alias_key, k): the best of all tracks, k as negative score and similarity, and id."""
    pairs = title_pairs(a.select(F.col("a").alias("t")), tracks.select(F.col("title_norm").alias("t")))
    t = tracks.select("id", F.col("title_norm").alias("b"), F.col("artist_norm").alias("t_artist"), F.col("album_artist_norm").alias("t_album_artist"), F.col("album_norm").alias("t_album"))
    rows = a.join(pairs, "a").join(t, "b")
    # each distinct pair of names is compared once
    names = rows.select(F.col("a_artist").alias("x"), F.col("t_artist").alias("y")).union(rows.select("a_artist", "t_album_artist")).union(rows.where("a_album <> ''").select("a_album", "t_album")).distinct()
    sims = names.select("x", "y", gram_similarity(trigrams(F.col("x")), trigrams(F.col("y"))).alias("s"))
    rows = rows.join(sims.toDF("a_artist", "t_artist", "s1"), ["a_artist", "t_artist"]).join(sims.toDF("a_artist", "t_album_artist", "s2"), ["a_artist", "t_album_artist"]).join(sims.toDF("a_album", "t_album", "s3"), ["a_album", "t_album"], "left")
    album = F.when(F.col("a_album") == "", F.lit(0.5)).otherwise(F.col("s3").cast("double"))
    score = F.greatest("s1", "s2").cast("double") * 0.75 + album * 0.25
    return rows.groupBy("alias_key").agg(F.min(F.struct((-score).alias("a"), (-F.col("sim")).alias("b"), F.col("id").alias("id"))).alias("k"))


def augment(aliases: DataFrame) -> DataFrame:
    """(alias_key, artist_norm, album_norm) with blanks filled from siblings of the same title that agree on one value.

    Siblings are the aliases of the title that know what this one lacks. If just one alias of the title does, its values count as they are.
    """
    per = aliases.where("title_norm <> ''").groupBy("title_norm").agg(F.collect_set(F.nullif("artist_norm", F.lit(""))).alias("artists"), F.collect_set(F.nullif("album_norm", F.lit(""))).alias("albums"))
    j = aliases.join(per, "title_norm", "left")
    one = lambda own, seen: F.when((F.col(own) == "") & (F.size(seen) == 1), F.get(seen, F.lit(0))).otherwise(F.col(own))
    return j.select("alias_key", one("artist_norm", "artists").alias("artist_norm"), one("album_norm", "albums").alias("album_norm"))
