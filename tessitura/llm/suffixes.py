"""Exact byte-level deduplication: every byte that a repeated 100-byte string covers, where an earlier copy exists.

The strings that can repeat are found first, so that suffixes need not be sorted for the whole corpus: every 100-byte window
chooses the least of the 48-byte stretches in it (its anchor), equal windows choose equal anchors, and the windows with one anchor
form a run. Runs are dealt into buckets by anchor. Runs that are equal as a whole (by the 64-bit hashes of the run and of its anchor, 128 bits) lose all but the earliest; a run whose anchor
occurs nowhere else holds no repeat. What is left are runs that share an anchor but differ further out, a small part of the text. Their
strings are gathered, cut down to the windows whose rolling hash occurs twice in the bucket, and resolved there by Burrows-Wheeler transforms: a transform for every shard of strings, merged by iterative
interleave refinement (one stable pass over the merged transform for each further byte of context, a block splitting where
its suffixes first differ, which gives the common prefixes), without sorting suffixes across shards. Blocks that are
whole after 100 passes are the repeated intervals; all members but the earliest are repeats.

Buckets are counted from the bytes of all texts, so what one holds doesn't grow with the data. An anchor with so many different runs that they
are too much for a task (more than HOT, or a ten-thousandth of all open runs) is split: its windows are dealt by their own hash and compared by two
64-bit hashes, 128 bits.

Defined results: null and empty texts have no bytes; a document shorter than the window loses nothing; matches never cross documents. Keys may
have any type; a null key sorts before all others; rows with one key and different texts are different documents, in the order of their texts'
SHA-256, and never cut each other's bytes; rows that are equal in key and text are one document and get equal results. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.numbering import buckets, numbered
from tessitura.llm.rolling import Prefix, mix, sliding_min
from tessitura.llm.scratch import written
from tessitura.llm.substrings import NONE, intervals, judged, runs_of, spans_frame

GRAM = 48  # bytes of an anchor
CHUNK = 2 << 20  # bytes that are hashed at once; a longer document is cut into overlapping pieces
PLACE = np.uint64((1 << 26) - 1)  # the low bits of an anchor's key are its place
SHARD = 1 << 16  # bytes of a transform
HOT = 2000  # different runs of one anchor that a task resolves by transforms, at least
TOKENS = mix(np.arange(256, dtype=np.uint64), 11)
OTHER = mix(np.arange(256, dtype=np.uint64), 12)  # for the second hash of a window
SCHEMA = "bucket long, anchors binary, hashes binary, docs binary, starts binary, counts binary, gone boolean"


def chunks(batches, size: int):
    """Pieces (document, offset, bytes) in lists of about CHUNK bytes; pieces of one document overlap by a window less one byte."""
    held, total = [], 0
    for b in batches:
        for doc, text in zip(b["_no"], b["_text"], strict=True):
            raw = text.encode()
            for at in range(0, max(1, len(raw) - size + 1), CHUNK):
                piece = raw[at : at + CHUNK + size - 1]
                if held and total + len(piece) > CHUNK:
                    yield held
                    held, total = [], 0
                if len(piece) >= size:
                    held.append((doc, at, piece))
                    total += len(piece)
    if held:
        yield held


def runs(pieces: list[tuple[int, int, bytes]], size: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor hash, hash of the whole run, document, first window, number of windows."""
    p = Prefix(TOKENS[np.frombuffer(b"".join(x for _, _, x in pieces), np.uint8)])
    gram = min(GRAM, size)
    g = p.every(gram)
    anchor = sliding_min((g & ~PLACE) | np.arange(len(g), dtype=np.uint64), size - gram + 1) & PLACE
    lens = np.array([len(x) for _, _, x in pieces])
    base = np.cumsum(lens) - lens
    of = np.repeat(np.arange(len(pieces)), lens)[: len(anchor)]
    inside = np.arange(len(anchor)) + size <= (base + lens)[of]
    at = np.flatnonzero(inside)
    start, n = runs_of(np.concatenate([[False], (anchor[at[1:]] == anchor[at[:-1]]) & (of[at[1:]] == of[at[:-1]])]))
    first, a = at[start], anchor[at[start]].astype(np.int64)
    whole = mix(p.of(first, first + n + size - 1) ^ mix((n * 4096 + (a - first)).astype(np.uint64)))
    docs, offsets = np.array([d for d, _, _ in pieces], np.int64), np.array([o for _, o, _ in pieces], np.int64)
    piece = of[first]
    return mix(g[a], 5), whole, docs[piece], offsets[piece] + first - base[piece], n


def deal(pieces, size: int, buckets: int):
    """Packed rows of SCHEMA: each distinct run of the chunk once, and the later copies as gone."""
    anchor, whole, doc, first, n = runs(pieces, size)
    earliest, again, _ = judged(whole, anchor, doc, first)
    later, kept = np.flatnonzero(again), np.flatnonzero(earliest)

    def pack(bucket, own, gone):
        return bucket, b"" if gone else anchor[own].tobytes(), b"" if gone else whole[own].tobytes(), doc[own].tobytes(), first[own].astype(np.int32).tobytes(), n[own].astype(np.int32).tobytes(), gone

    if len(later):
        yield pack(int(anchor[later[0]] % np.uint64(buckets)), later, True)
    b = (anchor[kept] % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((first[kept], doc[kept], b))
    kept, b = kept[by], b[by]
    for at, k in zip(*runs_of(np.concatenate([[False], b[1:] == b[:-1]])), strict=True):
        yield pack(int(b[at]), kept[at : at + k], False)


def marked_runs(docs: DataFrame, size: int, n: int) -> DataFrame:
    """doc, first, last and anchor: runs that are repeats as a whole (anchor null), and those that share an anchor with another run."""

    def send(batches):
        for held in chunks(batches, size):
            rows = list(deal(held, size, n))
            for at in range(0, len(rows), 256):
                yield pd.DataFrame(rows[at : at + 256], columns=["bucket", "anchors", "hashes", "docs", "starts", "counts", "gone"])

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take = lambda rows, c, t: np.frombuffer(b"".join(rows[c]), t)
        held = (*NONE, np.zeros(0, np.int32))  # hash, anchor, document, first window, number of windows: each distinct run once
        for group in batches:
            gone, own = group[group["gone"]], group[~group["gone"]]
            new = tuple(take(own, c, t) for c, t in (("hashes", np.uint64), ("anchors", np.uint64), ("docs", np.int64), ("starts", np.int32), ("counts", np.int32)))
            held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            earliest, later, _ = judged(*held[:4])
            d, f, k = (np.concatenate([take(gone, c, t), held[i][later]]) for c, t, i in (("docs", np.int64, 2), ("starts", np.int32, 3), ("counts", np.int32, 4)))
            yield pd.DataFrame({"doc": d, "first": f, "last": f + k - 1, "anchor": pd.Series([pd.NA] * len(d), dtype="Int64")})
            held = tuple(x[earliest] for x in held)
        _, at, many = np.unique(held[1], return_inverse=True, return_counts=True)
        _, anchor, d, f, k = (x[many[at] > 1] for x in held)
        yield pd.DataFrame({"doc": d, "first": f, "last": f + k - 1, "anchor": pd.Series(anchor.view(np.int64), dtype="Int64")})

    return docs.mapInPandas(send, SCHEMA).groupBy("bucket").applyInPandas(settle, "doc long, first int, last int, anchor long")


def transform(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffixes in order of their first ``depth`` bytes, and the Burrows-Wheeler transform in that order.

    Each string ends in byte -1 (stored as 0, all others one higher) and goes round at its end. Suffixes are places in the joined shard.
    """
    raw = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)  # no byte of UTF-8
    t = raw + np.uint8(1)  # wraps to 0 at the ends
    lens = np.array([len(s) + 1 for s in strings])
    base = np.repeat(np.cumsum(lens) - lens, lens)
    step = np.arange(len(t)) - base
    lens = np.repeat(lens, lens)
    rank, have = t.astype(np.int64), 1
    while have < depth:  # doubling inside the shard
        ahead = base + (step + have) % lens
        key = rank * (len(t) + 258) + rank[ahead]
        _, rank = np.unique(key, return_inverse=True)
        have *= 2
    order = np.argsort(rank, kind="stable")
    return order, t[(base + (step - 1) % lens)[order]]


def merged_blocks(shards: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, suffix and block of every suffix in merged order; suffixes of a block agree in their first ``depth`` bytes."""
    got = [transform(s, depth) for s in shards]
    order, bwt = [o for o, _ in got], np.concatenate([b for _, b in got])
    z = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), [len(o) for o in order])
    first = np.zeros(len(z), bool)  # where a block begins
    first[:1] = True
    symbols = np.empty(len(z), np.uint8)
    for _ in range(depth):
        symbols[np.argsort(z, kind="stable")] = bwt  # each shard's transform is read in its own order
        to = np.argsort(symbols, kind="stable")
        z, c, old = z[to], symbols[to], np.cumsum(first, dtype=np.int32)[to]
        np.not_equal(old[1:], old[:-1], out=first[1:])
        first[1:] |= c[1:] != c[:-1]
    block = np.cumsum(first)
    suffix = np.empty(len(z), np.int64)
    suffix[np.argsort(z, kind="stable")] = np.concatenate(order)
    return z, suffix, block


def cut_down(strings: list[bytes], doc: np.ndarray, first: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The strings without what stands before and after their first and last window whose hash occurs more than once."""
    lens = np.array([len(s) for s in strings])
    base = np.cumsum(lens) - lens
    h = Prefix(TOKENS[np.frombuffer(b"".join(strings), np.uint8)]).every(size)
    of = np.repeat(np.arange(len(strings)), lens)[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + size <= (base + lens)[of])
    _, where, many = np.unique(h[at], return_inverse=True, return_counts=True)
    at = at[many[where] > 1]
    if not len(at):
        return [], doc[:0], first[:0]
    own, lead = np.unique(of[at], return_index=True)
    low, high = at[lead] - base[own], at[np.append(lead[1:], len(at)) - 1] - base[own] + size
    return [strings[i][a:b] for i, a, b in zip(own, low, high, strict=True)], doc[own], first[own] + low


def resolve(strings: list[bytes], doc: np.ndarray, first: np.ndarray, size: int) -> pd.DataFrame:
    """Repeated windows (doc, first, last) among strings; string i holds the windows of ``doc[i]`` from ``first[i]`` on."""
    strings, doc, first = cut_down(strings, doc, first, size)
    if not strings:
        return pd.DataFrame({"doc": doc, "first": first, "last": first})
    shards, held, total = [], [], 0
    for s in strings:
        if held and total + len(s) > SHARD:
            shards.append(held)
            held, total = [], 0
        held.append(s)
        total += len(s) + 1
    shards.append(held)
    z, suffix, block = merged_blocks(shards, size)
    lens = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(lens) - lens
    shard_start = np.cumsum([0, *[sum(len(s) + 1 for s in sh) for sh in shards]])[:-1]
    place = shard_start[z] + suffix
    of = np.searchsorted(starts, place, "right") - 1
    at = place - starts[of]
    whole = at + size < lens[of]
    of, at, block = of[whole], at[whole], block[whole]
    _, again, _ = judged(block, block, doc[of], first[of] + at)
    own = of[again]
    return spans_frame(doc[own], first[own] + at[again])


def window_rows(doc: int, first: int, raw: bytes, size: int) -> tuple[np.ndarray, ...]:
    """Of all windows of a run's bytes: hash, second hash, document and place."""
    b = np.frombuffer(raw, np.uint8)
    h, more = (Prefix(tokens[b]).every(size) for tokens in (TOKENS, OTHER))
    return h, more, np.full(len(h), doc, np.int64), np.arange(first, first + len(h), dtype=np.int32)


def repeated_windows(docs: DataFrame, size: int, total: int, least_hot: int | None = None) -> DataFrame:
    """Runs of repeated windows: doc, first, last. ``docs``: _no, _text; ``total``: bytes of all texts."""
    n = buckets(docs, total)
    marked = written(marked_runs(docs, size, n), "runs")
    shared = marked.where("anchor is not null")
    most = max(HOT if least_hot is None else least_hot, shared.count() // 10_000)
    hot = {r["anchor"] for r in shared.groupBy("anchor").count().where(F.col("count") > most).select("anchor").collect()}  # 10,000 at most
    hot = docs.sparkSession.sparkContext.broadcast(hot)
    open_runs = shared.groupBy("doc").agg(F.collect_list(F.struct("first", "last", "anchor")).alias("_runs"))

    def strings(batches):
        for b in batches:
            out, wide = [], []
            for doc, t, own in zip(b["_no"], b["_text"], b["_runs"], strict=True):
                raw = t.encode()
                for r in own:
                    string = raw[r["first"] : r["last"] + size]
                    if r["anchor"] in hot.value:
                        wide.append(window_rows(doc, r["first"], string, size))
                    else:
                        out.append((r["anchor"] % n, doc, r["first"], r["anchor"], string))
            for at in range(0, len(wide), 1024):  # windows of hot anchors, dealt by their own hash
                h, more, doc, pos = (np.concatenate(x) for x in zip(*wide[at : at + 1024], strict=True))
                to = h % np.uint64(n)
                by = np.argsort(to, kind="stable")
                for start, k in zip(*runs_of(np.concatenate([[False], to[by[1:]] == to[by[:-1]]])), strict=True):
                    own = by[start : start + k]
                    out.append((int(to[own[0]]), None, None, None, b"".join(x[own].tobytes() for x in (h, more, doc, pos.astype(np.int64)))))
            yield pd.DataFrame(out, columns=["b", "doc", "first", "anchor", "string"]).astype({"doc": "Int64", "first": "Int64", "anchor": "Int64"})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, narrow = NONE, []
        for group in batches:
            wide = group["doc"].isna()
            if wide.any():
                split = [np.frombuffer(x, np.uint64).reshape(4, -1) for x in group["string"][wide]]
                new = [np.concatenate([x[i] for x in split]) for i in range(4)]
                every = tuple(np.concatenate(x) for x in zip(held, (new[0], new[1], new[2].view(np.int64), new[3].astype(np.int32)), strict=True))
                first, later, _ = judged(*every)
                yield spans_frame(every[2][later], every[3][later])
                held = tuple(x[first] for x in every)
            narrow.append(group[~wide])
        group = pd.concat(narrow).sort_values(["doc", "first"], kind="stable")
        if len(group):
            yield resolve(list(group["string"]), group["doc"].to_numpy(np.int64), group["first"].to_numpy(np.int64), size)

    joined = docs.join(open_runs, docs["_no"] == open_runs["doc"]).select("_no", "_text", "_runs")
    found = joined.mapInPandas(strings, "b long, doc long, first long, anchor long, string binary")
    solved = written(found.groupBy("b").applyInPandas(solve, "doc long, first int, last int"), "repeats")
    return marked.where("anchor is null").select("doc", "first", "last").union(solved)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 100, raw: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every document; with ``raw`` also the kept bytes."""
    rows, total = numbered(docs, key, text)
    each = repeated_windows(rows.select("_no", "_text"), size, total).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, own in zip(text, spans, strict=True):
            data, at, kept = t.encode(), 0, []
            start, stop = intervals(own if own is not None else [], size)
            for lo, hi in zip(start.tolist(), stop.tolist(), strict=True):
                kept.append(data[at:lo])
                at = hi
            left = b"".join([*kept, data[at:]]) if kept else data
            out.append((len(data), int((stop - start).sum()), len(start), hashlib.sha256(left).hexdigest(), left if raw else None))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(each, rows["_no"] == each["doc"], "left").select(F.col("_key").alias(key), cut("_text", "_spans").alias("_r"))
    out = joined.select(key, "_r.n_bytes", "_r.n_removed", "_r.n_spans", "_r.kept_sha256", "_r.kept")
    return out if raw else out.drop("kept")
