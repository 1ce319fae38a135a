"""Exact substring deduplication over word windows.

Every window of ``size`` consecutive words gets a Rabin-Karp hash (64 bits), worked out for some MB of text at once. The windows are
dealt into buckets by the least hash of the shorter stretches inside them: equal windows meet in one bucket and neighbours mostly
stay together, so a bucket receives runs (least hash, document, start, count) with 8 bytes for each window. Windows count as equal
if both hashes are, 128 bits: among windows that share the stretch of the least hash (any others differ in 128 bits) fewer than 2**-64
of the pairs are taken for equal wrongly, so that 10**9 windows around one stretch expect 0.03 of them.

A task sends each distinct window of a chunk once, as its earliest occurrence, and keeps a table of the windows that it has met
again, so that a window which a third of all documents hold arrives about once from each task. A bucket is folded batch by batch: it holds
the earliest occurrence of each distinct window and gives out the others at once. Stretches that a sample shows to be so common that their
windows would fill more than a bucket are split further by the window's own hash; the sample steers the dealing only, never the result.
Repeats are gathered for each document and merged into maximal intervals of removed words.

Defined results: null and empty texts have no words; a document shorter than a window loses nothing. Keys may have any type; a null key sorts
before all others; rows with one key and different texts are different documents, in the order of their texts' SHA-256, and never cut
each other's words; rows that are equal in key and text are one document and get equal results. Words of any length count whole.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.numbering import buckets, numbered
from tessitura.llm.rolling import Prefix, mix, sliding_min, words_of
from tessitura.llm.scratch import written

GRAM = 10  # words of the stretches that choose the bucket
CHUNK = 2 << 20  # bytes of text that are hashed at once; a longer document is cut into pieces that overlap by a window less one word
LONG = 1 << 16  # a longer word is replaced by a digest before it is hashed
KNOWN = 200_000  # windows that a task remembers as sent
SAMPLED = 64 << 20  # bytes of text, about, that show which stretches are common
GAP = re.compile(rb"[ \t-\r]")
SCHEMA = "bucket long, hashes binary, leasts binary, docs binary, starts binary, counts binary, gone boolean"
NONE = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int32))


def shortened(raw: bytes) -> bytes:
    """The text with every word of more than LONG bytes replaced by its digest, behind a byte that UTF-8 doesn't have."""
    out, at, last = [], 0, -1
    for lo in range(0, len(raw) + 1, CHUNK):
        b = np.frombuffer(raw[lo : lo + CHUNK], np.uint8)
        edges = np.concatenate([[last], np.flatnonzero((b == 32) | ((b >= 9) & (b <= 13))) + lo, [len(raw)] * (lo + CHUNK > len(raw))]).astype(np.int64)
        for i in np.flatnonzero(np.diff(edges) > LONG + 1):
            start, stop = int(edges[i]) + 1, int(edges[i + 1])
            out += [raw[at:start], b"\xff", hashlib.sha256(raw[start:stop]).hexdigest().encode()]
            at = stop
        last = int(edges[-1])
    return b"".join([*out, raw[at:]]) if out else raw


def pieces_of(raw: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """The text in pieces of about CHUNK bytes with the number of each one's first word; pieces share a window less one word."""
    if len(raw) > LONG:
        raw = shortened(raw)
    at, first, tail = 0, 0, b""
    while at < len(raw):
        gap = GAP.search(raw, at + CHUNK) if len(raw) - at > CHUNK else None
        stop = gap.start() if gap else len(raw)
        piece = tail + raw[at:stop]
        yield first, piece
        if stop < len(raw):
            words = piece.split()  # bytes split at 9-13 and 32 exactly
            first += max(0, len(words) - size + 1)
            tail = b" ".join(words[max(0, len(words) - size + 1) :]) + b" "
        at = stop


def chunks(batches, size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces (document, first word, bytes) in lists of about CHUNK bytes."""
    held, total = [], 0
    for b in batches:
        for doc, text in zip(b["_no"], b["_text"], strict=True):
            for first, piece in pieces_of(text.encode(), size):
                if held and total + len(piece) > CHUNK:
                    yield held
                    held, total = [], 0
                held.append((doc, first, piece))
                total += len(piece) + 1
    if held:
        yield held


def runs_of(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of maximal runs; ``same[i]``: i goes on with i - 1."""
    start = np.flatnonzero(~same)
    return start, np.diff(np.append(start, len(same)))


def window_hashes(pieces: list[tuple[int, int, bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: hash, least hash of a stretch, document and first word."""
    starts, _, tokens = words_of(b"\n".join(raw for _, _, raw in pieces))
    bounds = np.cumsum([0, *[len(raw) + 1 for _, _, raw in pieces]])
    first = np.searchsorted(starts, bounds)  # each piece's first word
    if len(tokens) < size:
        return NONE
    p = Prefix(tokens)
    least = sliding_min(p.every(min(GRAM, size)), size - min(GRAM, size) + 1)
    of = np.repeat(np.arange(len(pieces)), np.diff(first))
    at = np.flatnonzero(of[: len(tokens) - size + 1] == of[size - 1 :])
    docs, offsets = np.array([d for d, _, _ in pieces], np.int64), np.array([o for _, o, _ in pieces], np.int64)
    return p.every(size)[at], least[at], docs[of[at]], (at - first[of[at]] + offsets[of[at]]).astype(np.int32)


def repeated(h: np.ndarray, more: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those that share (h, more) with another, as indices, and for each the index of the earliest (document, place) of its group."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    at = order[many]
    at = at[np.lexsort((pos[at], doc[at], more[at], h[at]))]
    if not len(at):
        return at, at
    new = np.concatenate([[True], (h[at[1:]] != h[at[:-1]]) | (more[at[1:]] != more[at[:-1]])])
    return at, at[np.flatnonzero(new)[np.cumsum(new) - 1]]


def judged(h: np.ndarray, more: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which are the earliest of their kind (one of each), which have an earlier one at another place, and which kinds were met again."""
    at, lead = repeated(h, more, doc, pos)
    first = np.ones(len(h), bool)
    first[at] = False
    first[lead] = True
    later = np.zeros(len(h), bool)
    later[at] = (doc[at] != doc[lead]) | (pos[at] != pos[lead])
    return first, later, np.unique(lead)


class Dealer:
    """The windows of one task, chunk by chunk, as packed rows; ``hot`` maps common least hashes to the number of their shares."""

    def __init__(self, size: int, n: int, hot: tuple[np.ndarray, np.ndarray]):
        self.size, self.n, self.hot, self.known = size, np.uint64(n), hot, NONE

    def bucket(self, h: np.ndarray, least: np.ndarray) -> np.ndarray:
        names, shares = self.hot
        to = least.copy()
        if len(names):
            at = np.minimum(np.searchsorted(names, least), len(names) - 1)
            own = np.flatnonzero(names[at] == least)
            to[own] = mix(least[own] ^ mix(h[own] % shares[at[own]], 3))
        return (to % self.n).astype(np.int64)

    def rows(self, pieces: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        new = window_hashes(pieces, self.size)
        if not len(new[0]):
            return
        k = len(self.known[0])
        every = tuple(np.concatenate(x) for x in zip(self.known, new, strict=True))
        first, later, met = judged(*every)
        stay = np.union1d(met, np.flatnonzero(first[:k])) if k + len(met) <= KNOWN else met[:KNOWN]
        self.known = tuple(x[stay] for x in every)
        first[:k] = later[:k] = False  # sent before
        h, least, doc, pos = every
        to = np.flatnonzero(later)
        if len(to):
            yield self.packed(int(to[0]) % int(self.n), h[:0], least[:0], doc[to], pos[to], True)
        kept = np.flatnonzero(first)
        if not len(kept):
            return
        b = self.bucket(h[kept], least[kept])
        by = np.argsort(b, kind="stable")  # windows of a bucket stay in order of piece and place
        kept, b = kept[by], b[by]
        for at, n in zip(*runs_of(np.concatenate([[False], b[1:] == b[:-1]])), strict=True):
            own = kept[at : at + n]
            yield self.packed(int(b[at]), h[own], least[own], doc[own], pos[own], False)

    @staticmethod
    def packed(bucket: int, h, least, doc, pos, gone: bool) -> tuple:
        """Windows as runs of consecutive ones with one least hash."""
        on = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1)
        start, n = runs_of(np.concatenate([[False], on if gone else on & (least[1:] == least[:-1])]))
        return bucket, h.tobytes(), b"" if gone else least[start].tobytes(), doc[start].tobytes(), pos[start].tobytes(), n.astype(np.int32).tobytes(), gone


def unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and places of all windows of packed rows, and the windows' numbers in each run."""
    doc, pos, n = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("docs", np.int64), ("starts", np.int32), ("counts", np.int32)))
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(doc, n), (np.repeat(pos, n) + step).astype(np.int32), n


def spans_frame(doc: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    """Runs of consecutive windows: doc, first, last."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    if not len(doc):
        return pd.DataFrame({"doc": doc, "first": pos, "last": pos})
    start, n = runs_of(np.concatenate([[False], (doc[1:] == doc[:-1]) & (pos[1:] <= pos[:-1] + 1)]))
    return pd.DataFrame({"doc": doc[start], "first": pos[start], "last": pos[start + n - 1]})


def fold(batches) -> Iterator[pd.DataFrame]:
    """The later occurrences among the packed rows of one bucket; holds each distinct window once."""
    held = NONE
    for b in batches:
        gone = b["gone"].to_numpy(bool)
        doc, pos, _ = unpacked(b[gone])
        if len(doc):
            yield spans_frame(doc, pos)
        own = b[~gone]
        if not len(own):
            continue
        doc, pos, n = unpacked(own)
        h, least = (np.frombuffer(b"".join(own[c]), np.uint64) for c in ("hashes", "leasts"))
        every = tuple(np.concatenate(x) for x in zip(held, (h, np.repeat(least, n), doc, pos), strict=True))
        first, later, _ = judged(*every)
        if later.any():
            yield spans_frame(every[2][later], every[3][later])
        held = tuple(x[first] for x in every)


def common(rows: DataFrame, total: int, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hashes whose distinct windows would fill more than a bucket, and into how many shares each is split.

    Judged on about SAMPLED bytes of text; a hash is listed with at least 32 distinct windows there, so the list is bounded by the sample.
    """
    part = max(1, total // SAMPLED)

    def count(batches):
        for pieces in chunks(batches, size):
            h, least, _, _ = window_hashes(pieces, size)
            names, many = np.unique(least[np.unique(h, return_index=True)[1]], return_counts=True) if len(h) else (least, np.zeros(0, np.int64))
            yield pd.DataFrame({"least": names.view(np.int64), "n": many, "all": [int(many.sum()), *[0] * (len(many) - 1)][: len(many)]}).query("n > 4 or all > 0")

    sample = rows.where(F.pmod(F.xxhash64("_no", F.lit("common")), F.lit(part)) == 0) if part > 1 else rows
    counted = written(sample.select("_no", "_text").mapInPandas(count, "least long, n long, all long").groupBy("least").agg(F.sum("n").alias("n"), F.sum("all").alias("all")), "common")
    windows = counted.agg(F.sum("all")).first()[0] or 0
    most = max(32, windows // n)
    found = sorted((r["least"] % (1 << 64), -(-2 * r["n"] // most)) for r in counted.where(F.col("n") > most).collect())  # SAMPLED bytes / 32 rows at most
    return np.array([x for x, _ in found], np.uint64), np.array([s for _, s in found], np.uint64)


def repeated_windows(rows: DataFrame, total: int, size: int = 20) -> DataFrame:
    """Runs of repeated windows: doc, first, last (places of windows in words). ``rows``: _no, _text; ``total``: bytes of all texts."""
    n = buckets(rows, total)
    hot = rows.sparkSession.sparkContext.broadcast(common(rows, total, size, n))

    def send(batches):
        dealer = Dealer(size, n, hot.value)
        for pieces in chunks(batches, size):
            held = list(dealer.rows(pieces))
            for at in range(0, len(held), 256):
                yield pd.DataFrame(held[at : at + 256], columns=["bucket", "hashes", "leasts", "docs", "starts", "counts", "gone"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fold(batches)

    return rows.select("_no", "_text").mapInPandas(send, SCHEMA).groupBy("bucket").applyInPandas(count, "doc long, first int, last int")


def intervals(spans, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal intervals that the windows of the spans cover."""
    first, stop = (np.array([s[c] for s in spans], np.int64) for c in ("first", "last"))
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order]) + size
    new = np.concatenate([[True], first[1:] > stop[:-1]]) if len(first) else np.zeros(0, bool)
    end = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1) if len(first) else np.zeros(0, np.int64)
    return first[new], stop[end]


def kept_words(raw: bytes, spans, size: int) -> tuple[list[int], int, int, Iterator[bytes]]:
    """Words (counted as the pieces are taken), removed words and intervals of a text, and the kept text in pieces of some MB."""
    first, stop = intervals(spans if spans is not None else [], size)

    def kept() -> Iterator[bytes]:
        at = said = 0
        while at < len(raw):
            gap = GAP.search(raw, at + CHUNK) if len(raw) - at > CHUNK else None
            end = gap.start() if gap else len(raw)
            words = raw[at:end].split()
            own = words
            if len(first):
                change = np.zeros(len(words) + 1, np.int64)
                lo, hi = (np.clip(x - count[0], 0, len(words)) for x in (first, stop))
                np.add.at(change, lo, 1)
                np.add.at(change, hi, -1)
                own = [w for w, c in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not c]
            count[0] += len(words)
            if own:
                yield (b" " if said else b"") + b" ".join(own)
                said = 1
            at = end

    count: list[int] = [0]
    return count, int((stop - first).sum()), len(first), kept()


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20, texts: bool = False) -> DataFrame:
    """key, n_words, n_removed, n_spans and kept_sha256 of every document; with ``texts`` also the kept text."""
    rows, total = numbered(docs, key, text)
    spans = written(repeated_windows(rows, total, size), "repeats")
    each = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))

    @F.pandas_udf("n_words long, n_removed long, n_spans long, kept_sha256 string, kept string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, own in zip(text, spans, strict=True):
            count, removed, n_spans, kept = kept_words(t.encode(), own, size)
            sha, said = hashlib.sha256(), []
            for x in kept:
                sha.update(x)
                said += [x] if texts else []
            out.append((count[0], removed, n_spans, sha.hexdigest(), b"".join(said).decode() if texts else None))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(each, rows["_no"] == each["doc"], "left").select(F.col("_key").alias(key), cut("_text", "_spans").alias("_r"))
    out = joined.select(key, "_r.n_words", "_r.n_removed", "_r.n_spans", "_r.kept_sha256", "_r.kept")
    return out if texts else out.drop("kept")
