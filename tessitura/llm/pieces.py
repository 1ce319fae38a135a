"""SentencePiece encoding and decoding through a table of distinct marked words.

In a model no piece of which holds a whitespace mark behind another character, no merge can cross from one marked word
to the next. A text is therefore cut into marked words (a run of marks with what follows up to the next mark), each
distinct word is segmented once and its ids are joined back by position.

Words are counted over all texts (each task counts its own first). The most frequent ones, as many as ``table_entries`` allows, are segmented once each
and their table, whose size is bounded by that number, is sent to every task, where the ids of a text are put together by position. The other words,
of which each occurs a few times in the whole corpus, are left: with ``whole`` each of them is segmented once as well, and goes back to the texts
that hold it through two joins; without it they are segmented where they stand, by a table that each task keeps and empties at ``table_entries`` words.
Either way gives the same ids; which words are in which table changes time only.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; the mark itself
(U+2581) in a text is a space, as for the library. Repeated rows get equal results; keys may be null and of any type, and rows with one key are each
encoded; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.numbering import numbered
from tessitura.llm.scratch import written

MARK = "▁"
CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
ENTRIES = 200_000  # words of a table, some 200 bytes each in a worker
LONGEST = 256  # characters of a word that the shared table takes, so that its size in bytes is bounded too


class ChunkTable:
    """Ids of marked words, each distinct word segmented once; ``shared``: words that were segmented before (ids, and what they decode to if not to themselves)."""

    def __init__(self, model_path: str, entries: int = ENTRIES, shared: tuple[dict, dict] = ({}, {})):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for i in range(self.sp.get_piece_size()):
            if MARK in self.sp.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece of this model crosses whitespace marks; its words can't be segmented one by one")
        self.entries, self.shared, self.shared_odd, self.ids, self.odd = entries, *shared, {}, {}
        self.mark_id = self.sp.piece_to_id(MARK)
        self.lead = self.sp.piece_to_id(MARK + "a")
        self.lead_len = len(self.sp.decode([self.lead]))

    def segmented(self, words: list[str]) -> Iterator[tuple[str, str, str | None]]:
        """Of each word its ids, comma-joined, and what they decode to, if that isn't the word."""
        coded = self.sp.encode([w[1:].replace(MARK, " ") for w in words], num_threads=1)
        coded = [c or [self.mark_id] for c in coded]
        back = self.sp.decode([[self.lead, *c] for c in coded], num_threads=1) if words else []
        for w, c, b in zip(words, coded, back, strict=True):
            said = b[self.lead_len :]
            yield w, ",".join(map(str, c)), said if said != w.replace(MARK, " ") else None

    def add(self, words: set[str]) -> None:
        for w, ids, odd in self.segmented(list(words)):
            self.ids[w] = ids
            if odd is not None:
                self.odd[w] = odd

    def code(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text its ids, comma-joined, and the text that they decode to."""
        step, at = 64, 0
        while at < len(texts):
            cut = [CHUNK.findall(MARK + t) if t else [] for t in texts[at : at + step]]
            if len(self.ids) > self.entries:
                self.ids, self.odd = {}, {}
            shared, own = self.shared, self.ids
            if new := {w for c in cut for w in c if w not in shared and w not in own}:
                self.add(new)
            odd = self.odd | self.shared_odd if self.odd else self.shared_odd
            for text, c in zip(texts[at : at + step], cut, strict=True):
                said = (text or "").replace(MARK, " ")
                if odd and not odd.keys().isdisjoint(c):
                    said = "".join([odd[w] if w in odd else w.replace(MARK, " ") for w in c])[1:]
                yield ",".join([shared[w] if w in shared else own[w] for w in c]), said
            at += step


def words_of(text: str | None) -> list[str]:
    return CHUNK.findall(MARK + text) if text else []


def counted_words(texts: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(word, n): the distinct marked words of all texts (column _text) and how often they occur."""

    def count(batches):
        held: Counter[str] = Counter()
        for b in batches:
            for t in b["_text"]:
                held.update(words_of(t))
                if len(held) > entries:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return texts.select("_text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def level():
    return F.floor(F.log2("n") * 8).cast("int")


def tables(counts: DataFrame, model_path: str, entries: int = ENTRIES) -> tuple[DataFrame, DataFrame]:
    """The words' ids, (word, ids, odd): of the most frequent words, ``entries`` at most, and of all others. ``counts``: word, n (a written table)."""
    short = F.length("word") <= LONGEST
    sizes = counts.where(short).groupBy(level().alias("level")).count().orderBy(F.desc("level")).collect()  # 512 rows at most
    least, total = 1 << 20, 0
    for r in sizes:
        total += r["count"]
        if total > entries:
            break
        least = r["level"]

    def segment(batches):
        table = ChunkTable(model_path)
        for b in batches:
            yield pd.DataFrame(list(table.segmented(b["word"].tolist())), columns=["word", "ids", "odd"])

    head = short & (level() >= least)
    return tuple(counts.where(c).select("word").mapInPandas(segment, "word string, ids string, odd string") for c in (head, ~head))


def coded(docs: DataFrame, model_path: str, key: str, text: str, entries: int, whole: bool, result, schema: str) -> DataFrame:
    """``key`` and what ``result`` makes of each text's (ids, decoded), in the columns of ``schema``."""
    spark, columns = docs.sparkSession, [c.strip().split(" ")[0] for c in schema.split(",")]
    if whole:
        rows = numbered(docs, key, text)[0]
    else:
        rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    counts = written(counted_words(rows, entries), "words")
    head, tail = tables(counts, model_path, entries)
    head = written(head, "word_ids").toPandas()  # ``entries`` words of LONGEST characters at most
    odd = head[head["odd"].notna()]
    shared = spark.sparkContext.broadcast((dict(zip(head["word"], head["ids"], strict=True)), dict(zip(odd["word"], odd["odd"], strict=True))))
    if whole:

        def rare(batches):
            known = shared.value[0]
            for b in batches:
                found = [(n, w) for n, t in zip(b["_no"], b["_text"], strict=True) for w in {w for w in words_of(t) if w not in known}]
                if found:
                    yield pd.DataFrame(found, columns=["_of", "word"])

        met = rows.select("_no", "_text").mapInPandas(rare, "_of long, word string").distinct().join(tail, "word")
        own = written(met.groupBy("_of").agg(F.collect_list(F.struct("word", "ids", "odd")).alias("_own")), "rare_words")
        rows = rows.join(own, rows["_no"] == own["_of"], "left").select("_key", "_text", "_own")

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = ChunkTable(model_path, entries, shared.value)
        for texts, rest in batches:
            if whole:
                got = []
                for t, own in zip(texts, rest, strict=True):
                    own = own if own is not None else []
                    table.ids, table.odd = {x["word"]: x["ids"] for x in own}, {x["word"]: x["odd"] for x in own if x["odd"] is not None}
                    got += table.code([t])
            else:
                got = table.code(texts.tolist())
            yield pd.DataFrame([result(i, d) for i, d in got], columns=columns)

    out = rows.select(F.col("_key").alias(key), run("_text", "_own" if whole else F.lit(0)).alias("_r"))
    return out.select(key, *[f"_r.{c}" for c in columns])


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", table_entries: int = ENTRIES, whole: bool = False) -> DataFrame:
    """``key``, ``ids`` (array<int>) and ``decoded`` of every row."""
    return coded(docs, model_path, key, text, table_entries, whole, lambda ids, said: ([int(x) for x in ids.split(",")] if ids else [], said), "ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", table_entries: int = ENTRIES, whole: bool = False) -> DataFrame:
    """``encode_decode`` with only the count and the SHA-256 of ids and decoded text carried out of the worker."""

    def result(ids, said):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return ids.count(",") + 1 if ids else 0, sha(ids), sha(said)

    return coded(docs, model_path, key, text, table_entries, whole, result, "n_tokens long, ids_sha256 string, decoded_sha256 string")
