"""Phrase collocations of each language through suffix automata.

Each task lays the pieces of its texts end to end, SHARD words of a language at a time, and builds a suffix automaton of bounded depth over them
(``automaton``). Its phrases with their endpos counts are the shard's result; counts meet by phrase in a shuffle.

Levels: the first pass counts words and phrases of two words. A phrase of k words can only be frequent if both phrases of k - 1 words in it are, the one
its suffix link leads to and the one that the last word continues, so pass k enumerates only places where both may be: they are looked up in a
hashed bit table of the frequent ones, whose size follows their number (BITS_EACH bits each) up to MOST_BITS. What the table lets through by mistake is counted and
dropped like any rare phrase, so nothing is lost, whatever the table's size; a full table only saves less.

Subsumption follows the links too: a phrase is inside every phrase whose link, or whose start, it is; of longer ones around it the fullest is always one word longer.

Defined results: null texts are empty; a null language is ``und``, like one of that name; bytes that aren't UTF-8 stay as they are within a word; a language without a frequent
phrase has no rows; repeated rows count each time; keys and further columns are ignored. Scores and counts are exact: they are divided as whole numbers of 38 digits.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessitura.llm.automaton import Automaton
from tessitura.llm.scratch import small_batches, written

UNKNOWN = "und"
SHARD = 1_000_000  # words of one language in an automaton
ROWS = 100_000  # phrases that are handed over at once
BITS_EACH, LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 20, 29, 20  # of a bit table: bits for each phrase; exponents of its least and largest size and of the part that one group builds
SALTS = 64  # groups of a language that are ranked apart first
CUT = b"."  # stands between pieces; never part of a word
TABLE = bytes(ord(CUT) if c in b".,;:!?\n\x0b\x0c\r" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "lang string, size int, phrase binary, n long"


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, with CUT between pieces."""
    return text.translate(TABLE).replace(CUT, b" . ").split(b" ")


def mixed(parts: list[np.ndarray], lang: str, bits: int) -> np.ndarray:
    """Place in a table of 2**bits for each phrase, from the hashes of its words."""
    h = np.full(len(parts[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def places(batches, bits: int):
    """Rows (chunk, at): the bits to set for some phrases, by part of the table."""
    for b in batches:
        for lang in pc.unique(b.column("lang")).to_pylist():
            own = b.filter(pc.equal(b.column("lang"), lang)).column("phrase").to_pylist()
            ws = [p.split(b" ") for p in own]
            at = np.unique(mixed([np.array([xxhash.xxh64_intdigest(w[i]) for w in ws], np.uint64) for i in range(len(ws[0]))], lang, bits)) if ws else np.zeros(0, np.uint64)
            chunk, first = np.unique(at >> np.uint64(CHUNK_BITS), return_index=True)
            parts = np.split((at & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint32), first[1:])
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk.astype(np.int32)), "at": pa.array([x.tobytes() for x in parts][: len(chunk)], pa.binary())})


def bit_table(frequent: DataFrame) -> tuple[int, np.ndarray]:
    """The exponent of the table's size and its bytes; ``frequent``: lang, phrase of phrases of one length."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * frequent.count()).bit_length()))

    def merged(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, at in zip(b.column("chunk").to_pylist(), b.column("at").to_pylist(), strict=True):
                held.setdefault(chunk, np.zeros(1 << CHUNK_BITS, bool))[np.frombuffer(at, np.uint32)] = True
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(held), pa.int32()), "bits": pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())})

    rows = frequent.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(lambda batches: places(batches, bits), "chunk int, at binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.repartition("chunk").mapInArrow(merged, "chunk int, bits binary").toLocalIterator():  # 2**MOST_BITS bits at most
        lo = r["chunk"] << (CHUNK_BITS - 3)
        out[lo : lo + (1 << (CHUNK_BITS - 3))] = np.frombuffer(r["bits"], np.uint8)
    return bits, out


class Shard:
    """Words of one language, numbered as they are met."""

    def __init__(self, lang: str):
        self.lang, self.size, self.parts = lang, 0, []
        self.numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        assert self.numbers[CUT] == 0  # the automaton's gap

    def add(self, text: bytes) -> None:
        ws = [w for w in tokens(text) if w]
        self.parts.append(np.array([*map(self.numbers.__getitem__, ws), 0], np.int32))
        self.size += len(ws)

    def hashes(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w) for w in self.numbers], np.uint64)

    def rows(self, sizes: list[int], known):
        """Phrases of the given numbers of words with their counts; ``known``: the bit table for those one word shorter."""
        words = np.concatenate(self.parts)
        ends = None
        if known:
            bits, table = known
            k, h = sizes[0] - 1, self.hashes()[words]
            if len(words) <= k:
                return
            at = mixed([h[i : len(words) - k + 1 + i] for i in range(k)], self.lang, bits)
            may = (table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1  # of the phrase that ends at k - 1 + i
            ends = np.flatnonzero(may[1:] & may[:-1]) + k
            ends = ends[words[ends] != 0]
        elif 1 in sizes:
            yield pa.RecordBatch.from_pydict({"lang": [self.lang], "size": pa.array([0], pa.int32()), "phrase": pa.array([b""], pa.binary()), "n": [int((words != 0).sum())]})
        found, names = Automaton(words, sizes[-1], ends), pa.array(list(self.numbers), pa.binary())
        for k in sizes:
            columns, count = found.phrases(k), found.count[k - 1]
            for lo in range(0, len(count), ROWS):
                text = [names.take(pa.array(c[lo : lo + ROWS])) for c in columns]
                phrase = pc.binary_join_element_wise(*text, pa.scalar(b" ")) if k > 1 else text[0]
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(phrase)), pa.array(np.full(len(phrase), k, np.int32)), phrase, pa.array(count[lo : lo + ROWS])], names=["lang", "size", "phrase", "n"])


def counted(texts: DataFrame, sizes: list[int], least: int, known=None) -> DataFrame:
    """Rows (lang, size, phrase, n) of all phrases of those sizes with ``least`` places or more; in the first pass also the number of words, size 0."""
    shared = texts.sparkSession.sparkContext.broadcast(known)  # 2**MOST_BITS bits at most

    def shards(batches):
        held: dict[str, Shard] = {}
        total = 0
        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text"), strict=True):  # one text at a time: the batch isn't copied
                lang = lang.as_py()
                if lang not in held:
                    held[lang] = Shard(lang)
                shard = held[lang]
                before = shard.size
                shard.add(text.as_py())
                total += shard.size - before
                if shard.size >= SHARD:
                    total -= shard.size
                    yield from held.pop(lang).rows(sizes, shared.value)
                elif total >= 2 * SHARD:  # many languages
                    for name in list(held):
                        yield from held.pop(name).rows(sizes, shared.value)
                    total = 0
        for shard in held.values():
            yield from shard.rows(sizes, shared.value)

    rows = texts.mapInArrow(shards, SCHEMA).groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))
    with small_batches(texts.sparkSession):
        return written(rows.where((F.col("size") == 0) | (F.col("n") >= least)), "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    ``least``: occurrences of a candidate; ``share``: percent of a phrase's occurrences inside a longer candidate from which it is dropped.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    every = counted(texts, [1, 2], least)
    for k in range(3, longest + 1):
        shorter = every.where(F.col("size") == k - 1)
        every = every.unionByName(counted(texts, [k], least, bit_table(shorter)))
    known = every.where("size > 0").select("lang", "phrase", "size", "n")
    ws = F.split("phrase", " ")
    phrases = known.where("size > 1")
    cuts = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.array_join(F.slice(ws, F.lit(1), F.col("k")), " ")).withColumn("tail", F.array_join(F.slice(ws, F.col("k") + 1, F.col("size")), " "))
    heads, tails = (known.select(F.col("lang").alias(f"{c}_lang"), F.col("phrase").alias(f"{c}_phrase"), F.col("n").alias(c)) for c in ("l", "r"))
    cuts = cuts.join(heads, (cuts["lang"] == heads["l_lang"]) & (cuts["head"] == heads["l_phrase"])).join(tails, (cuts["lang"] == tails["r_lang"]) & (cuts["tail"] == tails["r_phrase"]))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = cuts.select("lang", "phrase", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(38,0)") * wide("a") * wide("a")).alias("over"), (wide("l") * wide("r")).alias("under")).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.score", "b.l", "b.r")
    inner = phrases.where("size > 2").select(F.col("lang").alias("_lang"), "n", F.explode(F.array(F.array_join(F.slice(ws, F.lit(2), F.col("size")), " "), F.array_join(F.slice(ws, F.lit(1), F.col("size") - 1), " "))).alias("_phrase"))
    inner = inner.groupBy("_lang", "_phrase").agg(F.max("n").alias("longer"))
    best = best.join(inner, (best["lang"] == inner["_lang"]) & (best["phrase"] == inner["_phrase"]), "left").where(F.col("longer").isNull() | (100 * wide("longer") < share * wide("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = best.select("lang", "phrase", "a", "l", "r", "score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = every.where("size = 0").select(F.col("lang").alias("_of"), F.col("n").alias("n"))
    return best.join(total, best["lang"] == total["_of"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
