"""Vector codes: product quantisation in whole numbers.

Every component x becomes floor(1024 * x), and a vector is cut into PARTS consecutive parts. Each part position has a codebook, which starts
as that part of the vectors with the smallest keys. In every round the codebooks (ENTRIES entries for each part, so bounded) are broadcast; each task works
out the distances of its vectors to all entries by expanding the norm, |x|^2 - 2 x.b + |b|^2, as an exact product of int64 matrices, takes the
first nearest entry and returns a sum and a count for each entry it met; those meet by entry in a shuffle, and the floored mean replaces the entry. The driver
only ever holds the codebooks.

The kept vectors are written once as whole numbers, so every round reads the same rows, also after a lost executor.

Defined results: vectors that are null or hold null or non-finite components are dropped. Of rows with equal keys the smaller vector is first in the starting codebook, null
keys come last. With fewer rows than ENTRIES the codebook has an entry for each row; repeated rows make repeated entries, of which the first serves. Vectors of different
lengths have nothing to be compared by: each length has its own codebooks, and as many lengths go through the rounds together as have codebooks of BOOK_BYTES. A length that isn't a multiple of PARTS is filled up with zeros; an empty vector has code 0 and error 0. Components beyond the
range of 32-bit whole numbers after scaling (x from about two million) take the nearest number of that range, and an error, or sum of errors, beyond 64 bits is null. Products
that might pass 64 bits are worked out in Python's whole numbers instead. Further columns are ignored, and null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from tessitura.llm.scratch import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 4096  # vectors whose distances to all entries are held together
BOOK_BYTES = 64 << 20  # of codebooks that are broadcast together, if one length doesn't ask for more
LOW, HIGH = -(2**31), 2**31 - 1

Books = dict[int, list[np.ndarray]]  # of each length the codebooks of its parts, entries x components


def split(rows: np.ndarray) -> list[np.ndarray]:
    """Vectors of one length as their parts."""
    width = -(-rows.shape[1] // PARTS)
    rows = np.pad(rows, ((0, 0), (0, PARTS * width - rows.shape[1])))
    return [rows[:, p * width : (p + 1) * width] for p in range(PARTS)]


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and its squared distance, both exact."""
    part, book = part.astype(np.int64), book.astype(np.int64)
    reach = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
    if part.shape[1] * (2 * reach) ** 2 >= 2**62:
        part, book = part.astype(object), book.astype(object)
    d = (book**2).sum(1) - 2 * (part @ book.T)
    at = d.argmin(1)
    return at, d[np.arange(len(part)), at] + (part**2).sum(1)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length in a batch: the length, which rows have it and their vectors, ROWS at a time."""
    lists = batch.column("v")
    values, stops = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    lengths = batch.column("length").to_numpy()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for lo in range(0, len(rows), ROWS):
            some = rows[lo : lo + ROWS]
            yield int(n), some, values[(stops[some] - n)[:, None] + np.arange(n)]


def sums(vectors: DataFrame, books) -> DataFrame:
    """Rows (length, part, entry, n, total): count and component sums of the parts assigned to each entry, one row for each task that met the entry."""

    def partial(batches):
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for length, _, rows in by_length(batch):
                for p, (part, book) in enumerate(zip(split(rows), books.value[length], strict=True)):
                    at, _ = nearest(part, book)
                    n, sum_ = total.setdefault((length, p), (np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)))
                    order = at.argsort(kind="stable")
                    met, first = np.unique(at[order], return_index=True)
                    n += np.bincount(at, minlength=len(book))
                    sum_[met] += np.add.reduceat(part[order], first, axis=0)
        for (length, p), (n, sum_) in total.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"length": pa.array([length] * len(met), pa.int32()), "part": pa.array([p] * len(met), pa.int32()), "entry": pa.array(met, pa.int32()), "n": n[met], "total": pa.array([x.tobytes() for x in sum_[met]], pa.binary())})

    return vectors.select("length", "v").mapInArrow(partial, "length int, part int, entry int, n long, total binary")


def means(partial: DataFrame) -> DataFrame:
    """Rows (length, part, entry, mean): the floored means of all tasks' sums. The sums of an entry meet in one task, which adds them up as they come."""

    def merged(batches):
        held: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            for length, part, entry, n, total in zip(*(batch.column(c).to_pylist() for c in ("length", "part", "entry", "n", "total")), strict=True):
                before = held.get((length, part, entry), (0, 0))
                held[length, part, entry] = (before[0] + n, before[1] + np.frombuffer(total, np.int64))
        keys = np.array(list(held), np.int32).reshape(-1, 3)
        mean = [(total // n).tobytes() for n, total in held.values()]
        yield pa.RecordBatch.from_pydict({"length": keys[:, 0], "part": keys[:, 1], "entry": keys[:, 2], "mean": pa.array(mean, pa.binary())})

    return partial.repartition("length", "part", "entry").mapInArrow(merged, "length int, part int, entry int, mean binary")


def starting(vectors: DataFrame, lengths: list[int]) -> Books:
    """The parts of the vectors with the smallest keys, ENTRIES of each length."""
    order = W.partitionBy("length").orderBy(F.col("key").asc_nulls_last(), "v")
    first = vectors.where(F.col("length").isin(lengths)).select("length", "v", F.row_number().over(order).alias("at")).where(F.col("at") <= ENTRIES)
    held: dict[int, list] = {}
    for r in sorted(first.select("length", "at", "v").collect()):  # ENTRIES rows of each length, BOOK_BYTES
        held.setdefault(r["length"], []).append(r["v"])
    return {n: [x.copy() for x in split(np.array(rows, np.int64).reshape(len(rows), n))] for n, rows in held.items()}


def learned(vectors: DataFrame, lengths: list[int], rounds: int = ROUNDS) -> Books:
    """The codebooks of some lengths after all rounds."""
    spark = vectors.sparkSession
    books = starting(vectors, lengths)
    some = vectors.where(F.col("length").isin(lengths))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        for r in means(sums(some, shared)).collect():  # a row for each entry in use
            books[r["length"]][r["part"]][r["entry"]] = np.frombuffer(r["mean"], np.int64)
        shared.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def coded(vectors: DataFrame, books: Books) -> DataFrame:
    """Rows (key, label, code, error, codebooks_sha256) of the vectors whose length has codebooks."""
    shared, digests = vectors.sparkSession.sparkContext.broadcast(books), {n: digest(b) for n, b in books.items()}
    kind = StructType([vectors.schema["key"], vectors.schema["label"], StructField("code", StringType()), StructField("error", LongType()), StructField("codebooks_sha256", StringType())])

    def assign(batches):
        for batch in batches:
            for length, some, rows in by_length(batch):
                found = [nearest(part, book) for part, book in zip(split(rows), shared.value[length], strict=True)]
                text = np.stack([at for at, _ in found], 1).astype(np.uint8).tobytes().hex()
                error = [int(x) for x in sum(d.astype(object) for _, d in found)]
                own = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [own.column("key"), own.column("label"), pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]), pa.array([x if x < 2**63 else None for x in error], pa.int64()), pa.array([digests[length]] * len(some))],
                    names=kind.names,
                )

    return vectors.where(F.col("length").isin(list(books))).select("key", "label", "length", "v").mapInArrow(assign, kind)


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every vector without null or non-finite components."""
    v = F.col("v")
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(HIGH))), F.lit(float(LOW)))).cast("int"))
    rows = table.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    vectors = written(rows.select("key", "label", F.size("v").alias("length"), whole.alias("v")), "whole_vectors")
    sizes = sorted((r["length"], 8 * PARTS * -(-r["length"] // PARTS) * min(r["count"], ENTRIES)) for r in vectors.groupBy("length").count().collect())  # a row for each length
    turns: list[list[int]] = []
    room = 0
    for n, size in sizes:
        if not turns or room + size > BOOK_BYTES:
            turns.append([])
            room = 0
        turns[-1].append(n)
        room += size
    out = None
    for turn in turns:
        one = written(coded(vectors, learned(vectors, turn, rounds)), "codes")
        out = one if out is None else out.union(one)
    if out is None:
        out = coded(vectors, {})
    by_label = out.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return out.join(by_label, out["label"].eqNullSafe(by_label["_label"])).select(F.col("key").alias(key), "code", "error", "label_error", "codebooks_sha256")
