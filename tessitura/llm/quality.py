"""A byte-level convolutional network in numpy that tells good texts from bad ones.

A text is its UTF-8 bytes. FILTERS learned filters of WIDTH bytes (a weight for each byte at each of its places) pass over every place of the whole text.
Their responses are max-pooled over chunks of two STEPs, each of which overlaps the next by one; a chunk's maxima go through a hidden layer
to the chunk's score, and the greatest and the mean score of a text's chunks are combined into one probability. Since a byte is one of 256, the
filters of two neighbouring places are one table by pair of bytes, so a response is WIDTH / 2 look-ups and additions.

The network is fitted by back-propagation with Adam on a bounded sample of labelled rows: of each label the ``rows`` rows with the smallest hash, of at most TEXT_BYTES
bytes each, shorter texts and longer ones alike otherwise; classes weigh as many rows as they have in all labelled rows, so scores are probabilities. Every text is scored over all its bytes, in slices of
bounded size however long it is.

Defined results: null and empty texts are scored like a text of one zero byte. Labels other than 0 and 1, null labels and null keys teach nothing; a document with both
labels teaches both; labels without a document nothing. With a single class every score is that class, without labels 0.5. Repeated rows are scored alike. Bytes that
aren't UTF-8 are bytes like others. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessitura.llm.scratch import written

WIDTH, FILTERS, HIDDEN, STEP = 4, 16, 16, 256
ROWS, TEXT_BYTES = 1000, 64 << 10  # of the sample: rows of a label, bytes of a text
EPOCHS, BATCH, RATE = 14, 32, 0.01
SLICES = 64  # slices whose responses are held together
THRESHOLD = 0.3


def slices(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of those lengths, cut into slices of STEP bytes, one at least: which text, which slice of it, and the number of slices of each text."""
    n = np.maximum(1, -(-lengths // STEP))
    text = np.repeat(np.arange(len(lengths)), n)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n), n


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some slices with the WIDTH - 1 that follow, zeros beyond the text, and which of their places are the text's."""
    place = (at * STEP)[:, None] + np.arange(STEP + WIDTH - 1)
    inside = place < lengths[text][:, None]
    if not len(data):
        data = np.zeros(1, np.uint8)
    out = np.where(inside, data[np.minimum(starts[text][:, None] + place, len(data) - 1)], 0).astype(np.uint8)
    inside[:, 0] = True
    return out, inside[:, :STEP]


class Network:
    """filters: WIDTH x 256 x FILTERS; bias: FILTERS; hidden layer w1, b1; chunk score w2; text: weights of the greatest and the mean score and a bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
            "out": np.array([0.5, 0.5, 0.0], np.float32),
        }
        self.pairs: list[np.ndarray] = []

    def tables(self) -> None:
        """The filters of places 2i and 2i + 1 as one table by pair of bytes for each filter."""
        f = self.p["filters"]
        self.pairs = [np.ascontiguousarray((f[i][:, None, :] + f[i + 1][None, :, :]).reshape(65536, -1).T) for i in range(0, WIDTH, 2)]

    def pooled(self, rows: np.ndarray, inside: np.ndarray, places: bool = False):
        """The greatest response of each filter in each slice and, if asked for, its place."""
        pair = rows[:, :-1].astype(np.intp) * 256 + rows[:, 1:]
        keys = [pair[:, i : i + STEP] for i in range(0, WIDTH, 2)]
        keys = [np.ascontiguousarray(k) if inside.all() else np.where(inside, k, k[:, :1]) for k in keys]  # a place beyond the text repeats the slice's first one
        out = np.empty((len(rows), FILTERS), np.float32)
        at = np.empty((len(rows), FILTERS), np.int64) if places else None
        response, more = np.empty(keys[0].shape, np.float32), np.empty(keys[0].shape, np.float32)
        for k in range(FILTERS):
            self.pairs[0][k].take(keys[0], out=response, mode="clip")
            for table, key in zip(self.pairs[1:], keys[1:], strict=True):
                response += table[k].take(key, out=more, mode="clip")
            response.max(1, out=out[:, k])
            if places:
                at[:, k] = response.argmax(1)
        return (out, at) if places else out

    def heads(self, pooled: np.ndarray, n: np.ndarray):
        """From the slices' maxima of texts with n slices each: chunks, hidden layer, chunk scores, place and value of the greatest, mean, logit."""
        first = np.cumsum(n) - n
        last = np.zeros(len(pooled), bool)
        last[first + n - 1] = True
        after = np.where(last, np.arange(len(pooled)), np.arange(len(pooled)) + 1)  # a chunk is a slice and the next of the same text
        second = pooled[after] > pooled
        chunk = np.where(second, pooled[after], pooled)
        x = np.maximum(chunk + self.p["bias"], 0)
        h = np.maximum(x @ self.p["w1"] + self.p["b1"], 0)
        z = h @ self.p["w2"]
        top = np.maximum.reduceat(z, first)
        mean = np.add.reduceat(z.astype(np.float64), first) / n
        logit = self.p["out"][0] * top + self.p["out"][1] * mean + self.p["out"][2]
        return after, second, x, h, z, top, mean, logit

    def step(self, rows, inside, n, y, weight) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss of one batch."""
        self.tables()
        pooled, place = self.pooled(rows, inside, True)
        after, second, x, h, z, top, mean, logit = self.heads(pooled, n)
        p = 1 / (1 + np.exp(-logit))
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        text = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        peak = np.zeros(len(z), bool)
        best = np.lexsort((-z, text))[first]  # the first of each text: its greatest score
        peak[best] = True
        dz = (d * self.p["out"][1] / n)[text].astype(np.float32) + np.where(peak, (d * self.p["out"][0])[text], 0).astype(np.float32)
        g = {"out": np.array([(d * top).sum(), (d * mean).sum(), d.sum()], np.float32), "w2": h.T @ dz}
        dh = np.outer(dz, self.p["w2"]) * (h > 0)
        g["w1"], g["b1"] = x.T @ dh, dh.sum(0)
        dx = (dh @ self.p["w1"].T) * (x > 0)
        g["bias"] = dx.sum(0)
        back = np.zeros_like(dx)
        np.add.at(back, np.arange(len(dx)), np.where(second, 0, dx))
        np.add.at(back, after, np.where(second, dx, 0))
        g["filters"] = np.zeros_like(self.p["filters"])
        r, k = np.nonzero(back)
        for w in range(WIDTH):
            np.add.at(g["filters"][w], (rows[r, place[r, k] + w], k), back[r, k])
        return g

    def score(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each text; ``data`` holds them at ``starts``."""
        if not self.pairs:
            self.tables()
        text, at, n = slices(lengths)
        pooled = np.empty((len(text), FILTERS), np.float32)
        for lo in range(0, len(text), SLICES):
            pooled[lo : lo + SLICES] = self.pooled(*gathered(data, starts, lengths, text[lo : lo + SLICES], at[lo : lo + SLICES]))
        return 1 / (1 + np.exp(-self.heads(pooled, n)[-1])) if len(n) else np.zeros(0)


def trained(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network fitted to texts and their labels of 0 and 1."""
    net, rng = Network(seed), np.random.default_rng(seed)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    t = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            lengths = np.array([len(texts[i]) for i in some])
            data = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
            text, at, n = slices(lengths)
            grads = net.step(*gathered(data, np.cumsum(lengths) - lengths, lengths, text, at), n, labels[some], weights[some])
            t += 1
            for k, g in grads.items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                net.p[k] -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    net.tables()
    return net


def held_out(key: str = "doc_id"):
    """Rows that are kept from learning: crc32 of the key's text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS) -> Network | float:
    """A network from a bounded sample of the labelled rows; a constant score where there aren't two classes.

    Keys and labels meet without the texts; only the texts of the keys drawn (2 x ``rows``) are read.
    """
    named = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    small = F.octet_length(F.coalesce(F.col(text), F.lit(""))) <= TEXT_BYTES
    there = docs.where(small).select(F.col(key).alias("_own")).groupBy("_own").agg(F.count("*").alias("_n"))
    facts = written(named.groupBy("_key", "_label").agg(F.count("*").alias("_times")).join(there, F.col("_key") == F.col("_own")).select("_key", "_label", (F.col("_n") * F.col("_times")).alias("_n")), "labelled")
    total = {r["_label"]: r["n"] for r in facts.groupBy("_label").agg(F.sum("_n").alias("n")).collect()}
    if len(total) < 2:
        return float(next(iter(total), 0.5))
    keys = [facts.where(F.col("_label") == y).orderBy(F.xxhash64("_key", F.lit("quality sample")), "_key").limit(rows).select("_key", "_label") for y in (0, 1)]
    drawn = F.broadcast(keys[0].union(keys[1]))  # 2 x rows keys
    own = docs.where(small).select(F.col(key).alias("_own"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text")).join(drawn, F.col("_own") == F.col("_key"))
    own = written(own.select("_label", "_text", F.xxhash64("_key", "_text").alias("_hash")), "quality_sample")
    got = [own.where(F.col("_label") == y).orderBy("_hash", "_text").limit(rows) for y in (0, 1)]
    found = [(bytes(r["_text"]), r["_label"]) for g in got for r in g.select("_text", "_label").toLocalIterator()]  # 2 x rows texts of TEXT_BYTES at most
    y = np.array([x for _, x in found])
    share = np.array([total[0], total[1]]) / np.bincount(y, minlength=2)
    return trained([t for t, _ in found], y, share[y] / share[y].mean())


def scored(docs: DataFrame, model: Network | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score)."""
    if isinstance(model, float):
        return docs.select(key, F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model.p)  # a network, whatever the data

    def run(batches):
        net = Network()
        net.p = shared.value
        for b in batches:
            texts = b.column("text")
            _, bounds, data = texts.buffers()
            bounds = np.frombuffer(bounds, np.int32 if pa.types.is_binary(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(net.score(data, bounds[:-1], np.diff(bounds)))], names=[key, "score"])

    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, StructType([docs.schema[key], StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score (probability of label 1) and predicted of every document."""
    out = scored(docs, fit(docs, labels, key, text, label), key, text)
    return out.select(F.col(key), held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
