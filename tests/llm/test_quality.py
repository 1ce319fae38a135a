"""The byte network: gradients, held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest

from tessitura.llm import quality as q


def laid(texts):
    n = np.array([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(n) - n, n


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 104, n).astype(np.uint8)) for n in (0, 3, 200, 256, 700)]
    y, weight = np.array([0, 1, 1, 0, 1]), np.array([1.0, 2, 1, 1, 0.5])
    net = q.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, starts, n = laid(texts)
    text, at, parts = q.slices(n)
    rows = q.gathered(data, starts, n, text, at)

    def loss():
        net.tables()
        p = 1 / (1 + np.exp(-net.heads(net.pooled(*rows).astype(np.float64), parts)[-1]))
        return -(weight * np.where(y, np.log(p), np.log(1 - p))).sum() / weight.sum()

    net.tables()
    net.pairs = [x.astype(np.float32) for x in net.pairs]
    tables = net.tables
    net.tables = lambda: (tables(), setattr(net, "pairs", [x.astype(np.float32) for x in net.pairs]))
    grads = net.step(*rows, parts, y, weight)
    for name, at_ in (("out", 0), ("out", 1), ("w2", 3), ("b1", 2), ("w1", (2, 3)), ("bias", 4), ("filters", (1, 98, 5)), ("filters", (3, 100, 2))):
        before, step = net.p[name][at_], 2e-3
        net.p[name][at_] = before + step
        up = loss()
        net.p[name][at_] = before - step
        down = loss()
        net.p[name][at_] = before
        assert abs((up - down) / (2 * step) - grads[name][at_]) < 2e-3, name


def test_whole_text_and_any_slicing(monkeypatch):
    """A response anywhere counts, plain pooling agrees, and how many slices are held at once changes nothing."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 3, 255, 256, 257, 511, 512, 513, 5000)]
    net = q.Network()
    got = net.score(*laid(texts))
    f = net.p["filters"]
    for t, s in zip(texts, got, strict=True):
        b = np.frombuffer(t + bytes(q.WIDTH - 1) if t else bytes(q.WIDTH), np.uint8)
        r = np.stack([sum(f[w, b[i + w]] for w in range(q.WIDTH)) for i in range(max(1, len(t)))])
        cut = [r[i : i + 2 * q.STEP] for i in range(0, len(r), q.STEP)]
        x = np.maximum(np.stack([c.max(0) for c in cut]) + net.p["bias"], 0)
        z = np.maximum(x @ net.p["w1"] + net.p["b1"], 0) @ net.p["w2"]
        want = 1 / (1 + np.exp(-(net.p["out"][0] * z.max() + net.p["out"][1] * z.mean() + net.p["out"][2])))
        assert abs(want - s) < 1e-5
    monkeypatch.setattr(q, "SLICES", 3)
    assert np.allclose(net.score(*laid(texts)), got, atol=1e-6)
    last = b"abc " * 3000
    assert net.score(*laid([last]))[0] != net.score(*laid([last + b"\xff\xfe\xfd\xfc"]))[0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in q.classify(docs.withColumn("score", docs["doc_id"]).withColumn("_key", docs["doc_id"]), labels.withColumn("text", labels["toxic"])).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    known = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    good, bad = ([s for s, y in known if y == k] for k in (1, 0))
    auc = np.mean([a > b for a in good for b in bad])
    assert auc > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.97 and all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())


LABELS = "doc_id long, quality int, text int, score double"


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1, 0, 0.0), (99, 0, 0, 0.0)], 1.0), ([(1, None, 0, 0.0), (None, 1, 0, 0.0), (1, 7, 0, 0.0)], 0.5)])
def test_without_two_classes(spark, frame, labels, score):
    out = q.classify(frame(["a", None], [1, None]), spark.createDataFrame(labels, LABELS)).collect()
    assert [(r["score"], r["predicted"]) for r in out] == [(score, int(score >= 0.3))] * 2


def test_edges(spark, frame):
    texts = ["good words here and there"] * 3 + ["BAD!! BAD!! BAD!!"] * 3 + [None, "", "x" * 300_000, "é\x00"] + ["BAD!! " * 9]
    ids = [1, 2, 3, 6, 7, 8, None, None, 12, 13, 6]
    labels = [(1, 1, 0, 0.0), (2, 1, 0, 0.0), (2, 0, 0, 0.0), (6, 0, 0, 0.0), (7, 0, 0, 0.0), (13, 1, 0, 0.0), (1, 1, 0, 0.0)]
    out = q.classify(frame(texts, ids), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[None]) == 1 and by[1] == by[3] and max(by[7]) < min(by[3])
    assert q.classify(frame([]), spark.createDataFrame(labels, LABELS)).count() == 0
