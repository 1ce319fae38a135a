"""Vector codes against a plain loop, and their SQL."""

import hashlib

import pytest

from tessitura.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, v int, length string, key string, code int"


def plain(rows, rounds=4):
    """Rows (id, vector, label) by plain Python: id -> (code, error, label_error), digest; one length."""
    import math

    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = -(-len(kept[0][1]) // 4)
    parts = [[(v + [0] * 4)[p * w : (p + 1) * w] for p in range(4)] for _, v, _ in kept]
    books = [[list(x[p]) for x in parts[:256]] for p in range(4)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(4):
            got = {}
            for x in parts:
                got.setdefault(near(x[p], books[p])[0], []).append(x[p])
            for j, xs in got.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[near(x[p], books[p]) for p in range(4)] for x in parts]
    error = [sum(d for _, d in f) for f in found]
    total = {}
    for (_, _, y), e in zip(kept, error, strict=True):
        total[y] = total.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(str(i), "".join(f"{j:02x}" for j, _ in f), e, total[y]) for (i, _, y), f, e in zip(kept, found, error, strict=True)]), sha


@pytest.mark.parametrize("width,n,scale", [(8, 700, 1), (6, 40, 1), (4, 300, 900), (8, 60, 2e6)])
def test_plain(spark, width, n, scale):
    import random

    rng = random.Random(width)
    rows = [(i * 7 % n, [rng.gauss(0, scale) if rng.random() < 0.9 else 0.25 for _ in range(width)], rng.choice([None, 1, 2, 2, 2])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * width, 1), (n + 2, [float("nan")] * width, 2), (n + 3, [float("-inf")] + [1.0] * (width - 1), 2), (None, [0.5] * width, None), (3, [0.5] * width, 1), (3, [0.5] * width, 1)]
    got = codes.compress(spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(3)).collect()
    inside = [(i, v if v is None else [x if x is None else max(min(x, codes.HIGH / 1024), codes.LOW / 1024) for x in v] if all(x is not None and abs(x) < 1e300 for x in v) else v, y) for i, v, y in rows]
    want, sha = plain(inside)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == want and {r["codebooks_sha256"] for r in got} == {sha}


def test_lengths_and_empty(spark):
    import random

    rng = random.Random(2)
    sets = {n: [(100 * n + i, [rng.gauss(0, 1) for _ in range(n)], n) for i in range(30)] for n in (4, 5, 12)}
    rows = [(*r, 1, "x", "y", 2) for s in sets.values() for r in s] + [(1, [], 0, 1, "x", "y", 2)]
    got = codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    for n, s in sets.items():
        want, sha = plain(s)
        own = [r for r in got if (r["vec_id"] or 0) // 100 == n]
        assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in own) == want and {r["codebooks_sha256"] for r in own} == {sha}
    assert [(r["code"], r["error"]) for r in got if r["vec_id"] == 1] == [("00000000", 0)]
    none = codes.compress(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_lengths_by_turns(spark, monkeypatch):
    rows = [(i, [float(i % 5)] * (4 * (1 + i % 3)), i % 2, 1, "x", "y", 2) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(codes.compress(table).collect())
    monkeypatch.setattr(codes, "BOOK_BYTES", 1)
    assert sorted(codes.compress(table).collect()) == whole


def test_products_beyond_64_bits():
    import numpy as np

    at, d = codes.nearest(np.array([[2**31 - 1] * 16]), np.array([[-(2**31)] * 16, [0] * 16]))
    assert at[0] == 1 and d[0] == 16 * (2**31 - 1) ** 2
