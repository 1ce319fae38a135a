"""Embedding links against brute force."""

import numpy as np
import pytest

from tessitura.llm import vectors


def brute(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = {i: set() for i, _ in rows}
    u = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    for a, b in zip(*np.nonzero(u @ u.T >= threshold), strict=True):
        if a != b:
            links[ids[a]].add(ids[b])
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += links[x]
    return links, root


@pytest.mark.parametrize("block", [2048, 16])
def test_links(spark, sf, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    dim = len(table[0][1])
    rng = np.random.default_rng(1)
    for k in range(40):
        table.append((10_000 + k, [float(np.float32(x)) for x in np.array(table[k][1]) + rng.normal(0, 0.02, dim)]))
    table += [(20_000, None), (20_001, [0.0] * dim), (20_002, [float("nan")] + [1.0] * (dim - 1)), (20_003, [None] + [1.0] * (dim - 1)), (20_004, [float("inf")] * dim), (20_005, table[0][1]), (20_006, table[0][1]), (20_007, [2 * x for x in table[1][1]])]
    df = spark.createDataFrame([(i, v, None, "x", 1, 2) for i, v in table], "vec_id long, embedding array<float>, label int, v string, n long, cell int").repartition(3)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    links, root = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in table])
    assert set(got) == set(links)
    assert all(got[i]["n_links"] <= len(links[i]) for i in links)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(map(len, links.values()))
    assert sum(got[i]["component_id"] == root[i] for i in root) >= 0.97 * len(root)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("noise", [0.001, 0.1])
def test_large_group(spark, noise):
    """One group of near copies with a third of the rows doesn't lower the recall of the others."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1400, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = rng.normal(size=(600, 64))
    close = base[:600] + 0.42 * step / np.linalg.norm(step, axis=1)[:, None]
    step = rng.normal(size=(1000, 64))
    hot = base[-1] + noise * step / np.linalg.norm(step, axis=1)[:, None]
    rows = np.concatenate([base, close, hot])
    order = rng.permutation(len(rows))
    table = [(int(i), rows[at].tolist()) for i, at in enumerate(order)]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    links, _ = brute(table)
    rest = [i for i, at in enumerate(order) if at < 1399 or 1400 <= at < 2000]
    want, have = sum(len(links[i]) for i in rest), sum(got[i]["n_links"] for i in rest)
    assert have >= 0.98 * want


def test_vectors_of_any_length(spark):
    """Each length links within itself; of one component only the sign counts; whole groups without ids stay whole."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 3)).tolist()
    table = [(i, v) for i, v in enumerate(base)] + [(100 + i, [2 * x for x in base[i]]) for i in range(5)]
    table += [(200, [1.0]), (201, [2.0]), (202, [-3.0]), (203, [0.0]), (204, []), (205, [1.0, 1.0]), (206, [3.0, 3.0]), (207, [1.0, -1.0])]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)).collect()}
    links, root = {}, {}
    for size in (1, 2, 3):
        some, roots = brute([(i, v) for i, v in table if len(v) == size])
        links |= some
        root |= roots
    links[204], root[204] = set(), 204
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r["component_id"] for i, r in got.items()} == root


def test_recall_without_neighbours(spark):
    """Where the sample has no pairs, recall is measured on planted ones: what few pairs there are is found."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(3000, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    keep = [0]
    for i in range(1, len(base)):
        if (base[keep] @ base[i] < 0.85).all():
            keep.append(i)
    base = base[keep][:1500]
    step = rng.normal(size=(30, 16))
    step -= (step * base[:30]).sum(1, keepdims=True) * base[:30]
    near = 0.92 * base[:30] + (1 - 0.92**2) ** 0.5 * step / np.linalg.norm(step, axis=1)[:, None]
    table = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    links, _ = brute(table)
    assert sum(got.values()) >= 0.95 * sum(map(len, links.values())) > 0 and all(got[i] <= len(links[i]) for i in got)
