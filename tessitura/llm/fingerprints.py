"""SimHash fingerprints and exact near-duplicate links through vantage-point trees.

A fingerprint is the bitwise majority of the XXH64 hashes of a document's word shingles. Two fingerprints that differ in at most
``radius`` bits differ in at most ``radius // 2`` bits in one of their halves, so two trees are built, one over each 32-bit half.
Each tree splits by Hamming distance to a vantage point at the median distance; a fingerprint has one home shard and is
also sent as a query to every shard that the triangle inequality can't exclude (its distance to the vantage point lies within the
half's radius of the boundary). The upper levels are made on the driver from a bounded sample of fingerprints and shared; the
lower ones are made inside each shard. Every pair within the radius therefore meets in a shard and is verified on all 64 bits.

A shard returns a spanning forest of its links, never all pairs of a group, and exact copies are one fingerprint throughout.
Shards with many rows are cut into a grid of home blocks and query blocks, each pair of blocks being one group of bounded size.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle holds make one shingle of the
whole sequence; repeated rows get equal results; the component's id is the smallest key that is reachable, and null keys are left out of that minimum.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators.components import components
from tessitura.llm.numbering import with_numbers
from tessitura.llm.scratch import partitions, written

WORD = re.compile(r"[^ \t-\r]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SAMPLE = 16_384  # fingerprints that the upper levels are made from, at least; 16 for each shard beyond that
DEPTH = 15  # upper levels at most: 32,768 shards
SHALLOW = 5  # upper levels where equal own bits are all that can meet; hashes split further
LEAF = 192  # homes that are compared directly
BLOCK = 3072  # rows of a grid block
SHARD = 2048  # rows of a shard of equal own bits, at about
QUERY, HOME, BOTH = 0, 1, 2  # what a row is in its cell
MIX, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BANDS, DEEP = 16, 4  # bands of least shingle hashes, and hashes in each
SEEDS = np.arange(1, BANDS * DEEP + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def fingerprint(text: str | None, k: int = 3, distinct: bool = False) -> int:
    """Bits set in over half the hashes of the ``k``-word shingles, repeats included unless ``distinct``."""
    import xxhash

    words = WORD.findall(text.translate(LOWER)) if text else []
    if not words:
        return 0
    joined = " ".join(words).encode()
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, 42)
    lens = np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    begin, stop = (ends - lens + 1)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin, stop, strict=True)), np.uint64, len(begin))
    if distinct:
        h = np.unique(h)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64))

    return docs.select(key, prints(F.col(text)).alias("fp"))


def distances(a: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(a ^ v).astype(np.int16)


def masks(parts: int, equal: int = 1) -> tuple[int, ...]:
    """The own bits of each tree: every choice of ``equal`` of ``parts`` parts of the 64 bits.

    Fingerprints within ``r`` bits are within ``r // parts`` in some part, and agree on some choice wholly if ``r <= parts - equal``.
    """
    edges = [64 * i // parts for i in range(parts + 1)]
    blocks = [(1 << 64 - a) - (1 << 64 - b) for a, b in zip(edges, edges[1:], strict=False)]
    return tuple(sum(c) for c in combinations(blocks, equal))


HALVES = masks(2)


def part_of(fp: np.ndarray, tree: int, trees: tuple[int, ...] = HALVES) -> np.ndarray:
    """The tree's own bits of each fingerprint."""
    return fp & np.uint64(trees[tree])


def vantage(points: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and the largest distance of its inner half; None if the points can't be split."""
    spread = points[:: max(1, len(points) // 256)]
    best = None
    for v in points[np.linspace(0, len(points) - 1, 5).astype(int)]:
        d = np.sort(distances(spread, v))
        mu = int(d[(len(d) - 1) // 2])
        if d[-1] > mu:
            value = abs(2 * np.count_nonzero(d <= mu) - len(d)) + np.count_nonzero((d == mu) | (d == mu + 1))
            if best is None or value < best[0]:
                best = value, int(v), mu
    return best and best[1:]


def upper_tree(points: np.ndarray, depth: int) -> dict[int, tuple[int, int]]:
    """Nodes by heap number (root 1): vantage point and inner distance. A missing node is a shard."""
    nodes, todo = {}, [(1, points, depth)]
    while todo:
        at, own, left = todo.pop()
        if left and len(own) >= 8 and (cut := vantage(own)):
            nodes[at] = cut
            inner = distances(own, np.uint64(cut[0])) <= cut[1]
            todo += [(2 * at, own[inner], left - 1), (2 * at + 1, own[~inner], left - 1)]
    return nodes


def route(h: np.ndarray, nodes: dict[int, tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, shards and whether the shard is the row's home, for every shard that may hold a partner."""
    rows, shards, homes = [], [], []
    todo = [(1, np.arange(len(h)), np.ones(len(h), bool))]
    while todo:
        at, own, home = todo.pop()
        if not len(own):
            continue
        if at not in nodes:
            rows.append(own)
            shards.append(np.full(len(own), at, np.int64))
            homes.append(home)
            continue
        v, mu = nodes[at]
        d = distances(h[own], np.uint64(v))
        inside, outside = d <= mu + radius, d > mu - radius
        todo += [(2 * at, own[inside], home[inside] & (d[inside] <= mu)), (2 * at + 1, own[outside], home[outside] & (d[outside] > mu))]
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


def links_within(home: np.ndarray, query: np.ndarray, tree: int, radius: int, trees: tuple[int, ...] = HALVES, own: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places (query, home) of all pairs within ``radius`` bits whose own bits are within ``own``, and maybe others within ``radius``."""
    hb, qb = part_of(home, tree, trees), part_of(query, tree, trees)
    out, todo = [], [(np.arange(len(home)), np.arange(len(query)), 0)]
    while todo:
        hs, qs, level = todo.pop()
        if not len(hs) or not len(qs):
            continue
        cut = vantage(hb[hs]) if len(hs) > LEAF and level < 24 else None
        if cut:
            dh, dq = distances(hb[hs], np.uint64(cut[0])), distances(qb[qs], np.uint64(cut[0]))
            inner, inside, outside = dh <= cut[1], dq <= cut[1] + own, dq > cut[1] - own
            if min(inner.sum(), (~inner).sum()) >= len(hs) // 16 and inside.sum() + outside.sum() < 1.8 * len(qs):
                todo += [(hs[inner], qs[inside], level + 1), (hs[~inner], qs[outside], level + 1)]
                continue
        step = max(1, (1 << 21) // len(hs))
        for at in range(0, len(qs), step):
            q, h = np.nonzero(np.bitwise_count(query[qs[at : at + step], None] ^ home[hs][None, :]) <= radius)
            out.append((qs[at + q], hs[h]))
    return out


def forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs: each node with its group's smallest node."""
    if not pairs or not sum(len(a) for a, _ in pairs):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def cells(rows: DataFrame, own: int, trees: tuple[int, ...], bands: int = 0) -> DataFrame:
    """``rows`` (id, fp and any other columns; a written table) dealt to shards: (shard, cell, side, ...). A shard's tree is ``shard % (len(trees) + bands)``.

    Every two rows that differ in at most ``own`` of a tree's own bits meet in one of its cells. With a column ``wanted`` a row is dealt to the trees of its
    bits only. If ``own`` is 0, equal own bits are all that can meet, so a leaf is split further by their hash, which copies no row.
    With ``bands`` (``own`` 0) the keys in the column of that name are as many further trees, in which rows of equal key meet; the key is dealt as ``key``.
    """
    spark, columns, n = rows.sparkSession, [c for c in rows.columns if c not in ("wanted", "bands")], len(trees) + bands
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    total = max(1, rows.count())
    depth = int(min(DEPTH if own else SHALLOW, max(0, np.ceil(np.log2(total / (512 if own else SHARD))))))
    drawn = rows.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, 16 << depth))  # half a million at most
    sample = drawn.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    split = 1 if own else max(1, min(1 << (14 - depth), -(-total // (SHARD << depth))))
    spread = max(1, min(1 << 14, -(-total // SHARD)))
    uppers = spark.sparkContext.broadcast([upper_tree(part_of(sample, t, trees), depth) for t in range(len(trees))])  # at most n x 2**DEPTH nodes

    def placed_by(kept: list[str]):
        def place(batches):
            for b in batches:
                fp = b["fp"].to_numpy(np.int64).view(np.uint64)
                bits = b["wanted"].to_numpy(np.int64) if "wanted" in b else np.full(len(b), -1)
                banded = np.frombuffer(b"".join(b["bands"]), np.uint64).reshape(len(b), -1) if bands else None
                for t in range(n):
                    some = np.flatnonzero(bits >> t & 1)
                    if not len(some):
                        continue
                    if t < len(trees):
                        key, parted = part_of(fp[some], t, trees), split
                        at, leaves, homes = route(key, uppers.value[t], own)
                    else:
                        key, parted = banded[some, t - len(trees)], spread
                        at, leaves, homes = np.arange(len(some)), np.ones(len(some), np.int64), np.ones(len(some), bool)
                    sub = ((key[at] ^ key[at] >> np.uint64(29)) * MIX >> np.uint64(33)) % np.uint64(parted)
                    out = pd.DataFrame({"shard": (leaves * parted + sub.astype(np.int64)) * n + t, "home": homes, **{c: b[c].to_numpy()[some[at]] for c in kept if c != "key"}})
                    yield out.assign(key=key[at].view(np.int64) if t >= len(trees) else 0) if "key" in kept else out

        return place

    if bands:
        columns, schema = [*columns, "key"], f"{schema}, key long"
    placed = rows.mapInPandas(placed_by(columns), f"shard long, home boolean, {schema}")
    if own and depth:
        placed = written(placed, "placed")
        counted = placed
    else:
        counted = rows.select("fp", *sorted({"wanted", "bands"} & set(rows.columns))).mapInPandas(placed_by([]), "shard long, home boolean")
    sizes = counted.groupBy("shard").agg(F.count_if("home").alias("homes"), F.count("*").alias("queries"))
    sizes = sizes.where(F.col("queries") > BLOCK).toPandas()  # at most n x 2**DEPTH rows, or n x 2**14 if own is 0
    grid = {int(k): (-(-int(h) // BLOCK), -(-int(q) // BLOCK)) for k, h, q in zip(sizes["shard"], sizes["homes"], sizes["queries"], strict=True)}
    grid = spark.sparkContext.broadcast(grid)

    def deal(batches):
        for b in batches:
            wide = b["shard"].map(lambda s: grid.value.get(s, (1, 1)))
            nh, nq = np.array([x[0] for x in wide], np.int64), np.array([x[1] for x in wide], np.int64)
            nh, nq = np.maximum(nh, 1), np.maximum(nq, 1)
            mixed = ((b["fp"].to_numpy(np.int64) ^ b["id"].to_numpy(np.int64)).view(np.uint64) * MIX) >> np.uint64(33)
            if not own:  # every row is at home only: blocks meet once, in either order
                at = np.repeat(np.arange(len(b)), nh)
                other = np.arange(len(at)) - np.repeat(np.cumsum(nh) - nh, nh)
                mine = (mixed[at] % nh[at].astype(np.uint64)).astype(np.int64)
                cell, side = np.minimum(mine, other) * nh[at] + np.maximum(mine, other), np.where(mine == other, BOTH, np.where(mine < other, HOME, QUERY))
                yield pd.DataFrame({"shard": b["shard"].to_numpy()[at], "cell": cell, "side": side.astype(np.int8), **{c: b[c].to_numpy()[at] for c in columns}})
                continue
            whole = (nh == 1) & (nq == 1)
            home = b["home"].to_numpy(bool)
            for side, many, mine_of, pick in ((BOTH, nq, nh, whole & home), (QUERY, nq, nq, whole & ~home), (HOME, nq, nh, ~whole & home), (QUERY, nh, nq, ~whole)):
                times = many[pick]
                at = np.repeat(np.flatnonzero(pick), times)
                other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                mine = (mixed[at] % mine_of[at].astype(np.uint64)).astype(np.int64)
                cell = other * nq[at] + mine if side == QUERY else mine * nq[at] + other
                yield pd.DataFrame({"shard": b["shard"].to_numpy()[at], "cell": cell, "side": np.int8(side), **{c: b[c].to_numpy()[at] for c in columns}})

    return placed.mapInPandas(deal, f"shard long, cell long, side tinyint, {schema}")


def near_links(distinct: DataFrame, radius: int = 3, parts: int = 2) -> DataFrame:
    """Links (u, v) that connect every two of the distinct fingerprints (column ``fp``, a written table) within ``radius`` bits."""
    trees, own = masks(parts), radius // parts

    def search(keys, group):
        fp, side = group["fp"].to_numpy(np.int64).view(np.uint64), group["side"].to_numpy()
        h, q = fp[side != QUERY], fp[side != HOME]
        u, v = forest([(q[a], h[b]) for a, b in links_within(h, q, int(keys[0]) % parts, radius, trees, own)])
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = cells(distinct.select(F.lit(0).cast("long").alias("id"), "fp"), own, trees)
    return dealt.groupBy("shard", "cell").applyInPandas(search, "u long, v long")


def spanning(x: np.ndarray, y: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Places of the pairs that make a least spanning forest over ``n`` rows (rounds of each group's nearest pair)."""
    key = (d.astype(np.int64) << 40) | np.arange(len(x))
    root, taken = np.arange(n), []
    while len(x):
        a, b = root[x], root[y]
        open_ = a != b
        if not open_.any():
            break
        x, y, key, a, b = x[open_], y[open_], key[open_], a[open_], b[open_]
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, a, key)
        np.minimum.at(best, b, key)
        picked = np.unique(best[best < np.iinfo(np.int64).max])
        taken.append(picked & ((1 << 40) - 1))
        at = np.searchsorted(key, picked, sorter=(order := np.argsort(key, kind="stable")))
        u, v = a[order[at]], b[order[at]]
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
    return np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int64)


def bands_of(hashes: np.ndarray) -> bytes:
    """Keys of ``BANDS`` bands, each of the least of the hashes in ``DEEP`` orders: two sets of similarity s have a band's key in common with chance s ** DEEP."""
    least = np.full(len(SEEDS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        x = (hashes[None, at : at + 1024] ^ SEEDS[:, None]) * MIX
        x ^= x >> np.uint64(29)
        x *= STIR
        least = np.minimum(least, (x ^ x >> np.uint64(32)).min(1))
    keys = np.zeros(BANDS, np.uint64)
    for own in least.reshape(BANDS, DEEP).T:
        keys = (keys ^ own) * MIX
        keys ^= keys >> np.uint64(29)
    return keys.tobytes()


def sketch(text: str | None, k: int) -> tuple[int, int, int, bytes]:
    """How many distinct ``k``-word shingles a text has (fewer words: one; none: zero), both halves of their 128-bit SimHash (signed), and their bands."""
    import xxhash

    words = WORD.findall(text.translate(LOWER)) if text else []
    if not words:
        return 0, 0, 0, b""
    found = {xxhash.xxh3_128_digest(" ".join(words[i : i + k])) for i in range(max(1, len(words) - k + 1))}
    bits, ones = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16), np.zeros(128, np.int64)
    for at in range(0, len(bits), 1 << 15):
        ones += np.unpackbits(bits[at : at + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    low, high = np.packbits(2 * ones > len(bits)).view(np.int64).tolist()
    return len(bits), low, high, bands_of(bits.view(np.uint64)[:, 0])


def equal_keys(query: np.ndarray, home: np.ndarray):
    """Places (query, home) of all pairs of equal keys, in runs of bounded size."""
    order = np.argsort(home, kind="stable")
    low, high = (np.searchsorted(home[order], query, side) for side in ("left", "right"))
    some = np.flatnonzero(high > low)
    turn = np.cumsum(high[some] - low[some]) >> 21
    for own in np.split(some, np.flatnonzero(np.diff(turn)) + 1):
        times = high[own] - low[own]
        at = np.repeat(np.arange(len(own)), times)
        yield own[at], order[low[own][at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]


def candidates(group: pd.DataFrame, tree: int, trees: tuple[int, ...], reach: int, wide: int, threshold: float):
    """Places (x, y) in a cell of pairs within ``reach`` bits of the fingerprint and ``wide`` of the sketch whose sizes allow the threshold.

    A pair belongs to the first tree on whose own bits it agrees, so that no pair is worked on twice and none depends on what else is in its cell.
    In the trees of the bands, pairs of equal key are taken whose sizes allow the threshold and that no other tree takes, whatever their fingerprints.
    """
    fp, side = group["fp"].to_numpy(np.int64).view(np.uint64), group["side"].to_numpy()
    ids, n = group["id"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    low, high = (group[c].to_numpy(np.int64).view(np.uint64) for c in ("low", "high"))
    h, q, alone = np.flatnonzero(side != QUERY), np.flatnonzero(side != HOME), (side == BOTH).all()
    banded = tree >= len(trees)
    met = equal_keys(group["key"].to_numpy(np.int64)[q], group["key"].to_numpy(np.int64)[h]) if banded else links_within(fp[h], fp[q], tree, reach, trees, 0)
    for x, y in met:
        x, y = q[x], h[y]
        keep = (ids[x] < ids[y]) if alone else (ids[x] != ids[y])
        keep &= np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y])
        x, y = x[keep], y[keep]
        unequal = fp[x] ^ fp[y]
        if banded:
            near = np.bitwise_count(low[x] ^ low[y]) + np.bitwise_count(high[x] ^ high[y]) <= wide
            near = np.flatnonzero(near & (np.bitwise_count(unequal) <= reach))
            keep = np.ones(len(x), bool)
            for t in range(len(trees)):
                keep[near] &= part_of(unequal[near], t, trees) != 0
            yield x[keep], y[keep]
            continue
        keep = (part_of(unequal, tree, trees)) == 0
        keep &= np.bitwise_count(low[x] ^ low[y]) + np.bitwise_count(high[x] ^ high[y]) <= wide
        x, y, unequal = x[keep], y[keep], unequal[keep]
        keep = np.ones(len(x), bool)
        for earlier in range(tree):
            keep &= part_of(unequal, earlier, trees) != 0
        yield x[keep], y[keep]


def parity(hashes: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls on each of 4 to 8 bits for each hash. Half of it xor the other half is the map of half as many bits."""
    wide = 1 << max(6, int(4 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1).tobytes()


def unlike(maps: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of how many shingles are in one text of each pair only: the bits in which their parity maps differ."""
    size = np.fromiter((len(m) for m in maps), np.int64, len(maps))
    least, out = np.minimum(size[x], size[y]), np.zeros(len(x), np.int64)
    for s in np.unique(least):
        own = np.flatnonzero(least == s)
        rows, at = np.unique(np.concatenate([x[own], y[own]]), return_inverse=True)
        flat = np.zeros((len(rows), s), np.uint8)
        for i, r in enumerate(rows):
            flat[i] = np.bitwise_xor.reduce(np.frombuffer(maps[r], np.uint8).reshape(-1, s), 0)
        flat, step = flat.view(np.uint64), max(1, (1 << 24) // int(s))
        for lo in range(0, len(own), step):
            i, j = at[lo : min(lo + step, len(own))], at[len(own) + lo : len(own) + min(lo + step, len(own))]
            out[own[lo : lo + step]] = np.bitwise_count(flat[i] ^ flat[j]).sum(1, dtype=np.int64)
    return out


def with_partner(rows: DataFrame, trees: tuple[int, ...], reach: int, wide: int, threshold: float) -> DataFrame:
    """The ids of rows (id, fp, n, low, high, bands; a written table) that have any candidate partner, and ``wanted``: the trees where they have one, as bits."""

    def search(keys, group):
        found, tree = np.zeros(len(group), bool), int(keys[0]) % (len(trees) + BANDS)
        for x, y in candidates(group, tree, trees, reach, wide, threshold):
            found[x] = found[y] = True
        return pd.DataFrame({"id": np.unique(group["id"].to_numpy(np.int64)[found]), "tree": 1 << tree})

    found = cells(rows, 0, trees, BANDS).groupBy("shard", "cell").applyInPandas(search, "id long, tree long")
    return found.groupBy("id").agg(F.bit_or("tree").alias("wanted"))


def near_pairs(rows: DataFrame, whole: bool, trees: tuple[int, ...], reach: int, wide: int, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows (id, wanted, fp, n, low, high, bands, bits, root; a written table) of different roots, to be verified.

    Pairs whose parity maps prove a similarity below the threshold are left out in the cell. Of the others, ``whole`` takes all and
    else a least spanning forest by the distance of the maps, which has fewer pairs than the cell has rows.
    """

    def search(keys, group):
        ids, n, root = (group[c].to_numpy(np.int64) for c in ("id", "n", "root"))
        maps, (names, place) = group["bits"].tolist(), np.unique(ids, return_inverse=True)
        xs, ys, ds = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for x, y in candidates(group, int(keys[0]) % (len(trees) + BANDS), trees, reach, wide, threshold):
            keep = root[x] != root[y]
            x, y = x[keep], y[keep]
            d, both = unlike(maps, x, y), n[x] + n[y]
            keep = d * (1 + threshold) <= (1 - threshold) * both + 1e-6
            xs.append(place[x[keep]].astype(np.int32))
            ys.append(place[y[keep]].astype(np.int32))
            ds.append(d[keep] * 100_000 // both[keep])
        x, y, d = (np.concatenate(v) for v in (xs, ys, ds))
        if not whole:
            pick = spanning(x, y, d, len(names))
            x, y = x[pick], y[pick]
        pairs = np.unique(np.stack([names[np.minimum(x, y)], names[np.maximum(x, y)]], 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return cells(rows, 0, trees, BANDS).groupBy("shard", "cell").applyInPandas(search, "a long, b long").distinct()


def shingles(docs: DataFrame, k: int, key: str = "_id", text: str = "_text") -> DataFrame:
    """``key``, ``s``: the hashes of a text's distinct ``k``-word shingles (fewer words: one shingle; none: no shingle), and ``bits``, their parity map."""
    import xxhash

    def one(t):
        words = WORD.findall(t.translate(LOWER)) if t else []
        return np.unique(np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i : i + k])) for i in range(max(1, len(words) - k + 1))), np.uint64)).view(np.int64) if words else np.zeros(0, np.int64)

    def run(batches):
        for b in batches:
            found = [one(t) for t in b[text]]
            yield pd.DataFrame({key: b[key], "s": found, "bits": [parity(h.view(np.uint64)) for h in found]})

    return docs.select(key, text).mapInPandas(run, f"{key} long, s array<long>, bits binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v): the pairs (a, b) whose shingles reach the threshold."""
    both = pairs.join(sets.select(F.col("_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("_id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    reached = (shared > 0) & (shared >= threshold * (F.size("sa") + F.size("sb") - shared))
    return written(both.where(reached).select(F.col("a").alias("u"), F.col("b").alias("v")), "found")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, parts: int = 9, equal: int = 2, reach: int = 12, wide: int = 40) -> DataFrame:
    """(key, component_id) of every document: groups of texts linked by a Jaccard similarity of their ``k``-word shingles of at least ``threshold``.

    Equal texts are one row. Candidates are within ``reach`` bits and agree on ``equal`` of the ``parts`` parts of their 64-bit SimHash over distinct words, so every two
    that differ in at most ``parts - equal`` bits meet; one vantage-point tree over each choice of parts deals the rows, as often at every size. They also differ in at most
    ``wide`` bits of a 128-bit SimHash over the shingles (at the threshold 19 bits are expected, 64 between unrelated texts). Replacing one word
    changes one element of the word set but ``k`` shingles, so the first finds edited texts and the second rejects those that only share words.
    A passage that is added, cut or swapped moves more bits of the word set than that; such pairs are candidates by an equal band of least shingle hashes, whose chance depends
    on the similarity alone (at the threshold at least one of ``BANDS`` is equal with 0.9998), with no bound on the bits.
    Rows without a candidate drop out. The others return, only to the trees where they have one, with a parity map of their shingles, in which the bits that differ are a lower
    bound of the shingles that two texts don't share, so that unlike pairs end in their cell. What is left is verified on the shingles
    themselves: a spanning forest of each cell first, then all pairs that still lie between different groups, so no candidate link is lost.

    Documents go by a number of their own (``numbering``), so keys may be null, repeated or of any type; the numbers follow the keys, null first, and a group is named
    by the key of its smallest number. Null is empty; texts without words are alike only if equal; rows with one key and different texts are different documents.
    """
    rows, _, unique = with_numbers(docs, key, text)
    groups = similar_numbers(rows, "_no", text, k, threshold, parts, equal, reach, wide)
    if unique:
        return groups.select(F.col("_no").cast(docs.schema[key].dataType).alias(key), F.col("component_id").cast(docs.schema[key].dataType).alias("component_id"))
    names = written(rows.select("_no", F.col(key).alias("_name")).distinct(), "names")
    of = groups.distinct().join(names.select(F.col("_no").alias("component_id"), F.col("_name").alias("_component")), "component_id")
    return rows.select(F.col(key), "_no").join(of.select("_no", F.col("_component").alias("component_id")), "_no").drop("_no")


def similar_numbers(docs: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8, parts: int = 9, equal: int = 2, reach: int = 12, wide: int = 40) -> DataFrame:
    """``similar_documents`` of rows whose ``key`` is a whole number, never null, that two rows share only if their texts are equal."""

    def prints(batches):
        for b in batches:
            parts_of = [(fingerprint(t, 1, True), *sketch(t, k)) for t in b["_text"]]
            fp = np.array([p[0] for p in parts_of], np.uint64).view(np.int64)
            yield pd.DataFrame({"_key": b["_key"], "h1": b["h1"], "h2": b["h2"], "fp": fp, "bands": [p[4] for p in parts_of], **{c: np.array([p[at] for p in parts_of], np.int64) for at, c in ((1, "n"), (2, "low"), (3, "high"))}})

    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), plain.alias("_text"), F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(7), plain).alias("h2"))
    table = written(rows.mapInPandas(prints, f"_key {docs.schema[key].dataType.simpleString()}, h1 long, h2 long, fp long, bands binary, n long, low long, high long"), "word_prints")
    texts = written(table.groupBy("h1", "h2", "fp", "n", "low", "high", "bands").agg(F.min("_key").cast("long").alias("id")), "texts")
    bounds = (masks(parts, equal), reach, wide, threshold)
    plain_rows = written(texts.where("id is not null and n > 0").select("id", "fp", F.col("n").cast("int").alias("n"), "low", "high", "bands"), "open")
    wanted = written(with_partner(plain_rows, *bounds), "wanted")
    own = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(wanted, F.col("_id") == F.col("id"), "left_semi")
    sets = written(shingles(own, k).dropDuplicates(["_id"]), "shingles")
    rest = plain_rows.join(wanted, "id").join(sets.select(F.col("_id").alias("id"), "bits"), "id")
    first = written(near_pairs(written(rest.withColumn("root", F.col("id")), "mapped"), False, *bounds), "pairs")
    links = _verified(first, sets, threshold)
    roots = components(links)
    rest = rest.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    last = written(near_pairs(written(rest, "mapped"), True, *bounds).join(first, ["a", "b"], "left_anti"), "pairs")
    roots = components(links.union(_verified(last, sets, threshold)))
    of = texts.join(roots, texts["id"] == roots["node"], "left").select("h1", "h2", F.coalesce("root", "id").alias("component_id"))
    return table.join(of, ["h1", "h2"], "left").select(F.col("_key").alias(key), "component_id")


def grouped(prints: DataFrame, key: str = "doc_id", radius: int = 3) -> DataFrame:
    """``prints`` (key, fp) with ``component_id``: the smallest key of the fingerprints reachable by links."""
    prints = written(prints, "prints")
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(near_links(distinct, radius))
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp", "left").select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document."""
    out = grouped(fingerprints(docs, key, text, k), key, radius)
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
