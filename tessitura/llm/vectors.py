"""Near-duplicate embeddings through an inverted multi-index.

The vectors are scaled to length one and cut in halves. A codebook for each half is fitted (k-means) on a bounded sample; the pairs of
codewords form a grid of cells, whose number grows with the vectors, so a cell holds as many at every size; every vector is indexed in its nearest cell. A query walks the grid by multi-sequence traversal, cells in order of the
summed distances of their codewords, as far as a number of cells that is measured on every run: a bounded set of sample queries, drawn evenly from the cells, is compared
with all vectors, and the least number is taken at which ``recall`` is reached in each of three means: over their pairs, over the queries (a large group's pairs
don't outweigh the others) and over groups (nor do its rows). Where fewer than ENOUGH of the sample queries have a neighbour, more are drawn, and where even the whole
sample has too few, neighbours are planted instead: for every sample query a vector just at the threshold in a random direction, the hardest that
the traversal can be asked for. Every vector is a query. All candidates are verified in double precision.

Equal vectors are one row throughout. A cell returns, for each row, how many vectors it links with, and a spanning forest of its links, never the
pairs. A pair that both directions visit is credited once by each direction, one that a single direction visits is credited to both ends.
Full cells are cut into a grid of home and query blocks of bounded size.

Vectors of different lengths have no cosine: each length has a grid of its own. Of one component there are two directions only, and no grid.

Defined results: vectors that are null, empty, zero, or with null or non-finite components link with nothing
and are their own component; repeated rows link with each other, also those without an id; null ids are never the smallest; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators.components import components
from tessitura.llm.fingerprints import forest
from tessitura.llm.scratch import written

SAMPLE, QUERIES, BLOCK = 8192, 512, 512  # rows that the codebooks are fitted on at least, queries that recall is measured on at first, rows of a block
CODES = 2048  # codewords of a half at most: 4 million cells
ENOUGH = 48  # sample queries with a neighbour that a measurement rests on


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced rows; an empty centre keeps its place."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


class Grid:
    """Two codebooks and the order in which a vector visits their cells."""

    def __init__(self, sample: np.ndarray, k: int):
        half = sample.shape[1] // 2
        self.half, self.books = half, [kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)]
        self.k = k

    def distances(self, u: np.ndarray) -> list[np.ndarray]:
        parts = (u[:, : self.half], u[:, self.half :])
        return [(b**2).sum(1) - 2 * p @ b.T + (p**2).sum(1)[:, None] for p, b in zip(parts, self.books, strict=True)]

    def homes(self, u: np.ndarray) -> np.ndarray:
        """The nearest cell of each row."""
        step = self.rows_at_once(4096)
        return np.concatenate([np.zeros(0, np.int64), *[self.traverse(u[s : s + step], 1)[:, 0] for s in range(0, len(u), step)]])

    def traverse(self, u: np.ndarray, cells: int) -> np.ndarray:
        """The ``cells`` nearest cells of each row, nearest first.

        Multi-sequence: of the codewords in order, cell (i, j) can be among the first n only if (i + 1) * (j + 1) <= n, so
        only that hyperbolic corner of the product is summed and sorted.
        """
        d1, d2 = self.distances(u)
        o1, o2 = (np.argsort(d, 1, kind="stable")[:, :cells] for d in (d1, d2))
        i, j = np.nonzero((np.arange(self.k)[:, None] + 1) * (np.arange(self.k)[None, :] + 1) <= cells)
        a, b = o1[:, i], o2[:, j]
        s = np.take_along_axis(d1, a, 1) + np.take_along_axis(d2, b, 1)
        best = np.argsort(s, 1, kind="stable")[:, :cells]
        return np.take_along_axis(a * self.k + b, best, 1).astype(np.int32)

    def rank(self, u: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells each row visits before ``cell``."""
        d1, d2 = self.distances(u)
        own = d1[np.arange(len(u)), cell // self.k] + d2[np.arange(len(u)), cell % self.k] - 1e-12
        d2 = np.sort(d2, 1)
        if self.k <= 64:
            return ((d1[:, :, None] + d2[:, None, :]) < own[:, None, None]).sum((1, 2))
        return np.array([np.searchsorted(b, o - a).sum() for a, b, o in zip(d1, d2, own, strict=True)], np.int64)

    def rows_at_once(self, most: int) -> int:
        """Rows whose distances to all codewords are held together."""
        return max(16, min(most, (1 << 21) // self.k))


def unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def planted(queries: np.ndarray, threshold: float) -> np.ndarray:
    """For each query a vector whose cosine with it is the threshold, in a random direction."""
    step = np.random.default_rng(7).normal(size=queries.shape)
    step -= (step * queries).sum(1, keepdims=True) * queries
    return threshold * queries + (1 - threshold**2) ** 0.5 * step / np.sqrt((step**2).sum(1, keepdims=True))


def measured(distinct: DataFrame, shared, threshold: float) -> tuple[pd.DataFrame, int]:
    """For each number of cells before a neighbour's (rank): pairs, queries' shares and groups' shares; and how many queries have a neighbour.

    ``shared``: the grid, sample queries, their cells and ids.
    """

    def ranks(batches):
        grid, queries, at, names = shared.value
        step = grid.rows_at_once(1024)
        for b in batches:
            u = unit(b["v"])
            for lo in range(0, len(u), 4096):
                part = u[lo : lo + 4096]
                y, q = np.nonzero((part @ queries.T >= threshold) & (b["id"].to_numpy()[lo : lo + 4096, None] != names[None, :]))
                if not len(y):
                    continue
                home = grid.homes(part)
                for s in range(0, len(y), step):
                    ys, qs = y[s : s + step], q[s : s + step]
                    r = np.minimum(grid.rank(queries[qs], home[ys]), grid.rank(part[ys], at[qs]))
                    found, n = np.unique(np.stack([qs, r]), axis=1, return_counts=True)
                    yield pd.DataFrame({"query": found[0], "rank": found[1], "n": n})

    held = distinct.mapInPandas(ranks, "query long, rank long, n long").groupBy("query", "rank").agg(F.sum("n").alias("n"))
    held = written(held, "ranks")  # a row for each query and cell at most
    held = held.join(held.groupBy("query").agg(F.sum("n").alias("all")), "query")
    means = {"pairs": F.col("n"), "queries": F.col("n") / F.col("all"), "groups": F.col("n") / (F.col("all") * (F.col("all") + 1))}
    some = held.agg(F.countDistinct("query")).first()[0]
    return held.groupBy("rank").agg(*[F.sum(x).alias(c) for c, x in means.items()]).orderBy("rank").toPandas(), some  # a row for each cell at most


def near_links(distinct: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """Rows (a, b, n): ``b`` null: ``a`` links with n vectors; else a and b are linked; and the number of cells. ``distinct``: a written table of id, v, n."""
    spark = distinct.sparkSession
    total = distinct.count()
    k = max(1, min(CODES, round((total / 24) ** 0.5)))
    drawn = distinct.orderBy(F.xxhash64("v"), "id").limit(max(SAMPLE, 32 * k)).toPandas()  # 32 rows for each codeword, 65,536 at most
    sample, names = unit(drawn["v"]), drawn["id"].to_numpy()
    grid = Grid(sample, min(k, len(sample)))
    k = grid.k
    turn = pd.Series(grid.homes(sample))
    turn = turn.groupby(turn).cumcount().to_numpy().argsort(kind="stable")  # one of each cell, then a second: a full cell doesn't crowd out the others
    for n in (QUERIES, SAMPLE):
        queries = sample[turn[:n]]
        shared = spark.sparkContext.broadcast((grid, queries, grid.homes(queries), names[turn[:n]]))  # bounded by SAMPLE and CODES
        found, some = measured(distinct, shared, threshold)
        if some >= ENOUGH or len(queries) < n:
            break
    if some < ENOUGH:
        other = planted(queries, threshold)
        ranks = np.concatenate([np.minimum(grid.rank(queries[s : s + 16], grid.homes(other[s : s + 16])), grid.rank(other[s : s + 16], grid.homes(queries[s : s + 16]))) for s in range(0, len(queries), 16)])
        rank, n = np.unique(ranks, return_counts=True)
        more = pd.DataFrame({"rank": rank, "pairs": n, "queries": n, "groups": n})
        found = pd.concat([found, more]).groupby("rank", as_index=False).sum().sort_values("rank")
    means = ["pairs", "queries", "groups"]
    share = found[means].cumsum() / found[means].sum()
    cells = int(found["rank"].to_numpy()[int((share.min(axis=1) >= recall).to_numpy().argmax())]) + 1

    def place(batches):
        grid = shared.value[0]
        for b in batches:
            u = unit(b["v"])
            step = grid.rows_at_once(2048)
            for lo in range(0, len(u), step):
                part = u[lo : lo + step]
                visits = grid.traverse(part, cells)
                n = visits.shape[1]
                ids, counts, raw = b["id"].to_numpy()[lo : lo + step], b["n"].to_numpy()[lo : lo + step], [x.tobytes() for x in part]
                seen = [x.tobytes() for x in visits]
                yield pd.DataFrame({"cell": visits[:, 0], "own": visits[:, 0], "home": True, "id": ids, "n": counts, "v": raw, "visits": seen})
                at = np.repeat(np.arange(len(part)), n)
                yield pd.DataFrame({"cell": visits.ravel(), "own": visits[at, 0], "home": False, "id": ids[at], "n": counts[at], "v": [raw[i] for i in at], "visits": None})

    placed = distinct.mapInPandas(place, "cell int, own int, home boolean, id long, n long, v binary, visits binary")

    def visited(batches):
        grid = shared.value[0]
        for b in batches:
            u, step = unit(b["v"]), grid.rows_at_once(2048)
            for lo in range(0, len(u), step):
                visits = grid.traverse(u[lo : lo + step], cells)
                cell, n = np.unique(visits, return_counts=True)
                home, h = np.unique(visits[:, 0], return_counts=True)
                yield pd.DataFrame({"cell": np.concatenate([cell, home]), "q": np.concatenate([n, np.zeros(len(home), np.int64)]), "h": np.concatenate([np.zeros(len(cell), np.int64), h])})

    sizes = distinct.select("v").mapInPandas(visited, "cell int, q long, h long").groupBy("cell").agg(F.sum("h").alias("h"), F.sum("q").alias("q"))
    sizes = sizes.where((F.col("h") > BLOCK) | (F.col("q") > BLOCK)).collect()  # full cells only, CODES squared at most
    blocks = spark.sparkContext.broadcast({r["cell"]: (max(1, -(-r["h"] // BLOCK)), max(1, -(-r["q"] // BLOCK))) for r in sizes})

    def deal(batches):
        for b in batches:
            wide = [blocks.value.get(c, (1, 1)) for c in b["cell"]]
            nh, nq = np.array([x[0] for x in wide]), np.array([x[1] for x in wide])
            home, mixed = b["home"].to_numpy(bool), (b["id"].to_numpy(np.int64) * 0x9E3779B1 >> 7)
            times, own = np.where(home, nq, nh), np.where(home, nh, nq)
            at = np.repeat(np.arange(len(b)), times)
            other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            mine = mixed[at] % own[at]
            out = b.iloc[at].copy()
            out["block"] = np.where(home[at], mine * nq[at] + other, other * nq[at] + mine)
            yield out

    def search(group: pd.DataFrame) -> pd.DataFrame:
        h, q = group[group["home"]], group[~group["home"]]
        if not len(h) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        hv, qv = (np.frombuffer(b"".join(x["v"]), np.float64).reshape(len(x), -1) for x in (h, q))
        visits = np.frombuffer(b"".join(h["visits"]), np.int32).reshape(len(h), -1)
        hi, qi, hn, qn, qo = h["id"].to_numpy(), q["id"].to_numpy(), h["n"].to_numpy(), q["n"].to_numpy(), q["own"].to_numpy()
        h_links, q_links, pairs = np.zeros(len(h), np.int64), np.zeros(len(q), np.int64), []
        for lo in range(0, len(q), 512):
            y, x = np.nonzero((qv[lo : lo + 512] @ hv.T >= threshold) & (qi[lo : lo + 512, None] != hi[None, :]))
            y += lo
            np.add.at(q_links, y, hn[x])
            for s in range(0, len(y), 65536):
                ys, xs = y[s : s + 65536], x[s : s + 65536]
                alone = ~(visits[xs] == qo[ys][:, None]).any(1)
                np.add.at(h_links, xs[alone], qn[ys[alone]])
            pairs.append(tuple(z.astype(np.uint64) for z in forest([(qi[y].view(np.uint64), hi[x].view(np.uint64))])))
        u, v = forest(pairs)
        ids, n = np.concatenate([hi, qi]), np.concatenate([h_links, q_links])
        links = pd.DataFrame({"a": ids[n > 0], "b": None, "n": n[n > 0]})
        return pd.concat([links, pd.DataFrame({"a": u.view(np.int64), "b": v.view(np.int64), "n": 0})]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    dealt = placed.mapInPandas(deal, placed.schema.simpleString()[7:-1].replace(":", " ") + ", block long")
    return dealt.groupBy("cell", "block").applyInPandas(search, "a long, b long, n long"), cells


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.995) -> DataFrame:
    """key, n_links, component_id and kept of every vector."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("good", F.coalesce(v.isNotNull() & finite, F.lit(False)))
    out = rows.where(~F.col("good")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    # equal vectors are one row; -0 is 0, and of one component only the sign counts
    good = rows.where("good").withColumn("v", F.when(F.size("v") == 1, F.transform("v", lambda x: F.signum(x))).otherwise(F.transform("v", lambda x: x + F.lit(0.0))))
    named = good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    distinct = written(named.select(F.monotonically_increasing_id().alias("id"), "least", "v", "n"), "vectors")
    found = None
    for r in distinct.where(F.size("v") > 1).groupBy(F.size("v").alias("size")).count().orderBy("size").collect():  # one row for each length
        own = written(distinct.where(F.size("v") == r["size"]).select("id", "v", "n"), "one_length")
        one = written(near_links(own, threshold, recall)[0], "vector_links")
        found = one if found is None else found.union(one)
    if found is None:
        of = distinct.select(F.col("v").alias("own"), (F.col("n") - 1).alias("n_links"), F.col("least").alias("component_id"))
    else:
        roots = components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
        links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
        of = distinct.join(links, distinct["id"] == links["a"], "left").join(roots, distinct["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
        of = written(of.select("root", "least", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector_roots")
        least = of.groupBy("root").agg(F.min("least").alias("component_id"))
        of = of.join(least, "root").select(F.col("v").alias("own"), "n_links", "component_id")
    out = out.union(good.join(of, good["v"] == of["own"], "left").select("id", "n_links", "component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
