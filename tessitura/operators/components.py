"""Connected components over a table of links, wholly distributed.

Links are first contracted in tasks of at most LOCAL links each, where every node comes to point at the smallest one it reaches there; what fits in one task is
done then. Alternating large-star and small-star rounds settle the rest: every round is two grouped minima and two joins, cut by a written
table in the shared folder. Links come as a forest from each cell of a search (see the callers), so their number stays below the number of rows.
Nothing but counts of links reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.plans.scratch import written

LOCAL = 400_000  # links that a task contracts, 16 bytes each


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while not np.array_equal(x := root[a], y := root[b]):
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, up := root[root]):
            root = up
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _contract(batches):
    held = list(batches)
    if held:
        u, v = contracted(*(np.concatenate([b[c].to_numpy(np.int64) for b in held]) for c in ("u", "v")))
        yield pd.DataFrame({"u": u, "v": v})


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (u, v: long). Returns (node, root) for every linked node but the roots; the root is the component's smallest node."""
    e = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    tasks = -(-e.count() // LOCAL) or 1
    e = written(e.repartition(tasks).mapInPandas(_contract, "u long, v long"), "contracted")
    seen = None
    for _ in range(rounds if tasks > 1 else 0):
        e = written(_small_star(_large_star(e).distinct()).distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    else:
        if tasks > 1:
            raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
