"""Row numbers within groups of any size.

A window hands each group to one task. That serves groups of up to LARGE rows; the rows of larger ones are sorted over ranges instead, so a group lies in as many partitions as it
fills, each partition numbers its own rows, and what stands before a partition is a running sum over the partitions' counts: a few numbers for each, whatever the group holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.plans.scratch import written

LARGE = 1_000_000  # rows of a group that one task numbers


def _named(keys: list[str]) -> list:
    """Keys under names of their own, so that a table can be joined with what was counted from it."""
    return [F.col(k).alias(f"_of_{k}") for k in keys]


def _same(keys: list[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return cond


def over_ranges(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 1 within the groups ``by`` in the order of ``order``; no task holds a group."""
    keys = [*by, *order]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))  # Spark's ids: the partition in the upper bits, places in the lower 33
    sizes = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*_named([*by, "_part"]), (before - F.col("_first") + 1).alias("_shift"))
    return placed.join(starts, _same([*by, "_part"])).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number (long) from 1 within the groups ``by``, in ascending order of ``order``, nulls first and null keys one group. Ties are in any order."""
    if not by:
        return over_ranges(rows, by, order, name)
    large = written(rows.groupBy(*by).count().where(F.col("count") > LARGE).select(*_named(by)), "large_groups")  # those alone
    windowed = lambda some: some.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    if large.isEmpty():
        return windowed(rows)
    rest = rows.join(large, _same(by), "left_anti")
    return windowed(rest).unionByName(over_ranges(rows.join(large, _same(by), "left_semi"), by, order, name))
