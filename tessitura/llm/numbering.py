"""A number for every document, whatever its key: how places in different documents are put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.scratch import written

WHOLE = ("tinyint", "smallint", "int", "bigint")


def with_numbers(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int, bool]:
    """``docs`` with a column ``_no`` (long) more, the bytes of all texts, and whether no two rows can have one number.

    Numbers follow the order of the keys, null first. A whole-number key that is never null and never twice is its own number.
    Otherwise the distinct pairs of key and text are sorted and numbered over ranges, so any type of key serves, rows with
    one key and different texts are different documents (in the order of their texts' SHA-256), and rows that are equal in
    both are one document. A null text counts as empty.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    each = docs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"), F.sum(F.octet_length(plain)).alias("size"))
    facts = each.agg(F.max("n").alias("n"), F.sum("size").alias("size"), F.max(F.col("_key").isNull()).alias("nulls")).first()
    size = int(facts["size"] or 0)
    if dict(docs.dtypes)[key] in WHOLE and (facts["n"] or 0) <= 1 and not facts["nulls"]:
        return docs.withColumn("_no", F.col(key).cast("long")), size, True
    rows = docs.withColumn("_sha", F.sha2(plain, 256))
    order = [F.col("_own").asc_nulls_first(), F.col("_of")]
    pairs = rows.select(F.col(key).alias("_own"), F.col("_sha").alias("_of")).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    pairs = written(pairs.select("_own", "_of", F.monotonically_increasing_id().alias("_no")), "numbers")
    same = rows[key].eqNullSafe(pairs["_own"]) & (rows["_sha"] == pairs["_of"])
    return rows.join(pairs, same).drop("_own", "_of", "_sha"), size, False


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows (``_key``, ``_no``: long, ``_text``) and the bytes of all texts, numbered as by ``with_numbers``."""
    rows, size, _ = with_numbers(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "_key", "_text")
    return rows.select("_key", "_no", "_text"), size


def buckets(docs: DataFrame, size: int, each: int = 8 << 20) -> int:
    """How many buckets ``size`` bytes are dealt into, so that what one holds doesn't grow with the data."""
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
