"""Tables written in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

from tessitura.plans.scratch import shared_dir, written

__all__ = ["partitions", "shared_dir", "small_batches", "written"]

BATCH_BYTES = 4 << 20  # of texts that go to Python at once
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """What runs inside hands texts to Python in batches of BATCH_BYTES at most, or one text: buffers on both sides follow that, not the texts' length."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
