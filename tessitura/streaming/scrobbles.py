"""Scrobbles as a stream: each micro-batch brings only dates that were never seen."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.history import fresh_scrobbles

SCHEMA = "id long, date timestamp, platform string, title string, artist string, album string"
SINK = "date timestamp, title string, artist string, album string, platform string, day date, batch long"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, in SCHEMA."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def imported(spark: SparkSession, table: str) -> DataFrame:
    """What the folder holds; empty before the first batch."""
    try:
        return spark.read.schema(SINK).parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SINK)


def import_into(stream: DataFrame, table: str, checkpoint: str, once: bool = True):
    """Append fresh scrobbles to the Parquet folder ``table``, partitioned by day and batch.

    A batch compares its dates with the days that it touches only, not with the whole table, and replaces what it wrote itself before, so a
    repeated batch changes nothing.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", F.to_date("date"))
        days = rows.select("day").distinct()
        seen = imported(spark, table).where(F.col("batch") != number).join(F.broadcast(days), "day", "left_semi") if batch_is_bounded(days) else imported(spark, table).where(F.col("batch") != number)
        fresh = fresh_scrobbles(batch, seen.select("date"))
        out = fresh.withColumns({"day": F.to_date("date"), "batch": F.lit(number).cast("long")})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(table)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def batch_is_bounded(days: DataFrame, most: int = 100_000) -> bool:
    """Whether a batch touches few enough days to send them to every task."""
    return days.count() <= most
