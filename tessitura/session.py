"""Session construction and the settings every plan relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", partitions: int = 8, **more: str) -> SparkSession:
    """A local session; on a cluster the submitter's own session is used as it is."""
    builder = SparkSession.builder.master(master).appName("tessitura")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions), **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the parquet tables of a data folder, read by Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table dealt over the cores where its files give fewer tasks than that; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
