"""Queries over server databases: tables are written into database files in the shared folder, and read back by ranges of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessitura.plans import syncing
from tessitura.plans.scratch import shared_dir
from tessitura.sources import database

RANGE = 5_000  # rowids of a partition
FROM, NAMES = 1_262_304_000, "mf5"


def _through(spark: SparkSession, rows: DataFrame, table: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/server-{uuid.uuid4().hex}"
    database.write_table(rows, folder, table)
    return database.read_table(spark, folder, table, rows.schema, RANGE)


def database_annotations(spark, sf):
    """The annotations of a push, as the server's database holds them."""
    return _through(spark, syncing.push_annotations(spark, sf), "annotation")


def database_scrobbles(spark, sf):
    """Scrobbles of a push from the server's database, by a time and a name that the database looks for."""
    return _through(spark, syncing.push_scrobbles(spark, sf), "scrobbles").where(f"submission_time > {FROM} AND media_file_id >= '{NAMES}'")


SQL = {
    "database_annotations": syncing.SQL["push_annotations"],
    "database_scrobbles": f"SELECT * FROM ({syncing.SQL['push_scrobbles']}) WHERE submission_time > {FROM} AND media_file_id >= '{NAMES}'",
}

QUERIES = (database_annotations, database_scrobbles)
