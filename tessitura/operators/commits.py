"""Committed plans: all tables of a plan become the new state at once, or none does.

A plan's tables are written into places of their own that nothing names yet. Then one row, the manifest of the next version, names the place of every table of the state: those of
the plan anew, all others as before. It is a single file that Spark's committer puts in place whole, so a reader sees the old version or the new one, never a part, and a run that fails on
the way leaves the old state as it was; what it had written is named by nothing (``unnamed`` lists it for clearing up). A run has an id, and one that is committed
already is not written again, so a repeated job changes nothing. Two runs that start from the same version can't both become the next: the later
one is refused (``Conflict``) and starts anew from the state it finds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, run_id string, based_on long, tables map<string,string>, written array<string>"


class Conflict(RuntimeError):
    """Another run has committed the version that this one was to become."""


@dataclass(frozen=True)
class State:
    """A committed version: its number (0: nothing yet), the run that made it, and the place of each table."""

    version: int
    run_id: str | None
    tables: dict[str, str]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.tables[name])


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """All versions. Of two manifests of one version, which only a race can leave, the first by run id counts."""
    try:
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{folder.rstrip('/')}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    first = rows.groupBy("version").agg(F.min_by(F.struct("run_id", "based_on", "tables", "written"), "run_id").alias("m"))
    return first.select("version", "m.*")


def state(spark: SparkSession, folder: str, version: int | None = None) -> State:
    """The newest version, or an earlier one."""
    rows = manifests(spark, folder)
    found = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.col("version").desc()).first()
    if found is None:
        if version:
            raise ValueError(f"there is no version {version}")
        return State(0, None, {})
    return State(found["version"], found["run_id"], dict(found["tables"]))


def commit(spark: SparkSession, plan: dict[str, DataFrame], folder: str, run_id: str, based_on: int | None = None, dry_run: bool = True) -> State:
    """Make the tables of ``plan`` part of the state; with ``dry_run`` give what the state would be and write nothing.

    ``based_on``: the version that the plan was worked out from; the newest one, if not given.
    """
    folder = folder.rstrip("/")
    done = manifests(spark, folder).where(F.col("run_id") == run_id).first()
    if done is not None:
        return State(done["version"], run_id, dict(done["tables"]))
    before = state(spark, folder)
    if based_on is not None and based_on != before.version:
        raise Conflict(f"version {before.version} was committed after {based_on}")
    own = f"{folder}/data/{run_id}-{uuid.uuid4().hex}"
    places = {name: f"{own}/{name}" for name in plan}
    after = State(before.version + 1, run_id, before.tables | places)
    if dry_run:
        return after
    for name, rows in plan.items():
        rows.write.parquet(places[name])
    row = spark.createDataFrame([(after.version, run_id, before.version, after.tables, sorted(places.values()))], MANIFEST).coalesce(1)
    try:
        row.write.mode("errorifexists").json(f"{folder}/manifests/{after.version:012d}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise Conflict(f"version {after.version} was committed meanwhile") from e
    if state(spark, folder, after.version).run_id != run_id:
        raise Conflict(f"version {after.version} was committed at the same time")
    return after


def unnamed(spark: SparkSession, folder: str) -> DataFrame:
    """(place): folders of tables that no version names, left by runs that failed or were refused. Only to be cleared when no run is on its way."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder.rstrip('/')}/data").select(F.regexp_replace("path", "/[^/]+$", "").alias("place")).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "place string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    named = manifests(spark, folder).select(F.explode(F.map_values("tables")).alias("named")).distinct()
    return files.join(named, plain(files["place"]) == plain(named["named"]), "left_anti")
