"""Keyed state in streams: what remotes' lists held last, and the dates that are taken.

Both keep their state by key in RocksDB, in the stream's checkpoint: a stream that is stopped, or loses executors, goes on where it was, and rows that come again
change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SNAPSHOT = "playlist_id long, remote string, version long, track_id long, n long"
CHANGE = "playlist_id long, remote string, version long, track_id long, change long"
HELD = ["playlist_id", "remote", "version", "head", "track_id", "n"]  # the columns of a table of snapshots
SCROBBLE = "id long, date timestamp, platform string, title string, artist string, album string"


@contextmanager
def keyed_state(spark: SparkSession):
    """A stream started inside keeps its state in RocksDB; the setting is taken when it starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def watch(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, its folders included."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)


def append(stream: DataFrame, table: str, checkpoint: str, once: bool = True):
    """Start a stream into a Parquet folder, each row exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint)
    with keyed_state(stream.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def snapshot_changes(held: pd.DataFrame, came: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """What the snapshots that came change, and the last snapshot of every list, held or new; None if no snapshot is newer than the one held. Both tables are in HELD.

    A track's count is added in its own snapshot and taken away in the next one, so all lists are worked out in a few passes, whatever their number.
    """
    rows = pd.concat([held, came], ignore_index=True)
    old = np.arange(len(rows)) < len(held)
    of = rows.groupby(["playlist_id", "remote"], sort=False).ngroup().to_numpy()
    version = rows["version"].to_numpy("int64")
    known, had = np.zeros(of.max() + 1, bool), np.zeros(of.max() + 1, "int64")
    known[of[old]], had[of[old]] = True, version[old]
    keep = old | ~known[of] | (version > had[of])
    if not (keep & ~old).any():
        return pd.DataFrame(), None
    rows = rows[keep].assign(_of=of[keep], _old=old[keep]).drop_duplicates(["_of", "version", "head", "track_id"])
    step = rows.groupby(["_of", "version"], sort=True).ngroup().to_numpy()  # snapshots by list and version
    first = np.unique(step, return_index=True)[1]  # a row of each
    lists = rows["_of"].to_numpy()[first]
    goes_on = np.append(lists[1:] == lists[:-1], False)
    member, n, track = ~rows["head"].to_numpy(), rows["n"].to_numpy("int64"), rows["track_id"].to_numpy("int64")
    plus, minus = member & ~rows["_old"].to_numpy(), member & goes_on[step]
    change = pd.DataFrame({"step": np.concatenate([step[plus], step[minus] + 1]), "track_id": np.concatenate([track[plus], track[minus]]), "change": np.concatenate([n[plus], -n[minus]])})
    change = change.groupby(["step", "track_id"], as_index=False)["change"].sum()
    change = change[change["change"] != 0]
    out = rows[["playlist_id", "remote", "version"]].iloc[first[change["step"]]].reset_index(drop=True)
    return out.assign(track_id=change["track_id"].to_numpy(), change=change["change"].to_numpy()), rows.loc[~goes_on[step], HELD]


class _Bases(StatefulProcessor):
    """The last snapshots of a share of many lists, in one table."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "lists binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat([r[HELD] for r in rows], ignore_index=True)
        held = pa.ipc.open_stream(self.base.get()[0]).read_all().to_pandas() if self.base.exists() else came[:0]
        changed, last = snapshot_changes(held, came)
        if last is not None:
            table, data = pa.Table.from_pandas(last, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(data, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(table)
            self.base.update((data.getvalue().to_pybytes(),))
        if len(changed):
            yield changed

    def close(self) -> None:
        pass


def list_changes(snapshots: DataFrame, shares: int = 1, tables: int = 1024) -> DataFrame:
    """What each snapshot of a remote's list changes against the one before: (playlist_id, remote, version, track_id, change), change the difference of the track's counts.

    ``snapshots``, a stream in SNAPSHOT: a row for each track of a list with its count, and one without a track for each snapshot, so that empty lists are told. All rows of
    a snapshot come in one file. Versions that aren't newer than the last one seen change nothing. Lists are dealt over so many ``tables``, each one state, as a state of its own for each list takes
    a call of Python for each; and cut into ``shares`` by track, so a very long list isn't one task. A stream keeps the numbers it began with. Rows with no list, remote or version are left out.
    """
    whole = snapshots.where("playlist_id is not null and remote is not null and version is not null")
    head = F.col("track_id").isNull()
    share = F.when(head, F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.pmod(F.xxhash64("track_id"), F.lit(shares)).cast("int")))
    rows = whole.select("playlist_id", "remote", "version", head.alias("head"), F.coalesce("track_id", F.lit(0)).alias("track_id"), F.coalesce("n", F.lit(0)).alias("n"), F.explode(share).alias("share"))
    keyed = rows.withColumn("table", F.pmod(F.xxhash64("playlist_id", "remote"), F.lit(tables)).cast("int"))
    return keyed.groupBy("table", "share").transformWithStateInPandas(_Bases(), CHANGE, "append", "none")


class _Dates(StatefulProcessor):
    """Whether a date is taken."""

    def __init__(self, expires: bool) -> None:
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.taken = handle, handle.getValueState("taken", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for some in rows:
            least = some.nsmallest(1, "id")
            first = least if first is None or least["id"].iloc[0] < first["id"].iloc[0] else first
        if not self.taken.exists():
            self.taken.update((int(first["id"].iloc[0]),))
            if self.expires:
                self.handle.registerTimer(int(first["date"].iloc[0].timestamp() * 1000))
            yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.taken.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_of_dates(scrobbles: DataFrame, delay: str | None = None) -> DataFrame:
    """The scrobble that takes each date: of the batch that brings the date first, the one of the least id.

    ``scrobbles``, a stream in SCROBBLE; rows without a date or id are left out. Without ``delay`` every date stays known, so nothing is ever taken twice or lost, and the state grows with the dates. With one
    (``"30 days"``) a watermark on the date lets go of older ones, and rows that come later than that are left out: for live feeds only, exports take none.
    """
    rows = scrobbles.where("date is not null and id is not null")
    if delay:
        rows = rows.withWatermark("date", delay)
    return rows.groupBy("date").transformWithStateInPandas(_Dates(bool(delay)), SCROBBLE, "append", "eventTime" if delay else "none")
