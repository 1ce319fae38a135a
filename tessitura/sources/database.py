"""A data source of SQLite databases, as music servers keep them: row ranges as partitions, filters for the database, and a writer that commits.

Reading: ``path`` is a database file or a folder of such files. Each is cut into ranges of rowids, found from the least and the greatest one (two index lookups); a view or a table without rowids is one
range. A task reads the columns of the schema that was asked for, no others, and hands the filters that the database can answer to it; Spark applies all of them again, so a
result never depends on them. Rows are read as they come, in Arrow batches. Databases mustn't be written meanwhile: ranges are read by different connections.

Writing: every task writes its rows into a database of its own below ``path``, which gets its name only when all have ended, so readers see all of a write or, until the names are
given one by one, files of a write that is complete. Files of attempts that failed are removed; one that a task still wrote when its job was given up may stay, as ``*.part``, which nobody reads. SQLite has one writer at a time: a server takes such files in itself (ATTACH).

A path must be a folder that all machines have mounted.
"""

from __future__ import annotations

import contextlib
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessitura.sources.records import filesystem

ROWS = 10_000  # of an Arrow batch
RANGE = 1_000_000  # rowids of a partition
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
STORED = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB", T.TimestampType: "TEXT", T.DateType: "TEXT"}
COMPARED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.StringType)  # kinds whose order is the same in the database
SIGNS = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local(path: str) -> str:
    store, place = filesystem(path)
    if not isinstance(store, fs.LocalFileSystem):
        raise ValueError(f"a database needs a mounted folder: {path}")
    return place


def connected(path: str) -> contextlib.closing:
    return contextlib.closing(sqlite3.connect(f"file:{path.replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True))


def moment(value) -> datetime:
    """A time from ISO text or from seconds; one without a zone is UTC."""
    with contextlib.suppress(ValueError):
        return datetime.fromtimestamp(float(value), UTC)
    at = datetime.fromisoformat(value)
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def reader_of(kind: T.DataType):
    """What makes a value of the database one of the column's type; SQLite lets any column hold any type."""
    makes = {T.BooleanType: bool, T.TimestampType: moment, T.DateType: lambda v: date.fromisoformat(v[:10]), T.StringType: str, T.DoubleType: float, T.FloatType: float, T.BinaryType: lambda v: v.encode() if isinstance(v, str) else bytes(v)}
    if type(kind) not in STORED:
        raise ValueError(f"no column of a database holds {kind.simpleString()}")
    return makes.get(type(kind), int)


def stored(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, datetime):
        # Spark hands times over in the zone of the machine
        return value.astimezone(UTC).isoformat(" ")
    return value.isoformat() if isinstance(value, date) else bytes(value) if isinstance(value, bytearray) else str(value) if isinstance(value, Decimal) else value


def condition(f: D.Filter, kinds: dict[str, T.DataType]) -> tuple[str, list] | None:
    """A filter in the database's words, with its values; None where it can't say it the same way."""
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if type(kinds.get(name)) not in COMPARED:
        return None
    column = quoted(name)
    if isinstance(f, D.IsNull | D.IsNotNull):
        return f"{column} IS {'NOT ' if isinstance(f, D.IsNotNull) else ''}NULL", []
    if isinstance(f, D.In):
        values = [v for v in f.value if v is not None]
        return (f"{column} COLLATE BINARY IN ({', '.join('?' * len(values))})", [stored(v) for v in values]) if len(values) <= 500 else None
    return (f"{column} COLLATE BINARY {SIGNS[type(f)]} ?", [stored(f.value)]) if type(f) in SIGNS else None


@dataclass
class Rows(D.InputPartition):
    """Rows of one file from a rowid to another; all where there are none."""

    path: str
    first: int | None = None
    last: int | None = None


class TableReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options) -> None:
        self.kind, self.path, self.table, self.range = schema, options["path"], options["table"], int(options.get("range", RANGE))
        self.asked: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        kinds = {f.name: f.dataType for f in self.kind}
        for f in filters:
            if said := condition(f, kinds):
                self.asked.append(said)
            yield f

    def partitions(self) -> list[D.InputPartition]:
        place, out = local(self.path), []
        for path in [place] if os.path.isfile(place) else sorted(os.path.join(place, n) for n in os.listdir(place) if n.endswith(".db")):
            with connected(path) as db:
                try:
                    # two statements: one with both is a scan
                    low, high = (db.execute(f"SELECT {x}(rowid) FROM {quoted(self.table)}").fetchone()[0] for x in ("min", "max"))
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(Rows(path))
                    continue
            if not isinstance(low, int):  # an empty table, or a view, whose rows have no number
                out.append(Rows(path))
                continue
            out += [Rows(path, at, min(at + self.range - 1, high)) for at in range(low, high + 1, self.range)]
        return out or [Rows("")]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema, makes = to_arrow_schema(self.kind), [reader_of(f.dataType) for f in self.kind]
        asked = list(self.asked) + ([("rowid BETWEEN ? AND ?", [partition.first, partition.last])] if partition.first is not None else [])
        columns = ", ".join(quoted(f.name) for f in self.kind) or "1"
        sql = f"SELECT {columns} FROM {quoted(self.table)}" + (" WHERE " + " AND ".join(c for c, _ in asked) if asked else "")
        with connected(partition.path) as db:
            rows = db.execute(sql, [v for _, values in asked for v in values])
            while some := rows.fetchmany(ROWS):
                columns = [pa.array([None if v is None else make(v) for v in c], f.type) for c, f, make in zip(zip(*some, strict=True), schema, makes, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class Written(D.WriterCommitMessage):
    """A task's file, without the ending by which readers know it."""

    path: str
    n: int


class TableWriter(D.DataSourceWriter):
    def __init__(self, schema: T.StructType, options, overwrite: bool) -> None:
        self.kind, self.path, self.table, self.overwrite, self.job = schema, local(options["path"]), options["table"], overwrite, uuid.uuid4().hex
        for f in schema:
            reader_of(f.dataType)

    def write(self, iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        path, n = os.path.join(self.path, f"{self.job}-{uuid.uuid4().hex}.part"), 0
        columns = ", ".join(f"{quoted(f.name)} {STORED[type(f.dataType)]}" for f in self.kind)
        with contextlib.closing(sqlite3.connect(path)) as db:
            db.execute("PRAGMA journal_mode = OFF")  # a file that isn't whole is never read
            db.execute(f"CREATE TABLE {quoted(self.table)} ({columns})")
            n = db.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.kind))})", (tuple(map(stored, row)) for row in iterator)).rowcount
            db.commit()
        return Written(path, max(n, 0))

    def _left(self) -> list[str]:
        """Files of this write without a name: of attempts that failed or were stopped."""
        return [os.path.join(self.path, n) for n in os.listdir(self.path) if n.startswith(self.job) and n.endswith(".part")] if os.path.isdir(self.path) else []

    def commit(self, messages) -> None:
        old = [os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".db")] if self.overwrite else []
        for m in messages:
            if m:
                os.rename(m.path, m.path.removesuffix(".part") + ".db")
        for path in old + self._left():
            os.remove(path)

    def abort(self, messages) -> None:
        for path in self._left():
            with contextlib.suppress(FileNotFoundError):
                os.remove(path)


class DatabaseSource(D.DataSource):
    """Options: ``path``, ``table``, and ``range``, rowids of a partition."""

    @classmethod
    def name(cls) -> str:
        return "server_database"

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return TableReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> D.DataSourceWriter:
        return TableWriter(schema, self.options, overwrite)


def read_table(spark: SparkSession, path: str, table: str, schema: str | T.StructType, rows: int = RANGE) -> DataFrame:
    """The named columns of a table, of one database or of all in a folder. Turns the session's push-down of filters to Python sources on."""
    spark.dataSource.register(DatabaseSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("server_database").schema(schema).options(path=path, table=table, range=str(rows)).load()


def write_table(rows: DataFrame, path: str, table: str, overwrite: bool = False) -> None:
    """Write rows as a table of databases below a folder, one for each task."""
    rows.sparkSession.dataSource.register(DatabaseSource)
    rows.write.format("server_database").mode("overwrite" if overwrite else "append").options(path=path, table=table).save()
