"""Server databases: ranges of rows, filters in the database and again in Spark, types, empty tables and views, and writes that fail."""

import os
import sqlite3
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from tessitura.sources import database as DB


@pytest.fixture
def server(tmp_path):
    path = str(tmp_path / "server.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE media_file (id TEXT PRIMARY KEY, "order" TEXT COLLATE NOCASE, n INTEGER, starred INTEGER, at TEXT, rest TEXT)')
        db.executemany("INSERT INTO media_file VALUES (?, ?, ?, ?, ?, ?)", [(f"m{i}", "Ab" if i % 2 else "ab", None if i % 5 == 0 else i, i % 2, "2020-01-02 03:04:05.000006+00:00" if i else 1577934245, "x") for i in range(25)])
        db.execute("DELETE FROM media_file WHERE n BETWEEN 8 AND 12")
        db.execute("CREATE TABLE empty (id TEXT)")
        db.execute("CREATE TABLE pairs (a TEXT, b INTEGER, PRIMARY KEY (a, b)) WITHOUT ROWID")
        db.execute("INSERT INTO pairs VALUES ('x', 1), ('y', 2)")
        db.execute("CREATE VIEW stars AS SELECT id FROM media_file WHERE starred")
    return path


def test_ranges_and_filters(spark, server):
    t = DB.read_table(spark, server, "media_file", "id string, order string, n long, starred boolean, at timestamp", 4)
    assert t.rdd.getNumPartitions() == 7
    rows = {r["id"]: r for r in t.collect()}
    assert len(rows) == 21 and rows["m3"]["starred"] is True and rows["m5"]["n"] is None
    assert t.select(F.collect_set(F.unix_micros("at"))).first()[0].__len__() == 2
    ids = lambda c: sorted(r["id"] for r in t.where(c).select("id").collect())
    assert ids("order = 'ab'") == sorted(f"m{i}" for i in range(25) if i % 2 == 0 and f"m{i}" in rows)  # not by the column's own collation
    assert ids("n > 20 AND starred") == ["m21", "m23"]
    assert ids("n IS NULL") == ["m0", "m10", "m15", "m20", "m5"]
    assert ids("n IN (1, 2, 99)") == ["m1", "m2"] and ids("id LIKE 'm2%' AND n < 23") == ["m2", "m21", "m22"]
    assert ids("at < timestamp'2019-01-01'") == []


def test_filters_reach_the_database(server):
    from pyspark.sql import datasource as D
    from pyspark.sql.types import StructType

    r = DB.TableReader(StructType.fromDDL("id string, n long, at timestamp"), {"path": server, "table": "media_file"})
    filters = [D.GreaterThan(("n",), 20), D.EqualTo(("at",), datetime(2020, 1, 1)), D.StringContains(("id",), "m")]
    assert list(r.pushFilters(filters)) == filters and r.asked == [('"n" COLLATE BINARY > ?', [20])]
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 4  # 21 to 24


def test_tables_without_numbers(spark, server):
    assert DB.read_table(spark, server, "empty", "id string").count() == 0
    assert sorted(map(tuple, DB.read_table(spark, server, "pairs", "b long, a string").collect())) == [(1, "x"), (2, "y")]
    assert DB.read_table(spark, server, "stars", "id string").count() == 10
    with pytest.raises(Exception, match="no such table"):
        DB.read_table(spark, server, "none", "id string").collect()


def test_round_trip(spark, tmp_path):
    schema = "k long, s string, b boolean, d double, t timestamp, y date, x binary"
    rows = [(1, "a'é\U0001f600", True, 0.1, datetime(1969, 12, 31, 23, 0, 0, 7), date(2024, 2, 29), b"\x00\xff"), (None,) * 7, (2**63 - 1, "", False, -1e300, datetime(2024, 1, 1), date(1900, 1, 1), b"")]
    given, folder = spark.createDataFrame(rows, schema).repartition(3), f"{tmp_path}/a b"
    DB.write_table(given, folder, "my table")
    got = DB.read_table(spark, folder, "my table", schema)
    assert got.exceptAll(given).count() == given.exceptAll(got).count() == 0
    DB.write_table(given.where("k = 1"), folder, "my table", overwrite=True)
    assert DB.read_table(spark, folder, "my table", schema).count() == 1
    DB.write_table(given.where("k = 1"), folder, "my table")
    assert DB.read_table(spark, folder, "my table", schema).count() == 2
    assert DB.moment("2020-01-02 00:00:00") == datetime(2020, 1, 2, tzinfo=UTC)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/w"
    DB.write_table(spark.range(5), folder, "t")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 60, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="bad row|Writing job aborted|failed"):
        DB.write_table(bad, folder, "t", overwrite=True)
    assert DB.read_table(spark, folder, "t", "id long").count() == 5
    assert not [n for n in os.listdir(folder) if n.endswith(".part")]
    with pytest.raises(Exception, match="no column"):
        DB.write_table(spark.range(1).select(F.array("id").alias("a")), folder, "t")
