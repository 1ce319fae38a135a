"""Every catalogued query against its DuckDB twin on the smallest tables."""

import functools
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessitura.plans import catalogue, syncing


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared():
    """Queries of one family share what they are taken from, so that it is worked out once."""
    with pytest.MonkeyPatch.context() as m:
        for module, names in ((catalogue, ("tracks", "canon", "_stored", "_whole", "_review", "_play_stats")), (syncing, ("_state", "_one", "_reconciled", "_server", "_canon"))):
            for n in names:
                m.setattr(module, n, functools.cache(getattr(module, n)))
        yield


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_twin(spark, duck, sf, name):
    df = catalogue.queries()[name](spark, sf)
    got = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in got.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    want = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(cell(r[c]) for c in order) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) == set(catalogue.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
