"""A plan's tables become the state together or not at all."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessitura.operators import commits


def held(spark, folder, version=None):
    s = commits.state(spark, folder, version)
    return s.version, {n: sorted(r[0] for r in s.read(spark, n).collect()) for n in s.tables}


def test_versions(spark, tmp_path):
    folder, t = str(tmp_path / "s"), spark.range
    assert commits.state(spark, folder).version == 0
    dry = commits.commit(spark, {"a": t(2)}, folder, "r1")
    assert dry.version == 1 and not (tmp_path / "s").exists()
    commits.commit(spark, {"a": t(2), "b": t(1)}, folder, "r1", dry_run=False)
    assert held(spark, folder) == (1, {"a": [0, 1], "b": [0]})
    now = commits.state(spark, folder)
    commits.commit(spark, {"a": now.read(spark, "a").where("id > 0")}, folder, "r2", now.version, dry_run=False)
    assert held(spark, folder) == (2, {"a": [1], "b": [0]}) and held(spark, folder, 1) == (1, {"a": [0, 1], "b": [0]})
    again = commits.commit(spark, {"a": t(9)}, folder, "r2", dry_run=False)  # a repeated run changes nothing
    assert again.version == 2 and held(spark, folder) == (2, {"a": [1], "b": [0]})
    with pytest.raises(ValueError):
        commits.state(spark, folder, 7)
    assert commits.unnamed(spark, folder).count() == 0


def test_a_failed_run_leaves_the_old_state(spark, tmp_path):
    folder = str(tmp_path / "s")
    commits.commit(spark, {"a": spark.range(3), "b": spark.range(2)}, folder, "good", dry_run=False)
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    for _ in range(2):
        with pytest.raises(PySparkException):
            commits.commit(spark, {"a": spark.range(9), "b": broken}, folder, "bad", dry_run=False)
        assert held(spark, folder) == (1, {"a": [0, 1, 2], "b": [0, 1]})
    left = [r["place"] for r in commits.unnamed(spark, folder).collect()]
    assert len(left) >= 2 and all("/bad-" in p for p in left)
    commits.commit(spark, {"a": spark.range(9), "b": spark.range(1)}, folder, "bad", dry_run=False)  # the run starts again
    assert held(spark, folder)[0] == 2


def test_two_runs_from_one_version(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    commits.commit(spark, {"a": spark.range(1)}, folder, "one", dry_run=False)
    based = commits.state(spark, folder)
    commits.commit(spark, {"a": spark.range(2)}, folder, "two", based.version, dry_run=False)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, {"a": spark.range(3)}, folder, "late", based.version, dry_run=False)
    # one that looked before the other's manifest was there
    real = commits.state
    monkeypatch.setattr(commits, "state", lambda s, f, v=None: based if v is None else real(s, f, v))
    with pytest.raises(commits.Conflict):
        commits.commit(spark, {"a": spark.range(3)}, folder, "late", dry_run=False)
    monkeypatch.undo()
    # both manifests written at once: the first by run id counts
    row = commits.manifests(spark, folder).where("version = 2").withColumn("run_id", F.lit("zz"))
    row.write.mode("append").json(f"{folder}/manifests/{2:012d}")
    assert commits.state(spark, folder).run_id == "two" and held(spark, folder) == (2, {"a": [0, 1]})


def test_committed_state_places_items_once(spark, sf, monkeypatch):
    """The versions' tables come from one join and one sort of the items, whatever they hold of them."""
    from tessitura.plans import imports

    calls, plain = [], imports.V.playlist_item_v
    monkeypatch.setattr(imports.V, "playlist_item_v", lambda *a: calls.append(a) or plain(*a))
    out = imports.committed_state(spark, sf)
    assert len(calls) == 1 and {(r["version"], r["kind"]) for r in out.select("version", "kind").distinct().collect()} == {(v, k) for v in (1, 2) for k in ("item", "link")}
