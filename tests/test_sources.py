"""Readers on tiny exports, detection and the stream."""

import io
import json
import plistlib
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessitura.sources import exports, registry
from tessitura.sources.detect import detect
from tessitura.streaming import scrobbles


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    t = {str(i): {"Track ID": i, "Name": f"s{i}", "Artist": "a", "Total Time": 1500, "Loved": True, "Apple Music": i == 2, "Date Added": datetime(2020, 1, i)} for i in (1, 2)}
    lists = [{"Name": "p", "Playlist Persistent ID": "P", "Playlist Items": [{"Track ID": x} for x in (9, 1, 1, 9, 2)]}, {"Name": "smart", "Playlist Persistent ID": "S", "Smart Info": b"x"}]
    (tmp_path / "lib.xml").write_bytes(plistlib.dumps({"Tracks": t, "Playlists": lists}))
    tracks = json.dumps([{"Track Identifier": 5, "Title": "t5", "Artist": "a", "Date Added To Library": "2020-01-02T03:04:05Z"}, {"Track Identifier": 6, "Title": "t6"}])
    pls = json.dumps([{"Container Identifier": 1, "Title": "l", "Playlist Item Identifiers": [6, 5, 6, 7] * 3}, {"Container Identifier": 2, "Container Type": "Folder", "Playlist Item Identifiers": [5]}])
    act = "Event Type,Album Name,Song Name,Play Duration Milliseconds,Event Timestamp,Event End Timestamp\nPLAY_END,al,so,40000,,2020-01-01T00:00:00Z\nPLAY_END,al,so,1000,2020-01-01T00:00:00Z,\nPLAY_END,al,,40000,2020-01-01T00:00:00Z,\nSKIP,al,so,40000,,\n"
    inner = archive({"x/Apple Music Library Tracks.json.zip": archive({"t.json": tracks}), "x/Apple Music Library Playlists.json.zip": archive({"p.json": pls}), "x/Apple Music Play Activity.csv": act})
    (tmp_path / "ms.zip").write_bytes(archive({"deep/Apple_Media_Services.zip": inner}))
    (tmp_path / "spot").mkdir()
    (tmp_path / "spot/h.json").write_text(json.dumps([{"ts": "2020-01-01T00:00:00Z", "ms_played": 40000, "master_metadata_track_name": "n", "master_metadata_album_artist_name": "a", "master_metadata_album_album_name": "b"}, {"ts": "2020-01-01T00:00:00Z", "ms_played": 40000, "master_metadata_track_name": "n", "master_metadata_album_artist_name": None, "master_metadata_album_album_name": "b"}, {"ts": "2020-01-01T00:00:00Z", "ms_played": 10, "master_metadata_track_name": "n"}]))
    line = json.dumps({"listened_at": 1577836800, "track_metadata": {"track_name": "n", "artist_name": "a"}})
    (tmp_path / "lb").mkdir()
    (tmp_path / "lb/2020.jsonl").write_text(line + "\n" + line.replace("1577836800", '"2020-01-02T00:00:00Z"') + "\n")
    (tmp_path / "lb.zip").write_bytes(archive({"listens/2020.jsonl": line, "other.jsonl": line}))
    (tmp_path / "s.csv").write_text("a,b,t,01 Jan 1970 00:00\na,b,,01 Jan 1970 00:00\na,b,u,01 Jan 1970 03:00\na,b,v,02 Mar 2020 10:20\n")
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio/x.mp3").write_bytes(b"ID3")
    return tmp_path


def test_detection(spark, folder):
    (folder / "names.mp3").mkdir()
    (folder / "names.mp3/a.txt").write_text("x")
    (folder / "up.XML").write_bytes(b"<?XML version='1.0'?><!DOCTYPE PLIST>")
    (folder / "odd.csv").write_bytes(b"\xff\xfe,b,c,d")
    (folder / "short.csv").write_text("a,b,c\n")
    want = {"lib.xml": "plist", "ms.zip": "media_services", "spot": "streaming_history", "lb": "listens", "lb.zip": "listens", "s.csv": "scrobble_csv", "audio": "audio"}
    assert {n: detect(spark, str(folder / n)) for n in want} == {n: [k] for n, k in want.items()}
    assert detect(spark, str(folder / "up.XML")) == ["plist"]
    assert [detect(spark, str(folder / n)) for n in ("none", "names.mp3", "odd.csv", "short.csv")] == [[]] * 4


def test_importers(spark, folder):
    got = registry.ingest(spark, f"{folder}/ms.zip")
    assert [k.name for k in got] == ["TRACKS", "PLAYLISTS", "SCROBBLES"] and got[registry.DataKind.TRACKS].count() == 2
    assert registry.importer_for(spark, f"{folder}/spot").kinds == registry.DataKind.SCROBBLES
    for path in ("none", ""):
        with pytest.raises(ValueError):
            registry.importer_for(spark, f"{folder}/{path}")
    mine = registry.Importer("mine", {registry.DataKind.TRACKS: lambda spark, path: spark.range(1)})
    registry.register(mine)
    assert registry.ingest(spark, str(folder), "mine")[registry.DataKind.TRACKS].count() == 1
    del registry.IMPORTERS["mine"]


def test_plist(spark, folder):
    t = exports.plist_tracks(spark, f"{folder}/lib.xml")
    rows = {r["source_id"]: r for r in t.selectExpr("*", "variant_get(extra, '$.apple_music', 'boolean') am").collect()}
    assert rows["1"]["title"] == "s1" and rows["2"]["am"] is True and rows["1"]["date_added"].day == 1
    m = exports.plist_members(exports.plist_playlists(spark, f"{folder}/lib.xml"), t)
    assert sorted((r["source_id"], r["position"]) for r in m.collect()) == [("1", 2), ("2", 4)]
    assert exports.unseen(t, t.where("source_id = '1'")).count() == 1


def test_media_services(spark, folder):
    path = f"{folder}/ms.zip"
    t = exports.media_services_tracks(spark, path)
    rows = {r["source_id"]: r for r in t.collect()}
    assert rows["5"]["date_added"] == datetime(2020, 1, 2, 3, 4, 5) and rows["6"]["compilation"] is False
    m = exports.media_services_members(exports.media_services_playlists(spark, path), t)
    assert sorted((r["source_id"], r["position"]) for r in m.collect()) == [("5", 2), ("6", 1)]
    assert [(r["title"], r["album"], r["artist"]) for r in exports.play_activity(spark, path).collect()] == [("so", "al", None)]


def test_scrobble_exports(spark, folder):
    good, apart = exports.streaming_history(spark, f"{folder}/spot")
    assert (good.count(), apart.count()) == (1, 1)
    assert sorted(r["date"].day for r in exports.listens(spark, f"{folder}/lb").collect()) == [1, 2]
    assert exports.listens(spark, f"{folder}/lb.zip").count() == 1
    got = {r["title"]: r["date"] for r in exports.scrobble_csv(spark, f"{folder}/s.csv").collect()}
    assert got == {"t": datetime(2010, 1, 1), "u": datetime(2010, 1, 1, 0, 5), "v": datetime(2020, 3, 2, 10, 20)}
    assert exports.audio_files(spark, f"{folder}/audio").first()["ext"] == "mp3"


def test_dedup_groups_round_trip(spark, folder):
    (folder / "g.json").write_text(json.dumps({"one": {"members": ["b", "a"], "canon_hashes": [None, "b"]}, 'two "q"': {"members": ["c"], "canon_hashes": [None]}}))
    g = exports.dedup_groups(spark, f"{folder}/g.json")
    rows = lambda df: sorted((r["group_id"], r["member_hash"], r["canon_hash"] or "") for r in df.collect())
    assert rows(g) == [("one", "a", "b"), ("one", "b", ""), ('two "q"', "c", "")]
    exports.write_dedup_groups(g, f"{folder}/out")
    assert rows(exports.dedup_groups(spark, f"{folder}/out")) == rows(g)
    more = spark.createDataFrame([("new", "a", None), ("new", "b", None), ("x", "z", None)], "group_id string, member_hash string, canon_hash string")
    state, counts = exports.imported_groups(g, more)
    assert tuple(counts.first()) == (1, 1) and rows(state) == [("new", "a", ""), ("new", "b", ""), ('two "q"', "c", ""), ("x", "z", "")]


def test_plist_rows_dont_grow_with_the_file(spark, tmp_path):
    """What goes to Python at once is a number of rows, so each holds a fixed part of its file."""
    tracks = {str(i): {"Track ID": i, "Name": f"song {i}" * (200 if i == 7 else 1)} for i in range(3_000)}
    (tmp_path / "lib.xml").write_bytes(plistlib.dumps({"Tracks": tracks}, fmt=plistlib.FMT_XML))
    most = exports._pieces(spark, str(tmp_path)).agg(F.max(F.length("piece")), F.count("*")).first()
    assert most[0] < 2 * exports.HELD and most[1] > 60
    got = exports.plist_tracks(spark, str(tmp_path)).select("source_id", "title").collect()
    assert {r[0]: r[1] for r in got} == {k: v["Name"] for k, v in tracks.items()} and len(got) == 3_000


def test_stream_takes_each_date_once(spark, tmp_path):
    d = lambda h: datetime(2020, 1, 1, h)
    put = lambda rows: spark.createDataFrame(rows, scrobbles.SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    put([(1, d(1), "p", "t", "", ""), (2, d(2), "p", "t", "", "")])
    run = lambda: scrobbles.import_into(scrobbles.watch(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    run()
    put([(3, d(2), "p", "u", "", ""), (4, d(3), "p", "u", "", "")])
    run()
    assert sorted((r["date"].hour, r["title"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "t"), (2, "t"), (3, "u")]


def test_plist_is_parsed_as_it_is_read(spark, tmp_path):
    """Pieces of any length, other orders of keys and the binary form give what the whole file gives; a task holds one playlist of a large library."""
    lists = [{"Playlist Items": [{"Track ID": (i * j) % 7} for j in range(i % 5)], "Name": f"a & <{i}> é", "Playlist Persistent ID": f"P{i}", "Folder": i % 3 == 0, "Nested": {"x": [{"Playlists": [1]}]}, **({"Smart Info": b"x"} if i % 11 == 0 else {}), **({"Description": "d"} if i % 2 else {})} for i in range(40)]
    library = {"Before": {"Playlists": [{"Name": "none"}]}, "Playlists": lists, "Tracks": {"1": {"Track ID": 1, "Name": "<dict>"}}}
    want = []
    for p in lists:
        if not p.get("Smart Info"):
            want += [(p["Playlist Persistent ID"], p["Name"], p.get("Description"), p["Folder"], i, str(x["Track ID"]) if x else None) for i, x in enumerate(p["Playlist Items"] or [{}])]
    key = lambda r: (r[0], r[4])
    for name, form, cut in (("x.xml", plistlib.FMT_XML, "64"), ("x.xml", plistlib.FMT_XML, "128m"), ("b.xml", plistlib.FMT_BINARY, "64")):
        (tmp_path / name).write_bytes(plistlib.dumps(library, fmt=form, sort_keys=False))
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        try:
            assert sorted(map(tuple, exports.plist_playlists(spark, str(tmp_path / name)).collect()), key=key) == sorted(want, key=key)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    parser, most, data = exports.Entries(short=("Playlist Items", exports._track_id)), 0, plistlib.dumps({"Playlists": lists * 50}, fmt=plistlib.FMT_XML)
    for at in range(0, len(data), 1000):
        most = max(most, len(parser.feed(data[at : at + 1000])), sum(len(x[0] or ()) for x in parser.open))
    assert most < 20


@pytest.mark.parametrize("n", [5, 1000])
def test_exports_have_a_file_for_each_partition(spark, tmp_path, n):
    """No task writes more than one file, and there are as many as the session has partitions, so that none grows with the input alone."""
    from tessitura.plans import imports

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = spark.range(n).withColumn("task", F.lit(0))
        out = imports._lines(rows, F.to_json(F.struct("id")), str(tmp_path / "a"), "json", head="[", tail="]", between=",")
        fixed = imports._lines(rows, F.col("id").cast("string"), str(tmp_path / "b"), "csv", blocks=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = sorted([r["id"] for r in json.loads(f.read_text())] for f in (tmp_path / "a").glob("*.json"))
    assert out == str(tmp_path / "a") and found == sorted(list(range(b, n, 12)) for b in range(12))
    kept = sorted([int(x) for x in f.read_text().split()] for f in (tmp_path / "b").glob("*.csv"))
    assert fixed == str(tmp_path / "b") and kept == [list(range(b, n, 8)) for b in range(min(n, 8))]


def test_blocks_are_dealt_one_to_a_task(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from tessitura.plans import imports

    seen, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path, **more: (seen.extend(map(tuple, self._df.select("b", F.spark_partition_id()).distinct().collect())), text(self, path, **more))[1])
    imports._lines(spark.range(100), F.col("id").cast("string"), str(tmp_path / "a"), "txt")
    assert sorted(seen) == [(b, b) for b in range(8)]
