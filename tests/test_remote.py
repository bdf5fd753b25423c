import json
import sys

import pytest

from semblance.operators import cluster
from semblance.sources import remote as R

CLIENT = "semblance.sources.remote:FileClient"


@pytest.fixture
def root(tmp_path):
    (tmp_path / "short.json").write_text(json.dumps([{"nodeUid": "u1", "captureTime": "2024-01-01", "tags": ["a"]}, {"nodeUid": "u2", "captureTime": "2024-01-02", "tags": []}]))
    detailed = [
        {"uid": "u1", "name": {"ok": True, "value": "é.jpg"}, "mediaType": "image/jpeg", "totalStorageSize": 5, "creationTime": "c1", "photo": {"captureTime": "", "contentHash": "h"}},
        {"uid": "u2", "name": {"ok": False, "error": "x"}, "mediaType": "image/jpeg"},
        {"uid": "u3", "name": "b.jpg", "mediaType": "image/jpeg", "creationTime": "c3", "photo": None},
        {"uid": "u4", "name": "Screenshot_1.jpg", "mediaType": "image/jpeg"}, {"uid": "u5", "name": "c.jpg", "mediaType": "image/heic", "photo": {"captureTime": "t5", "contentHash": "h"}}, {"uid": "u6", "name": ""}, {"uid": "u7", "name": "v.mp4", "mediaType": "video/mp4"},
    ]
    (tmp_path / "detailed.json").write_text(json.dumps(detailed))
    (tmp_path / "albums.json").write_text(json.dumps([{"uid": "a1", "name": {"value": "Ana"}}, {"uid": "a2", "name": "Bia"}]))
    (tmp_path / "files").mkdir()
    (tmp_path / "out").mkdir()
    for u in ("u1", "u3"):
        (tmp_path / "files" / u).write_text(u)
    return tmp_path


def test_listings(spark, root):
    o = {"client": CLIENT, "root": str(root)}
    assert [(r["uid"], r["tags"]) for r in R.timeline(R.listing(spark, R.SHORT, **o)).collect()] == [("u1", ["a"]), ("u2", [])]
    c = R.catalog(R.listing(spark, R.DETAILED, **o))
    got = {r["uid"]: tuple(r)[1:] for r in c.collect()}
    assert set(got) == {"u1", "u3", "u4", "u5", "u7"}
    assert got["u1"] == ("é.jpg", "image/jpeg", 5, "c1", "h") and got["u3"] == ("b.jpg", "image/jpeg", 0, "c3", None)
    assert sorted(r["uid"] for r in R.pruned(c).collect()) == ["u1", "u3"]
    assert sorted(r["uid"] for r in R.pruned(c, keep_screenshots=True, keep_duplicates=True).collect()) == sorted(got)
    names = spark.createDataFrame([("Ana",), ("Eva",)], "name string")
    assert {r["name"]: r["uid"] for r in R.album_or_new(R.albums(R.listing(spark, R.ALBUMS, **o)), names).collect()} == {"Ana": "a1", "Eva": None}


def test_downloads_fall_back_to_single_entries(spark, root):
    entries = spark.createDataFrame([("u1", "a", 1), ("u3", "b", 1), ("u9", "c", 1)], "uid string, name string, size long")
    planned = cluster.planned_batches(entries, ["uid"], "name", "size", 10, 9)
    got = R.downloaded(planned, CLIENT, str(root / "out"), root=str(root)).collect()
    assert {r["uid"]: r["ok"] for r in got} == {"u1": True, "u3": True, "u9": False} and (root / "out" / "u3").read_text() == "u3"
    times = R.timeline(R.listing(spark, R.SHORT, client=CLIENT, root=str(root)))
    manifest = spark.createDataFrame([("u2", "old")], "uid string, captureTime string")
    results = spark.createDataFrame(got)
    assert {r["uid"] for r in R.manifest_with(manifest, results, times).collect()} == {"u1", "u2"}
    assert tuple(R.counters(times, manifest, results).first()) == (2, 1, 2, 1)


def test_files_and_origin(spark):
    after = spark.createDataFrame([("a.jpg",), ("b.MP4",), ("old.mp4",)], "name string")
    before = spark.createDataFrame([("old.mp4",)], "name string")
    assert [r["name"] for r in R.unwanted(after, before, [".jpg"]).collect()] == ["b.MP4"]
    batch = spark.createDataFrame([("a.jpg", "u1")], "name string, uid string")
    found, lost = R.matched_files(after, batch)
    assert found.count() == 1 and lost.count() == 2
    marker = spark.createDataFrame([("id1", "pessoa_01")], "id string, pessoa string")
    R.checked_origin(marker, "pessoa_03", "id1")
    with pytest.raises(ValueError):
        R.checked_origin(marker, "pessoa_01", "id2")


def test_commands_that_fail_say_what_ran():
    c = R.CommandClient({"command": f"{sys.executable} -c raise(SystemExit('no'))"})
    with pytest.raises(R.CommandError, match="list short --json: no"):
        c.listing("short")
