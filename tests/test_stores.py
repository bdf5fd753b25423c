"""The face store, sinks, image headers and the sweep."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.functions import images
from semblance.operators import photos
from semblance.sources import facestore, sinks, tables
from semblance.streaming import ingest


def jpeg(width, height, orientation=None, order="<"):
    exif = b""
    if orientation:
        tiff = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIH", 42, 8, 1) + struct.pack(f"{order}HHIH", 0x0112, 3, 1, orientation) + b"\0\0"
        payload = b"Exif\0\0" + tiff
        exif = b"\xff\xe1" + struct.pack(">H", len(payload) + 2) + payload
    return b"\xff\xd8" + exif + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, height, width) + b"\x01\x00\x00\x00" + b"\xff\xda"


def test_headers_and_turns(spark, tmp_path):
    assert images.frame_of(jpeg(32, 18, 6)) == (32, 18) and images.orientation_of(jpeg(32, 18, 6)) == 6 and images.orientation_of(jpeg(3, 2, 8, ">")) == 8
    assert images.orientation_of(jpeg(1, 1)) == 1 and images.orientation_of(None) == 1 and images.frame_of(b"\xff\xd8\xff") is None and images.frame_of(b"") is None
    a = np.arange(6).reshape(2, 3)
    flip = lambda x: x[:, ::-1]
    want = {1: a, 2: flip(a), 3: np.rot90(a, 2), 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a.T, 2), 8: np.rot90(a)}
    assert all(np.array_equal(images.upright(a, k), w) for k, w in want.items())
    assert images.cropped(a, [1, 0, 3, 1]).tolist() == [[1, 2]]
    for name, data in {"b.jpg": jpeg(32, 18), "a.jpg": jpeg(3, 2, 6), "Screenshot_1.jpg": jpeg(3, 2), "c.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = lambda **o: [r["name"] for r in tables.find_files(spark, str(tmp_path), ("jpg",), **o).select("name").collect()]
    assert found() == ["a.jpg", "b.jpg"] and found(drop_video_frames=True) == ["a.jpg"] and found(drop_screenshots=False)[0] == "Screenshot_1.jpg"
    h = spark.read.format("binaryFile").load(f"{tmp_path}/a.jpg").select(images.header("content").alias("h")).first()["h"]
    assert tuple(h) == (3, 2, 6)


def test_store_takes_a_face_once(spark, tmp_path):
    root = str(tmp_path)
    assert facestore.count(spark, root) == 0 and facestore.scanned_uids(spark, root).count() == 0
    new = spark.createDataFrame([("p", 0, "u", [1.0, 2.0]), ("p", 1, "u", [3.0, 4.0])], "photo_id string, face_index int, uid string, embedding array<float>")
    for _ in range(2):
        facestore.append(spark, root, new, 2)
    assert facestore.count(spark, root) == 2 and facestore.vectors(spark, root, 2).count() == 2
    with pytest.raises(Exception, match="a vector of 2 values, not 3"):
        facestore.vectors(spark, root, 3).collect()
    with pytest.raises(ValueError):
        facestore.append(spark, root, new.withColumn("photo_id", F.lit("q")), 3)
    assert facestore.metadata(spark, root).columns == [c for c in facestore.faces(spark, root).columns if c != "embedding"]


def test_scan_after_a_crash_repeats_nothing(spark, tmp_path):
    root = str(tmp_path)
    catalog = spark.createDataFrame([("u1", 0), ("u2", 0), ("u3", 1), ("bad", 1)], "uid string, batch int")

    def extract(entries):
        n = F.when(F.col("uid") == "u2", 0).otherwise(2)
        faces = entries.select("uid", F.explode_outer(F.slice(F.array(F.lit(0), F.lit(1)), 1, n)).alias("face_index"))
        return faces.select("uid", F.concat(F.lit("p"), "uid").alias("photo_id"), "face_index", F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.when(F.col("uid") == "bad", "broken").alias("error"))

    # a run that died between the faces and the log of the first batch
    facestore.append(spark, root, extract(catalog.where("batch = 0")).where("face_index IS NOT NULL").drop("error"))
    for _ in range(2):
        log = {r["uid"]: r["faces"] for r in ingest.scan(spark, catalog, root, extract, 1).collect()}
        assert log == {"u1": 2, "u2": 0, "u3": 2} and facestore.count(spark, root) == 4


def test_cached_catalog_that_is_empty_stays(spark, tmp_path):
    path, made = f"{tmp_path}/c", []

    def build():
        made.append(1)
        return spark.createDataFrame([], tables.CATALOG)

    for _ in range(3):
        assert tables.read_or_build(spark, path, tables.CATALOG, build).count() == 0
    assert len(made) == 1
    tables.read_or_build(spark, path, tables.CATALOG, build, refresh=True)
    assert len(made) == 2


def test_album_is_read_again_and_filled(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for u in ("a", "b", "c"):
        (tmp_path / "files" / u).write_text(u)
    (tmp_path / "albums.json").write_text(json.dumps([{"uid": "x", "name": {"ok": True, "value": "Ana"}}]))
    (tmp_path / "album-x.json").write_text(json.dumps([{"uid": "a"}]))
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("gone",)], "uid string")
    fill = lambda name: sinks.fill_album(wanted, name, "semblance.sources.remote:FileClient", 2, root=str(tmp_path)).first().asDict()
    assert fill("Ana") == {"added": 2, "missing": 1}
    assert fill("Ana") == {"added": 0, "missing": 1}
    assert fill("Eva") == {"added": 3, "missing": 1}


def test_origin_and_prune(spark, tmp_path):
    folder = f"{tmp_path}/person"
    sinks.save_origin(spark, folder, "pessoa_01", "id1", "t")
    sinks.save_origin(spark, folder, "pessoa_04", "id1", "t2")
    with pytest.raises(ValueError, match="id1"):
        sinks.save_origin(spark, folder, "pessoa_01", "id2", "t")
    files = [tmp_path / n for n in ("old.mp4", "new.mp4", "new.jpg")]
    for f in files:
        f.write_text("x")
    listed = spark.createDataFrame([(str(f), f.name) for f in files], "path string, name string")
    import os

    assert sinks.pruned_downloads(listed.limit(1), listed, ["jpg"], os.remove) == (1, 1)
    assert [f.exists() for f in files] == [True, False, True]


def test_first_path_and_last_row(spark):
    f = spark.createDataFrame([("p", "/b", 0), ("p", "/a", 0), ("p", "/a", 1), ("q", "/c", 0)], "photo_id string, path string, face_index int")
    assert sorted((r["photo_id"], r["path"], r["face_index"]) for r in photos.first_path_only(f).collect()) == [("p", "/a", 0), ("p", "/a", 1), ("q", "/c", 0)]
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "id string, at int, v string")
    assert photos.last_rows(rows, F.col("id"), "at").first()["v"] == "y"
    assert {r["name"] for r in photos.ranked_names(spark.createDataFrame([("pessoa_01",), ("x",)], "name string")).collect()} == {"pessoa_01"}


def test_cycles_end_when_nothing_comes(spark, tmp_path):
    sent, removed, left = [], [], [2]

    def fetch(folder):
        left[0] -= 1
        return max(0, left[0])

    def detect(folder):
        return spark.createDataFrame([("ph", "/lib/1.jpg", 1.0, 0, [1.0, 0.0], 80.0, 0.9)], ingest.DETECTION)

    assert ingest.cycle(spark, str(tmp_path), fetch, detect, sent.append, removed.append) == 1
    assert len(removed) == 1 and sent == list(range(len(sent))) and sent


def test_sweep_settings_come_from_the_environment(monkeypatch):
    from semblance.config import SweepConfig

    assert SweepConfig.from_environment() == SweepConfig()
    monkeypatch.setenv("SEMBLANCE_SWEEP_KEEP_EXT", ".jpg, .png")
    monkeypatch.setenv("SEMBLANCE_SWEEP_RECLUSTER_EVERY", "3")
    got = SweepConfig.from_environment()
    assert got.keep_ext == (".jpg", ".png") and got.resolving().recluster_every == 3 and got.max_size_mb == 3000
