"""The model adapter: one load a process, batches bounded by bytes, a broken image alone, upright pixels."""

import os
import struct
import uuid

import numpy as np
from pyspark.sql import functions as F

from semblance.streaming import ingest, model


def exif(orientation):
    tiff = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0) + b"\0\0\0\0"
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_one_load_a_process_and_poison_alone(spark, tmp_path):
    def load():
        (tmp_path / "loads").mkdir(exist_ok=True)
        (tmp_path / "loads" / uuid.uuid4().hex).write_text(str(os.getpid()))

        def run(images):
            (tmp_path / "calls").mkdir(exist_ok=True)
            (tmp_path / "calls" / uuid.uuid4().hex).write_text(str(sum(map(len, images))))
            if any(b"poison" in x for x in images):
                raise RuntimeError("cannot do this one")
            return [[{"bbox": [0.0, 0.0, 1.0, float(len(x))], "det_score": 0.9, "face_px": 60.0, "embedding": [1.0, float(x[0])]}] * (x[0] % 3) for x in images]

        return run

    rows = [(f"u{i:02d}", f"p{i}", bytes([i]) * (10 if i != 7 else 1000)) for i in range(40)] + [("bad", "p", b"poison"), ("none", "p", None)]
    images = spark.createDataFrame(rows[:-1], "uid string, photo_id string, content binary").repartition(8)
    for _ in range(2):
        out = model.detected(images, f"fake-{tmp_path.name}", load, batch_bytes=100).collect()
        assert [(r["uid"], r["face_index"]) for r in out if r["error"]] == [("bad", None)] and "cannot do this one" in next(r["error"] for r in out if r["error"])
        faces = {u: sum(r["face_index"] is not None for r in out if r["uid"] == u) for u in {r["uid"] for r in out}}
        assert faces == {"bad": 0} | {f"u{i:02d}": i % 3 for i in range(40)}
    loads = [p.read_text() for p in (tmp_path / "loads").iterdir()]
    assert len(loads) == len(set(loads))
    assert all(int(p.read_text()) <= 100 or int(p.read_text()) == 1000 for p in (tmp_path / "calls").iterdir())


def test_files_that_cannot_be_decoded_and_turned_pixels(spark):
    def decode(content):
        if content[:2] != b"\xff\xd8":
            raise ValueError("no image")
        return np.arange(6).reshape(2, 3)

    def load():
        return lambda pixels: [[{"bbox": [float(x) for x in p.ravel()], "face_px": float(p.shape[0])}] for p in pixels]

    images = spark.createDataFrame([("a", exif(1)), ("b", exif(6)), ("c", b"text")], "uid string, content binary").withColumn("photo_id", F.col("uid"))
    out = {r["uid"]: r for r in model.detected(images, "pixels", load, decode).collect()}
    assert out["a"]["bbox"] == [0, 1, 2, 3, 4, 5] and out["b"]["bbox"] == [3, 0, 4, 1, 5, 2] and out["b"]["face_px"] == 3
    assert "no image" in out["c"]["error"] and out["c"]["bbox"] is None


def test_scan_with_the_adapter(spark, tmp_path):
    files = {"u1": b"\x01", "u2": b"bad", "u3": b"\x00"}
    content = F.when(F.col("uid") == "u1", F.lit(bytearray(files["u1"]))).when(F.col("uid") == "u2", F.lit(bytearray(files["u2"]))).otherwise(F.lit(bytearray(files["u3"])))

    def load():
        def run(images):
            if any(x == b"bad" for x in images):
                raise OSError("cut off")
            return [[{"embedding": [0.5, 0.5]}] * x[0] for x in images]

        return run

    extract = lambda entries: model.detected(entries.withColumn("content", content).withColumn("photo_id", F.concat(F.lit("ph"), "uid")), "scan", load)
    catalog = spark.createDataFrame([("u1", 0), ("u2", 0), ("u3", 1)], "uid string, batch long")
    root = f"file://{tmp_path}/scan"
    log = ingest.scan(spark, catalog, root, extract, dim=2)
    assert {(r["uid"], r["faces"]) for r in log.collect()} == {("u1", 1), ("u3", 0)}
    assert [tuple(r) for r in spark.read.schema("uid string, error string").parquet(f"{root}/dead_letters").collect()] == [("u2", "OSError: cut off")]
