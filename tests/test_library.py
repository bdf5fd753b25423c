"""A library from its files to its views: new, changed, broken and excluded images, both phases, a recluster, another model."""

import json
import os
import struct

from semblance.config import ResolveConfig
from semblance.plans import library

CFG = ResolveConfig(match=0.5, uncertain=0.6, coherence=0.5, min_person_photos=2)


def png(width, height, faces):
    """A header with a frame size, and what the fake model is to find."""
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + json.dumps(faces).encode()


A, B, C = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]


def test_a_library(spark, tmp_path):
    folder, root = tmp_path / "lib", f"file://{tmp_path}/root"
    folder.mkdir()

    def load():
        def run(images):
            if any(x[24:] == b"broken" for x in images):
                raise ValueError("broken image")
            return [[{"embedding": v, "det_score": 0.9, "face_px": px, "bbox": [0.0, 0.0, 1.0, 1.0]} for v, px in json.loads(x[24:])] for x in images]

        return run

    def put(name, faces, size=(400, 300), when=1000):
        (folder / name).write_bytes(png(*size, faces) if faces is not None else b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 4, 3) + b"broken")
        os.utime(folder / name, (when, when))

    put("a1.jpg", [(A, 80.0)])
    put("a2[x].jpg", [(A, 80.0), (B, 80.0)])
    put("b1.jpg", [(B, 80.0), (C, 10.0)])
    put("many.jpg", [(A, 80.0), (B, 80.0), (C, 80.0)])
    put("none.jpg", [])
    put("wide.jpg", [(C, 80.0)], (1920, 1080))
    put("bad.jpg", None)
    run = lambda **k: library.resolve_library(spark, f"file://{folder}", root, "lib", load, cfg=CFG, save_every=3, **k)
    people = lambda out: {r["photo_id"]: r["folder"] for r in out.folders.collect()}

    one = run(skip_video_frames=True)
    assert [(r["path"].rsplit("/", 1)[1], r["error"]) for r in one.failed.collect()] == [("bad.jpg", "ValueError: broken image")]
    assert sorted(people(one).values()) == ["aguardando_fase2", "person_001", "person_001_e_person_002", "person_002"]
    row = one.counts.first()
    assert (row["persons"], row["rare"], row["links"]) == (2, 0, 4) and {r["person_id"] for r in one.report.collect()} == {"person_001", "person_002"}
    two = run(phase2=True, skip_video_frames=True)
    assert "person_001_e_person_002" in people(two).values() and "aguardando_fase2" not in people(two).values() and two.version == 1

    put("bad.jpg", [(A, 81.0)], when=2000)
    put("b1.jpg", [(A, 82.0)], when=2000)  # another content under a known path is another photo
    three = run()
    assert three.failed.isEmpty() and library.Growing(spark, f"{root}/scanned", library.SCANNED).read().count() == 8
    named = people(three)
    assert len(named) == 7 and sum(f.startswith("person_001") for f in named.values()) == 5 and "pessoas_raras/person_003" in named.values()

    gone = run(exclude=[("a1.jpg", "a screen"), (str(folder / "wide.jpg"), "a poster")])
    assert len(people(gone)) == 5 and gone.counts.first()["persons"] == 2
    again = run(recluster=True)
    assert len(people(again)) == 5 and all("person_00" in f for f in people(again).values())
    other = library.resolve_library(spark, f"file://{folder}", root, "lib", load, embedder="second", cfg=CFG)
    assert library.Growing(spark, f"{root}/scanned", library.SCANNED).read().where("embedder = 'second'").count() == 7
    assert other.counts.first()["persons"] >= 2
