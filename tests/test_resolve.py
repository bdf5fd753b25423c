"""Resolution by components equals one run over everything."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from semblance.config import ResolveConfig
from semblance.operators import kernels
from semblance.plans import resolve as R
from semblance.sources.tables import STATE


def whole(known, new, cfg, phase, sequence):
    """One kernel over all faces; known and new: pandas."""
    crowd = new.groupby("photo_id")["face_id"].transform("count") >= 3
    waiting = new[crowd] if phase == 1 else new.iloc[:0]
    rows, made = R.decided(new.drop(waiting.index), known, cfg, phase, "~")
    name = {f"~{i:03d}": f"person_{sequence + i:03d}" for i in range(1, len(made) + 1)}
    assert {m[0] for m in made} == set(name)
    out = {r["face_id"]: (name.get(r["person_id"], r["person_id"]), r["confidence"], r["status"]) for r in rows}
    out |= {k: (None, None, "deferred") for k in waiting["face_id"]}
    held = pd.DataFrame([r | {"person_id": out[r["face_id"]][0]} for r in rows if r["status"] == "assigned"])
    to = R.merged(held, cfg) if len(held) else {}
    return {k: (to.get(p, p), c, s) for k, (p, c, s) in out.items()}, sequence + len(made)


def detections(spark, rng, n, dim=5, spread=0.5):
    centres = rng.normal(size=(6, dim))
    rows, photo = [], 0
    while len(rows) < n:
        photo += 1
        for i in range(int(rng.choice([1, 2, 2, 3, 4]))):
            v = centres[rng.integers(6)] + spread * rng.normal(size=dim)
            rows.append((f"ph{photo}", f"/lib/{int(rng.integers(1000)):04d}-{photo}.jpg" if i == 0 else rows[-1][1], 1.0, i, (v / np.linalg.norm(v)).tolist(), 80.0, 0.9))
    return spark.createDataFrame(rows, "photo_id string, path string, mtime double, face_index int, embedding array<double>, face_px double, det_score double")


@pytest.mark.parametrize("seed, match, uncertain, coherence", [(1, 0.35, 0.5, 0.5), (2, 0.5, 0.55, 0.45)])
def test_components_decide_as_one_run(spark, monkeypatch, seed, match, uncertain, coherence):
    monkeypatch.setattr(R, "BUCKET", 30)
    cfg = ResolveConfig(match=match, uncertain=uncertain, coherence=coherence)
    found = detections(spark, np.random.default_rng(seed), 60).cache()
    photos = sorted({r["photo_id"] for r in found.collect()}, key=lambda p: int(p[2:]))
    state = {n: spark.createDataFrame([], s) for n, s in STATE.items()}
    kinds = set()
    for part, phase in ((photos[: len(photos) // 2], 1), (photos[: len(photos) // 2], 2), (photos, 1), (photos, 2)):
        batch = found.where(F.col("photo_id").isin(part))
        known = state["faces"].toPandas()
        status = {r["photo_id"]: r["status"] for r in state["photos"].collect()}
        new = batch.withColumn("face_id", F.concat_ws(":", "photo_id", F.col("face_index").cast("string"))).toPandas()
        done = new["photo_id"].map(status)
        new = new[done == "deferred_multi_face"] if phase == 2 else new[~done.isin(["phase1_done", "phase2_done", "deferred_multi_face"])]
        want, last = whole(known, new, cfg, phase, R.sequence_of(state))
        state = R.resolve(state, batch, cfg, phase)
        got = {r["face_id"]: (r["person_id"], r["confidence"], r["status"]) for r in state["faces"].collect()}
        assert got.keys() == want.keys() and R.sequence_of(state) == last
        for k in want:
            assert got[k][0] == want[k][0] and got[k][2] == want[k][2], (phase, k, got[k], want[k])
            assert got[k][1] == (None if want[k][1] is None or want[k][1] != want[k][1] else pytest.approx(want[k][1])) or got[k][1] != got[k][1]
            kinds.add(got[k][2])
    assert {"assigned", "uncertain"} <= kinds


def test_forests_connect_what_pairs_connect():
    rng = np.random.default_rng(0)
    for n, m, p in ((1, 1, 1.0), (30, 40, 0.03), (50, 20, 0.2), (5, 5, 0.0)):
        near = rng.random((n, m)) < p
        at, to = kernels.spanning_forest(near)
        assert near[at, to].all() and len(at) <= n + m

        def labels(edges, n=n, m=m):
            of = list(range(n + m))
            for a, b in edges:
                x, y = of[a], of[n + b]
                of = [x if z == y else z for z in of]
            return [of.index(x) for x in of]

        assert labels(zip(*np.nonzero(near), strict=True)) == labels(zip(at, to, strict=True))
