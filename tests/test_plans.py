"""Entry points on small tables: recovery of known people, blocks, state changes, streams, readers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.config import RankConfig, ResolveConfig
from semblance.functions import scalars as S
from semblance.operators import blocklist, cluster, kernels, relational
from semblance.plans import rank, resolve
from semblance.sources import tables as T
from semblance.sources.state import Snapshots
from semblance.streaming import ingest


def people(seed=0, dim=128, sizes=(60, 40, 30, 25, 20), singles=60):
    """Items of known people, a look-alike pair that shares photos, and singles with photos of their own."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    c = unit(rng.normal(size=(len(sizes), dim)))
    ortho = unit(c[1] - (c[1] @ c[0]) * c[0])
    c[1] = 0.70 * c[0] + np.sqrt(1 - 0.49) * ortho
    rows = []
    for p, n in enumerate(sizes):
        for k in range(n):
            photo = f"both{k}" if p < 2 and k < 12 else f"ph{p}_{k}"
            rows.append((p, photo, unit(c[p] + 0.75 * unit(rng.normal(size=dim)))))
    rows += [(-1, f"single{i}", unit(rng.normal(size=dim))) for i in range(singles)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[j][0], rows[j][1], rows[j][2].tolist()) for i, j in enumerate(order)]


def test_ranking_recovers_the_people(spark):
    data = people()
    faces = spark.createDataFrame([(i, v, ph, 0, ph, 0.9, 80.0, i) for i, _, ph, v in data], "item long, vector array<double>, photo_id string, face_index int, uid string, det_score double, face_px double, t long")
    faces = faces.withColumn("capture_time", F.timestamp_seconds("t")).withColumn("face_index", F.col("item").cast("int"))
    found = rank.identities(faces.select("item", "vector", F.col("photo_id").alias("photo"), F.col("capture_time").alias("time")), RankConfig(block=90))
    truth = {i: p for i, p, _, _ in data}
    by = {}
    for r in found.collect():
        by.setdefault(r["identity"], []).append(truth[r["item"]])
    big = [m for m in by.values() if len(m) > 5]
    assert len(big) == 5 and all(len(set(m)) == 1 for m in big)
    assert sorted(len(m) for m in big) == [20, 25, 30, 40, 60]
    top = rank.rank_entities(faces, RankConfig(block=90, top=3)).collect()
    assert [r["n_faces"] for r in top] == [60, 40, 30] and [r["pessoa"] for r in top] == ["pessoa_01", "pessoa_02", "pessoa_03"]
    own = [r for r in data if r[1] == 2]
    profile = spark.createDataFrame([("k1", "ignorar", None, None, v, ph, i) for i, _, ph, v in own[:15]], "chave string, nivel string, nome string, motivo string, v array<double>, photo_id string, idx int")
    assert [r["n_faces"] for r in rank.rank_entities(faces, RankConfig(block=90, top=3), profile).collect()] == [60, 40, 25]
    stamped = rank.rank_entities(faces, RankConfig(block=90, top=3), profile.withColumn("nivel", F.lit("sem-album"))).collect()
    assert [r["bloqueio"] is not None for r in stamped] == [False, False, True]


def test_components_cluster_like_the_whole(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"), F.expr("cast(vec_id div 4 as string)").alias("photo"))
    rows = sorted(e.collect(), key=lambda r: r["item"])
    for t in (1.1, 1.2):
        labels = kernels.cluster(np.array([r["v"] for r in rows]), t, [r["photo"] for r in rows])
        first = {}
        want = {r["item"]: first.setdefault(k, r["item"]) for r, k in zip(rows, labels.tolist(), strict=True)}
        assert {r["item"]: r["representative"] for r in cluster.constrained_clusters(e, "item", "v", "photo", t).collect()} == want


def test_third_level_takes_one_item_a_photo(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "b"), (3, [1.0, 0.05], "c"), (4, [1.0, 0.06], "c"), (5, [0.0, 9.0], "d"), (6, [1.0, 0.0], "a")], "item long, v array<double>, photo string")
    members = spark.createDataFrame([(1, 1), (2, 1)], "item long, identity long")
    out = {r["item"]: r["identity"] for r in cluster.level3(items, members, "item", "v", "photo", 0.5, 3).collect()}
    assert out == {1: 1, 2: 1, 3: 1}


def detections(spark, rows):
    return spark.createDataFrame([(p, f"/{p}.jpg", 1.0, i, v, 80.0, s) for p, i, v, s in rows], ingest.DETECTION)


def empty(spark):
    return {n: spark.createDataFrame([], s) for n, s in T.STATE.items()}


A, B, C = [1.0, 0.0], [0.0, 5.0], [1.1, 0.0]


def test_resolving_twice_changes_nothing(spark):
    found = detections(spark, [("p1", 0, A, 0.9), ("p2", 0, C, 0.9), ("p2", 1, B, 0.9), ("p3", 0, A, 0.9), ("p3", 1, B, 0.9), ("p3", 2, [9.0, 9.0], 0.9), ("p4", 0, A, 0.1)])
    one = resolve.resolve(empty(spark), found)
    got = {r["face_id"]: (r["person_id"], r["status"]) for r in one["faces"].collect()}
    assert got["p1:0"] == got["p2:0"] == ("person_001", "assigned") and got["p2:1"] == ("person_002", "assigned")
    assert got["p3:0"] == (None, "deferred") and "p4:0" not in got
    again = resolve.resolve(one, found)
    assert {r["face_id"]: (r["person_id"], r["status"]) for r in again["faces"].collect()} == got
    two = resolve.resolve(one, found, phase=2)
    late = {r["face_id"]: (r["person_id"], r["status"]) for r in two["faces"].collect()}
    assert late["p3:0"][0] == "person_001" and late["p3:1"][0] == "person_002" and late["p3:2"] == (None, "uncertain")
    assert {tuple(r) for r in two["edges"].collect()} == {("person_001", "person_002", "p2"), ("person_001", "person_002", "p3")}
    gone = resolve.with_views(relational.exclude_photos(two, spark.createDataFrame([("p2", "x")], T.EXCLUDED)))
    assert gone["photos"].where("photo_id = 'p2'").first()["status"] == "excluded"
    assert resolve.resolve(gone, found)["faces"].where("photo_id = 'p2'").isEmpty()
    assert resolve.reset(gone)["faces"].isEmpty() and resolve.reset(gone)["photos"].where("status = 'pending'").count() == 2
    assert resolve.guard_model(resolve.guard_model(two, "m1"), "m2")["faces"].isEmpty()
    views = {r["photo_id"]: r["folder"] for r in resolve.folder_view(two, 0.5, 2).collect()}
    assert views["p1"] == "person_001" and views["p2"] == "person_001_e_person_002"


def test_recluster_names_the_largest_first(spark):
    found = detections(spark, [("q1", 0, B, 0.9), ("q2", 0, A, 0.9), ("q3", 0, C, 0.9)])
    out = resolve.recluster(resolve.resolve(empty(spark), found, ResolveConfig()))
    got = {r["face_id"]: r["person_id"] for r in out["faces"].collect()}
    assert got == {"q2:0": "person_001", "q3:0": "person_001", "q1:0": "person_002"}
    assert resolve.sequence_of(out) == 2


def test_sweep_takes_each_file_once(spark, tmp_path):
    src, root = f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    detections(spark, [("p1", 0, A, 0.9)]).coalesce(1).write.parquet(src)
    assert ingest.sweep(spark, src, root) == 0
    detections(spark, [("p1", 0, A, 0.9), ("p2", 0, C, 0.9)]).coalesce(1).write.mode("append").parquet(src)
    assert ingest.sweep(spark, src, root, ResolveConfig(recluster_every=2)) == 1
    assert {r["face_id"]: r["person_id"] for r in Snapshots(spark, f"{root}/state").read()["faces"].collect()} == {"p1:0": "person_001", "p2:0": "person_001"}
    assert ingest.sweep(spark, src, root) == 1


def test_scan_leaves_failures_for_later(spark, tmp_path):
    catalog = spark.createDataFrame([("u1", 0), ("u2", 0), ("u3", 1)], "uid string, batch long")
    fail = {"u2"}

    def extract(entries):
        bad = F.col("uid").isin(*fail) if fail else F.lit(False)
        return entries.select("uid", F.concat(F.lit("ph"), "uid").alias("photo_id"), F.when(F.col("uid") != "u3", 0).alias("face_index"), F.when(bad, "broken").alias("error"))

    root = f"file://{tmp_path}/scan"
    log = ingest.scan(spark, catalog, root, extract)
    assert {(r["uid"], r["faces"]) for r in log.collect()} == {("u1", 1), ("u3", 0)}
    fail.clear()
    assert {r["uid"] for r in ingest.scan(spark, catalog, root, extract).collect()} == {"u1", "u2", "u3"}


def test_readers(spark, tmp_path):
    assert T.read_or_empty(spark, f"{tmp_path}/none", T.CATALOG).count() == 0
    doc = {"pessoas": [{"pessoa": "pessoa_01", "id": "abc", "rostos": 3, "fotos": 2, "primeiro": None, "ultimo": "2024", "uids": ["u"], "faces": ["p:0"]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    (tmp_path / "l.json").write_text(json.dumps(doc["pessoas"]))
    for f in ("r.json", "l.json"):
        r = T.read_ranking(spark, f"{tmp_path}/{f}")
        assert {x["name"] for x in T.by_name_or_id(r).collect()} == {"pessoa_01", "abc"} and r.first()["primeiro"] is None
    (tmp_path / "pics").mkdir()
    for n in ("a.JPG", "Screenshot_1.jpg", "b.png"):
        (tmp_path / "pics" / n).write_bytes(b"x")
    assert [r["name"] for r in T.find_files(spark, f"{tmp_path}/pics", S.PHOTO_EXTENSIONS).select("name").collect()] == ["a.JPG"]
    (tmp_path / "u.txt").write_text("u1\n\n u2 \n")
    assert [r["uid"] for r in T.lines(spark, f"{tmp_path}/u.txt").collect()] == ["u1", "u2"]


def test_profiles(spark):
    ranking = spark.createDataFrame([("pessoa_01", "id1", ["p1:0", "p2:0", "gone:0"]), ("pessoa_02", "id2", ["gone:1"])], "pessoa string, id string, faces array<string>")
    store = spark.createDataFrame([("p1", 0, "t1"), ("p2", 0, None)], "photo_id string, face_index int, thumb string")
    got = blocklist.snapshot(ranking, store, ["pessoa_01", "pessoa_02"], "ignorar").collect()
    assert [(r["chave"], r["faces"], r["thumbs"]) for r in got] == [("id1", ["p1:0", "p2:0"], ["t1"])]
    with pytest.raises(ValueError):
        blocklist.snapshot(ranking, store, ["pessoa_01", "pessoa_02"], "ignorar", custom_name="x")
    mine = spark.createDataFrame([("me", [1.0, 0.0], "p1", 0)], "identity string, v array<double>, photo_id string, idx int")
    own = mine.withColumnRenamed("identity", "chave")
    assert blocklist.classified(mine, own, 2, 1.1).first()["chave"] == "me"  # a blocked person against itself
    near = spark.createDataFrame([("other", [1.0, 0.1], "p1", 1)], mine.schema)
    assert blocklist.classified(near, own, 2, 1.1).first()["chave"] is None  # it shares a photo with the profile


def test_equal_photo_sets_give_equal_ids(spark):
    f = spark.createDataFrame([("a", "u1", 1), ("b", "u1", 2)], "person string, uid string, t int")
    s = relational.summaries(f, "person", "uid", "t").collect()
    assert s[0]["stable_id"] == s[1]["stable_id"]


def test_keep_first_keeps_rows_without_a_key(spark):
    f = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, ""), (6, "")], "id int, h string")
    assert sorted(r["id"] for r in relational.keep_first(f, "h", ["id"]).collect()) == [1, 3, 4, 5, 6]
