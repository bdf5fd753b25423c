"""Places over several partitions, and tiles of several sizes, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.operators import cluster, relational


@pytest.fixture(params=["true", "false"])
def many_partitions(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_every_row_has_its_place(many_partitions, tmp_path):
    n = 100_000
    at = (F.col("id") * 7919) % n
    wide = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(F.col("id") * i))
    time = F.when(at % 3 != 0, F.timestamp_seconds(at / 40))  # a third is null, and others tie
    many_partitions.range(n).select("id", time.alias("time"), wide.alias("wide")).repartition(16).write.parquet(f"{tmp_path}/t")
    got = relational.chronological_blocks(many_partitions.read.parquet(f"{tmp_path}/t"), "time", "id", 4000)
    rows = [(r["id"], r["time"], r["pos"], r["block"]) for r in got.select("id", "time", "pos", "block", F.size("wide")).collect()]
    assert len(rows) == n
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[0]))
    assert [r[2] for r in want] == list(range(n)) and all(r[3] == r[2] // 4000 for r in rows)
    chunks = relational.fixed_chunks(got.select("id"), ["id"], 333).collect()
    assert len(chunks) == n and all(r["chunk"] == r["id"] // 333 for r in chunks)


def _rows(spark, n=240, dim=6, seed=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    # one person holds a third of the rows
    person = ["hot" if i % 3 == 0 else f"p{i % 7}" for i in range(n)]
    df = spark.createDataFrame([(i, p, x.tolist(), i // 4) for i, (p, x) in enumerate(zip(person, v, strict=True))], "item long, person string, v array<double>, photo long")
    return df, v, np.array(person), np.sqrt(np.maximum(((v[:, None] - v[None]) ** 2).sum(2), 0))


@pytest.mark.parametrize("tile", [16, 4096])
def test_tiles_equal_brute_force(spark, tile):
    df, v, person, d = _rows(spark)
    people = sorted(set(person))
    none = F.lit(None).cast("long").alias("photo")
    near = cluster.quorum_candidates(df.select("item", "v", none, F.lit(2).alias("keep")), df.select("item", "person", "v", none), 3, tile)
    got = {}
    for r in near.collect():
        got.setdefault(r["item"], []).append((r["score"], r["person"]))
    for i in range(len(v)):
        want = sorted((np.sort(d[i, (person == p) & (np.arange(len(v)) != i)])[:3].mean(), p) for p in people)
        assert sorted(got[i])[:2] == [(pytest.approx(s), p) for s, p in want[:2]]
    link = {(r["person_a"], r["person_b"]): r["distance"] for r in cluster.linkage(df, "person", "v", "item", tile).collect()}
    assert link == {(a, b): pytest.approx(d[np.ix_(person == a, person == b)].mean()) for a in people for b in people if a < b}
    same = {r["person"]: (r["n"], r["coherence"]) for r in cluster.coherence(df, "person", "item", "v", tile).collect()}
    for p in people:
        own = d[np.ix_(person == p, person == p)]
        n = len(own)
        assert same[p] == (n, pytest.approx(own.sum() / (n * (n - 1))))
    one = df.where("item = 1")
    assert cluster.coherence(one, "person", "item", "v").first()["coherence"] == 0 and cluster.linkage(one, "person", "v", "item").count() == 0
    assert cluster.coherence(df.limit(0), "person", "item", "v").count() == 0


def test_loose_items_keep_out_of_their_photos(spark):
    df, v, person, d = _rows(spark)
    members = df.where("item % 4 < 2").select("item", F.col("person").alias("identity"))
    got = {r["item"]: r["identity"] for r in cluster.level3(df.withColumnRenamed("person", "_p"), members, "item", "v", "photo", 2.0, 3).collect()}
    bank = np.arange(len(v)) % 4 < 2
    for i in np.flatnonzero(~bank).tolist():
        taken = {person[j] for j in range(i // 4 * 4, i // 4 * 4 + 4) if bank[j]} | {got[j] for j in range(i // 4 * 4, i) if not bank[j] and j in got}
        score = sorted((np.sort(d[i, bank & (person == p)])[:3].mean(), p) for p in sorted(set(person)) if p not in taken)
        assert got.get(i) == (score[0][1] if score and score[0][0] <= 2.0 else None)
