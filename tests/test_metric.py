"""The metric index, merging in rounds, reconciliation and the plan of batches against plain forms; kernels on empty sides."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from semblance.functions import vectors as V
from semblance.operators import blocklist, cluster, kernels, metric, rounds

ITEMS = "item {kind}, person {kind}, photo string, v array<double>"


def table(spark, kind, rows):
    name = (lambda x: None if x is None else int(x)) if kind == "long" else (lambda x: None if x is None else f"k{int(x):04d}")
    return spark.createDataFrame([(name(i), name(p), g, [float(x) for x in v]) for i, p, g, v in rows], ITEMS.format(kind=kind)).repartition(3)


def clustered(n, seed=0, dim=6, centres=12, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    v = c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_pairs(v, t):
    return {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if np.linalg.norm(v[i] - v[j]) <= t}


def joined(pairs, n):
    of = list(range(n))
    for a, b in pairs:
        x, y = of[a], of[b]
        of = [min(x, y) if z in (x, y) else z for z in of]
    return of


@pytest.mark.parametrize("seed, spread, t, block, most", [(1, 0.05, 0.3, 40, 2048), (2, 0.3, 0.25, 30, 2048), (3, 3.0, 0.4, 25, 2048), (4, 0.05, 0.3, 10, 3), (5, 0.0, 0.0, 20, 2048)])
def test_pairs_and_links_through_the_index(spark, monkeypatch, seed, spread, t, block, most):
    monkeypatch.setattr(metric, "ROWS", 5)
    monkeypatch.setattr(metric, "PIVOTS", most)
    v = clustered(300, seed, spread=spread)
    df = table(spark, "long", [(i, 0, "g", x) for i, x in enumerate(v)])
    want = near_pairs(v, t)
    got = {(r["a"], r["b"]) for r in cluster.pairs_within(df, "item", "v", t, block).collect()}
    # a distance of a rounding error from the limit may go either way
    assert all(abs(np.linalg.norm(v[a] - v[b]) - t) < 1e-7 for a, b in got ^ want) if t else got == want
    links = [(r["a"], r["b"]) for r in cluster.links_within(df, "item", "v", t, block).collect()]
    assert joined(links, 300) == joined(want, 300)
    half = df.where("item % 3 = 0"), df.where("item % 3 > 0")
    across = [(r["a"], r["b"]) for r in cluster.links_between(*half, "item", "v", t, rows=40).collect()]
    assert all(a % 3 == 0 and b % 3 for a, b in across) and joined(across, 300) == joined([p for p in want if (p[0] % 3 == 0) != (p[1] % 3 == 0)], 300)


def test_clustered_vectors_skip_most_tiles(spark):
    v = clustered(6000, 7, dim=16, centres=60, spread=0.03)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item long, v array<double>")
    celled, tiles = metric.dealt(rows, 0.2, 200)
    assert tiles >= 30 and metric.skipped(celled, tiles) > 0.8
    every, n = metric.dealt(rows, 3.0, 200)
    assert metric.skipped(every, n) == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_kernels_on_empty_sides_and_tiles(spark, kind):
    few = [(1, 7, "a", [1.0, 0.0]), (2, 7, "b", [0.0, 1.0]), (3, 8, "c", [0.6, 0.8])]
    for rows in ([], few):
        df = table(spark, kind, rows)
        n = len(rows)
        assert cluster.pairs_within(df, "item", "v", 9.0, 1).count() == n * (n - 1) // 2
        assert cluster.links_within(df, "item", "v", 0.1, 1).count() == 0 and cluster.constrained_clusters(df, "item", "v", "photo", 0.1).count() == n
        assert cluster.links_between(df, df.limit(0), "item", "v", 1.0).count() == 0 == cluster.links_between(df.limit(0), df, "item", "v", 1.0).count()
        assert cluster.linkage(df, "person", "v", "item", 1).count() == (1 if n == 3 else 0)
        assert cluster.sums_to_others(df, "item", "person", "v", 1).count() == (3 if n == 3 else 0)
        assert cluster.coherence(df, "person", "item", "v", 1).count() == len({r[1] for r in rows})
        assert cluster.rms_between(df, "person", "v", 2).count() == (1 if n == 3 else 0)
        bank = df.select("item", "person", "v")
        for items, banks in ((df, bank), (df, bank.limit(0)), (df.limit(0), bank)):
            assert cluster.quorum_best(items.select("item", "v"), banks, 2).count() == (n if n > 1 and items is df and banks is bank else 0)
        mine = df.select(F.col("person").alias("identity"), "v", F.col("photo").alias("photo_id"), F.lit(0).alias("idx"))
        theirs = mine.withColumnRenamed("identity", "chave")
        for left, right in ((mine, theirs), (mine, theirs.limit(0)), (mine.limit(0), theirs)):
            full = left is mine and right is theirs and n
            assert blocklist.classified(left, right, 2, 1.0).count() == (len({r[1] for r in rows}) if full else 0)
            assert (blocklist.checked(left, right, 2, 1.0).count() > 0) == bool(full)
        first = cluster.level1(df.withColumn("t", F.lit(None).cast("long")), "item", "v", "photo", "t", 2, 0.1)
        assert cluster.level2(df, first, "item", "v", "photo", 0.1).count() == 0
        assert cluster.level3(df, first.select("item", F.col("representative").alias("identity")).limit(0), "item", "v", "photo", 1.0, 2).count() == 0


def test_limits_leave_the_nearest_of_each_row(spark):
    rng = np.random.default_rng(3)
    side = lambda name, n: [(f"{name}{i}", (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(n, 4)))]
    left, right = side("l", 30), side("r", 25)
    ld, rd = spark.createDataFrame(left, "a string, c array<double>"), spark.createDataFrame(right, "b string, c array<double>")
    whole = {(r["a"], r["b"]): r["rms"] for r in cluster.centroid_distances(ld, rd, "a", "b", 7).collect()}
    cut = {(r["a"], r["b"]): r["rms"] for r in cluster.centroid_distances(ld, rd, "a", "b", 7, 0.6).collect()}
    assert len(whole) == 750 and len(cut) < 300 and {k for k, d in whole.items() if d <= 0.6} <= cut.keys() and cut.items() <= whole.items()
    assert all(min(d for (x, _), d in cut.items() if x == a) == min(d for (x, _), d in whole.items() if x == a) for a, _ in left)


@pytest.mark.parametrize("kind, seed, tile, limit, grid", [("string", 0, 16, 10, False), ("long", 1, 8, 0, False), ("long", 2, 64, 40, True), ("string", 3, 6, 3, True)])
def test_rounds_merge_as_the_kernel(spark, kind, seed, tile, limit, grid):
    rng = np.random.default_rng(seed)
    n = 100
    v = rng.integers(0, 5, size=(n, 2)).astype(float) if grid else clustered(n, seed, dim=3, centres=5, spread=0.4)
    photos = [f"p{rng.integers(60)}" if rng.random() < 0.7 else None for _ in range(n)]
    df = table(spark, kind, [(i, 0, g, x) for i, (g, x) in enumerate(zip(photos, v, strict=True))])
    threshold = 1.2 if grid else 0.5
    labels = kernels.cluster(v, threshold, [g or f"alone{i}" for i, g in enumerate(photos)])
    first = {}
    want = {i: first.setdefault(k, i) for i, k in enumerate(labels.tolist())}
    rows = df.select(F.lit("c").alias("component"), "item", "v", F.col("photo").alias("g"))
    read = (lambda x: x) if kind == "long" else (lambda x: int(x[1:]))
    got = {read(r["item"]): read(r["representative"]) for r in rounds.merged(rows, threshold, limit, tile).collect()}
    assert got == want
    if not seed:
        whole = {read(r["item"]): read(r["representative"]) for r in cluster.constrained_clusters(df.withColumn("photo", F.coalesce("photo", F.col("item").cast("string"))), "item", "v", "photo", threshold, limit=20, tile=tile).collect()}
        assert whole == want


def slow_reconcile(people, threshold, coherence, exclusion):
    """Merges the closest pair of people whose union is coherent, until there is none."""
    people, merged = dict(people), {}
    while True:
        options = []
        for a, b in itertools.combinations(sorted(people), 2):
            (ka, va), (kb, vb) = people[a], people[b]
            d = float(np.mean([[np.linalg.norm(x - y) for y in vb] for x in va]))
            shared = {k.split(":")[0] for k in ka} & {k.split(":")[0] for k in kb}
            if d <= threshold and kernels.mean_pairwise(np.array(va + vb)) <= coherence and not (exclusion and shared):
                options.append((d, a, b))
        if not options:
            return merged, people
        _, a, b = min(options)
        people[a] = (people[a][0] + people[b][0], people[a][1] + people[b][1])
        del people[b]
        merged[b] = a


@pytest.mark.parametrize("seed", range(6))
def test_reconcile_equals_the_slow_form(seed):
    rng = np.random.default_rng(seed)
    v = clustered(40, seed, dim=3, centres=5, spread=0.5)
    owner = rng.integers(0, 14, 40)
    people = {f"person_{o:03d}": ([f"ph{i % 17}:{i}" for i in np.flatnonzero(owner == o)], [v[i] for i in np.flatnonzero(owner == o)]) for o in np.unique(owner)}
    for exclusion in (False, True):
        g = kernels.Graph()
        g.people = {n: kernels.Person.of(*p) for n, p in people.items()}
        want, left = slow_reconcile(people, 0.8, 0.7, exclusion)
        assert g.reconcile(0.8, 0.7, exclusion) == want
        assert {n: p.keys for n, p in g.people.items()} == {n: p[0] for n, p in left.items()}
        for p in g.people.values():
            assert p.coherence() == pytest.approx(kernels.mean_pairwise(np.array(p.vectors)))


def test_many_people_are_reconciled_in_seconds():
    import time

    v = clustered(2000, 1, dim=8, centres=200, spread=0.2)
    g = kernels.Graph()
    g.people = {f"person_{i:04d}": kernels.Person.of([f"p{i}:0", f"q{i}:0"], [v[i], v[i] + 0.001]) for i in range(2000)}
    began = time.time()
    assert len(g.reconcile(0.6, 0.9)) > 500
    assert time.time() - began < 30


@pytest.mark.parametrize("n, names, max_items, max_bytes, block, group", [(0, 3, 5, 50, 10, 2), (1, 1, 5, 50, 10, 2), (400, 25, 7, 60, 10, 3), (397, 6, 50, 200, 50, 100), (121, 300, 11, 40, 11, 1), (45, 9000, 20, 1e9, 20, 2)])
def test_plan_of_batches_equals_the_fold(spark, n, names, max_items, max_bytes, block, group):
    rng = np.random.default_rng(n)
    rows = [(i, None if rng.random() < 0.02 else f"n{rng.integers(names)}", int(rng.integers(0, 30)) if rng.random() > 0.03 else 500, "x") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, name string, size long, batch_of string").repartition(3)
    got = {r["id"]: r["batch"] for r in cluster.planned_batches(df, ["id"], "name", "size", max_bytes, max_items, block, group).collect()}
    assert got == dict(enumerate(kernels.plan_batches([r[1] for r in rows], [r[2] for r in rows], max_bytes, max_items)))
