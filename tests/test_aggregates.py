"""States of vectors against the aggregates over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.functions import vectors as V
from semblance.operators import aggregates, cluster


def faces(spark, n=200, dim=5):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(n, dim)) + np.repeat(rng.normal(size=(8, dim)) * 2, n // 8, axis=0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, None if i % 50 == 7 else f"p{i // 25}", x.tolist()) for i, x in enumerate(v)] + [(n, "alone", v[0].tolist())], "item long, person string, v array<double>")


@pytest.mark.parametrize("at_once", [7, 8192])
def test_batches_add_up(spark, at_once):
    df = faces(spark)
    states, old = aggregates.no_states(df, "person"), df.limit(0)
    for k in range(3):
        new = df.where(F.col("item") % 3 == k)
        states = aggregates.with_pairs(states, old, new, 5, at_once)
        old = old.unionByName(new)
    want = {r["person"]: r for r in cluster.coherence(df, "person", "item", "v").join(df.groupBy("person").agg(V.centroid("v", 5).alias("c")), "person").collect()}
    got = states.select("person", "n", aggregates.centroid().alias("c"), V.coherence_from_sums(F.col("pair_sum"), F.col("n")).alias("coherence"), aggregates.bounds()[0].alias("low"), aggregates.bounds()[1].alias("high")).collect()
    assert {r["person"] for r in got} == set(want) and len(want) == 9
    for r in got:
        w = want[r["person"]]
        assert r["n"] == w["n"] and r["c"] == pytest.approx(w["c"]) and r["coherence"] == pytest.approx(w["coherence"])
        assert r["low"] <= r["coherence"] + 1e-9 and r["coherence"] <= r["high"] + 1e-9


def test_moments_add_up_and_decide(spark):
    df = faces(spark)
    whole = {r["person"]: r for r in aggregates.moments(df, "person", "v", 5).collect()}
    parts = aggregates.added(*(aggregates.moments(df.where(F.col("item") % 2 == k), "person", "v", 5) for k in (0, 1)))
    for r in parts.collect():
        assert r["n"] == whole[r["person"]]["n"] and r["total"] == pytest.approx(whole[r["person"]]["total"]) and r["squares"] == pytest.approx(whole[r["person"]]["squares"])
    exact = {r["person"]: r["coherence"] for r in cluster.coherence(df, "person", "item", "v").collect()}
    for limit in (0.1, 0.5, 0.8, 1.2, 2.0):
        assert {r["person"] for r in aggregates.diffuse(df, "person", "item", "v", 5, limit).collect()} == {p for p, c in exact.items() if c > limit}
    assert aggregates.diffuse(df.limit(0), "person", "item", "v", 5, 0.5).count() == 0
