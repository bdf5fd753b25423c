"""What joins within a distance send and keep."""

import pytest
from pyspark.sql import functions as F

from semblance.operators import cluster, metric
from semblance.plans import all_queries as core


def test_tiles_grow_with_the_table(spark):
    rows = spark.range(40_000).select(F.col("id").alias("item"), F.array(F.rand(1).cast("float").cast("double"), F.rand(2).cast("float").cast("double")).alias("v"))
    celled, tiles = metric.dealt(rows, 3.0)
    assert tiles <= 2 * metric.TILES and dict(celled.dtypes)["v"] == "array<float>"
    precise, _ = metric.dealt(rows.withColumn("v", F.transform("v", lambda x: x / 3)), 3.0)
    assert dict(precise.dtypes)["v"] == "array<double>"


@pytest.mark.parametrize("name", ["cluster_components", "components_of_pairs"])
def test_components_need_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(cluster, "pairs_within", None)
    assert core.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_quorum_tiles_grow_with_the_tables(spark, monkeypatch):
    assert cluster._quorum_tile(2000, 500) == cluster.TILE and -(-600_000 // cluster._quorum_tile(600_000, 90_000)) < 20
    rows = spark.range(300).select(F.col("id").alias("item"), F.array(F.rand(1), F.rand(2)).alias("v"), (F.col("id") % 7).alias("person"))
    single = rows.withColumn("v", F.transform("v", lambda x: x.cast("float").cast("double"))).localCheckpoint()
    for df in (rows.localCheckpoint(), single):
        want = {(r["item"], r["person"], round(r["score"], 9)) for r in cluster.quorum_best(df.select("item", "v"), df.select("item", "person", "v"), 3).collect()}
        monkeypatch.setattr(cluster, "STRIP", 40)
        monkeypatch.setattr(cluster, "_quorum_tile", lambda *n: 50)
        assert want == {(r["item"], r["person"], round(r["score"], 9)) for r in cluster.quorum_best(df.select("item", "v"), df.select("item", "person", "v"), 3).collect()}
        monkeypatch.undo()
