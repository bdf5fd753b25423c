"""Queries over whole tables against brute force: no row of a table is left out."""

import duckdb
import numpy as np
import pytest

from semblance.operators import cluster
from semblance.plans import queries as Q

SF = "/root/testdata/sf0.001"


def embeddings(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect())
    return [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)


def test_coherence_after_adding_scores_every_item(spark):
    items, label, v = embeddings(spark)
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(2))
    want = {}
    for p in set(label.tolist()):
        own = np.flatnonzero(label == p)
        inner, n = d[np.ix_(own, own)].sum() / 2, len(own)
        want |= {(items[i], p): (inner + d[i, own].sum()) / (n * (n + 1) / 2) for i in np.flatnonzero(label != p)}
    got = {(r["item"], r["label"]): r["coherence"] for r in Q.coherence_after_adding(spark, SF).collect()}
    assert got.keys() == want.keys() and len({i for i, _ in got}) == len(items)
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_tiles_give_the_same_sums(spark):
    f = Q._faces(spark, SF)
    one, many = ({(r["item"], r["person"]): r["t"] for r in cluster.sums_to_others(f, "item", "label", "v", tile).collect()} for tile in (4096, 64))
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)


def test_exclusion_counts_every_line(spark):
    gone = {r["o_orderkey"] for r in spark.read.parquet(f"{SF}/orders.parquet").where("o_custkey % 2 = 0").collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        if r["l_orderkey"] not in gone:
            want[r["l_suppkey"]] = want.get(r["l_suppkey"], 0) + 1
    assert {r["person_id"]: r["n_faces"] for r in Q.exclude_group(spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["incremental", "reclustered", "stream_sweep"])
def test_resolution_takes_every_face(spark, name):
    items = embeddings(spark)[0]
    sizes = {r["count"] for r in Q._detections(spark, SF).groupBy("photo_id").count().collect()}
    assert 2 in sizes and max(sizes) > 2
    want = {f"ph{i // 4}{'b' if i // 4 % 5 == 0 and i % 4 >= 2 else ''}:{i % 4}" for i in items}
    got = [r["face_id"] for r in Q.QUERIES[name](spark, SF).collect()]
    assert len(want) == len(items) == len(got) and set(got) == want


def test_pending_customers_have_no_order_at_all(spark):
    customers, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("customer", "orders"))
    want = {r["c_custkey"] for r in customers.collect()} - {r["o_custkey"] for r in orders.collect()}
    assert sorted(r["c_custkey"] for r in Q.anti_pending(spark, SF).collect()) == sorted(want)


@pytest.mark.parametrize("customers, orders, want", [
    (range(100), [(i, i % 90) for i in range(1600) if i % 90 != 7], [7, *range(90, 100)]),
    ([1, 1, 2, 3, 3, None], [(1, 2), (2, 2)], [1, 1, 3, 3]),
    ([1, 2, None], [(1, 2), (2, None)], []),
    ([1, None], [], [1, None]),
    ([], [(1, 2)], []),
])
def test_pending_customers_of_small_tables(spark, tmp_path, customers, orders, want):
    spark.createDataFrame([(c,) for c in customers], "c_custkey bigint").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    by_sql = [r[0] for r in con.execute(Q.ORACLE_SQL["anti_pending"]).fetchall()]
    got = [r["c_custkey"] for r in Q.anti_pending(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(by_sql, key=repr) == sorted(want, key=repr)
