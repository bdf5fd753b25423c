"""Rows at which a query and its SQL once differed, in small tables of their own."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from semblance.functions import scalars as S
from semblance.plans import all_queries as core


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables given as SQL of DuckDB."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(core.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    return sorted(tuple(r) for r in core.QUERIES[name](spark, str(folder)).select(columns).collect()), sorted(want.fetchall())


def test_folder_names_sort_with_their_marks(spark, tmp_path):
    lines = "SELECT p // 8 AS l_orderkey, [10, 101, 1, 100, 20, 205, 2, 200][p % 8 + 1] AS l_suppkey, p % 8 AS l_linenumber, 'A' AS l_returnflag FROM range(32) t(p)"
    got, want = both(spark, tmp_path, "folder_view", lineitem=lines, supplier="SELECT range AS s_suppkey FROM range(300)")
    assert got == want and "101_e_10_dispersa" in got[0][1]


def test_sizes_round_ties_to_even(spark, tmp_path):
    prices = [49152.0, 81920.0, 114688.0, 1536.0, 16384.0, 1.5, 31.99, 0.5, 0.0, 999.95, 2.0, 1024.0, 40000.01]
    got, want = both(spark, tmp_path, "human_size", orders=f"SELECT unnest(range({len(prices)})) AS o_orderkey, unnest({prices}::DOUBLE[]) AS o_totalprice")
    assert got == want and got[0][1] == "2.2 GB" and got[3][1] == "2.2 MB"


def test_one_decimal_is_exact(spark):
    rng = np.random.default_rng(4)
    x = [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95, 1.15, 1023.95, 0.0, -0.04, -2.25, 0.9999999999999999, 2.0**51 + 0.75, 1e16, *(rng.integers(0, 10**6, 500) / 100), *(rng.random(500) * 10.0 ** rng.integers(-3, 12, 500)), *(rng.integers(0, 4096, 200) / 4)]
    x = [float(v) for v in x]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert [r["t"] for r in df.select(S.one_decimal(F.col("x")).alias("t")).collect()] == [f"{v:.1f}" for v in x]
    assert [r["t"] for r in spark.createDataFrame([(None,)], "x double").select(S.human_size(F.col("x")).alias("t")).collect()] == [None]
