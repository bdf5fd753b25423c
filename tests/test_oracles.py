"""Every query with SQL gives the rows of that SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from semblance.plans import all_queries as core

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5) + 0.0
        return str(x) if x is not None and not isinstance(x, (int, bool)) else x

    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_rows_equal_the_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = core.QUERIES[name](spark, SF)
    want = con.execute(core.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_entry_runs_and_answers_belong_to_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
