def test_every_oracle_is_sql():
    import __spark_entry__ as entry

    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())
