import __spark_entry__ as entry


def test_entry_and_registry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).columns == ["id", "kind", "day", "name"]
