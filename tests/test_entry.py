import __spark_entry__ as entry_point


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries()) and len(entry_point.queries()) > 40


def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert df.columns and df.count() >= 0
