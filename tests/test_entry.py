import __spark_entry__ as entry


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    df = entry.entry(spark)
    assert df.count() > 0 and "c0" in df.columns
