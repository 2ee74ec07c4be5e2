import __spark_entry__ as E


def test_contract_shapes():
    q, s = E.queries(), E.oracle_sql()
    assert len(q) >= 100
    assert set(s) <= set(q)
    assert all(callable(f) for f in q.values())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "antecedent" in df.columns and "lift" in df.columns
