"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
