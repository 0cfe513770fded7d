"""The driver's entry points."""

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
