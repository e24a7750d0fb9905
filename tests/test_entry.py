"""The driver's functions."""

import __spark_entry__ as entry


def test_entry_and_oracles(spark):
    assert entry.entry(spark).count() == 12
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and sum(n.startswith("q") for n in queries) >= 36
    assert not [n for n in queries if n.startswith("q") and n not in sql]
