"""The driver's contract."""

import __spark_entry__ as entry_point


def test_names_and_sql():
    names = entry_point.queries()
    assert set(entry_point.oracle_sql()) <= set(names) and all(map(callable, names.values()))


def test_entry_has_rows(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["query_id", "doc_id", "bm25_score", "rank"] and df.count() > 0
