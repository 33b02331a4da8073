"""The driver's contract."""

import __spark_entry__ as entry


def test_names_match():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert {"match_summary_compat", "exact_hits", "compare_runs"} <= set(sql)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["pattern_id", "text_id"] and df.count() > 0
