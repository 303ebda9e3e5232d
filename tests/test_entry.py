"""The driver contract."""

import __spark_entry__


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and sorted(df.columns) == ["doc_id", "end_byte", "redacted_sha256", "rule", "start_byte"]


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
