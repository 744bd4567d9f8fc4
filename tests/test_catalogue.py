import pytest

from corvella.plans.catalogue import ORACLE_SQL, QUERIES

from .oracle import rows, sql_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLE_SQL:
        columns, want = sql_rows(small, ORACLE_SQL[name])
        assert sorted(got.columns) == columns
        assert rows(got) == want
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
