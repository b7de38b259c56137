import pytest
from compare import same_rows

from entityframe.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "spent", "n_orders"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
