"""Every query with SQL gives the rows that DuckDB gives."""

import pandas as pd
import pytest

from curata.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    got, want = q.QUERIES[name](spark, sf).toPandas(), duck.sql(q.ORACLE_SQL[name]).df()
    assert set(got.columns) == set(want.columns)
    keys = list(got.columns)
    got, want = (x[keys].sort_values(keys).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-12, atol=0)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
