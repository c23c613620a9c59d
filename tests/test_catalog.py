"""Every query against its SQL, and the entry point."""

from __future__ import annotations

import pytest

from auditspark.plans import catalog
from support import SMALL, same_as_sql

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(catalog.queries()[name](spark, SMALL), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["row_id", "attr", "pos", "tot", "risk"]
    assert df.count() == 4500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F

    from auditspark.sources import adapters as A

    df = A.txn_orders(spark, SMALL).where(F.col("row_id") > 5).groupBy("nation").agg(F.sum("amount").alias("s"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)" in plan or "GreaterThan(o_orderkey,5)" in plan
    assert "o_orderpriority" not in plan and "c_mktsegment" not in plan
