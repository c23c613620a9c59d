"""The queries that SQL can express."""

from __future__ import annotations

import pytest

from auditspark.llm import queries as Q
from support import SMALL, same_as_sql


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(Q.queries()[name](spark, SMALL), duck, Q.oracle_sql()[name])


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
