"""Queries of this subpackage that SQL can express, against it."""

import pytest
from conftest import rows_of

from palisade.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_sql(name, spark, data, duck):
    got = registry.queries()[name](spark, data).toPandas()
    assert rows_of(got) == rows_of(duck.execute(registry.oracles()[name]).df())
