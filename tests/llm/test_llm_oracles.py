"""Queries of the training-data operators against their SQL."""

import pytest

from skein.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.llm.helpers import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    rows, problems = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert not problems
    assert rows > 0
