"""The corpus queries that SQL can express, against it on the smallest tables."""

import check
import pytest

from pixsieve.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.all_oracles()))
def test_query_matches_sql(spark, name):
    reason, n = check.compare(registry.all_queries()[name](spark, SF), check.connect(SF), registry.all_oracles()[name])
    assert reason is None and n > 0
