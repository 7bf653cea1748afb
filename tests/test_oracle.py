"""Every registered query of the library proper against its SQL on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry
from pixsieve.plans import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    reason, n = check.compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert reason is None
    # few parts: no signature of the smallest table is trimmed
    assert n > 0 or name == "sigdb_trim"


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["image_id", "n_blocks", "n_known", "n_user"]
    assert out.count() > 0
