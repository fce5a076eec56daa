"""Every named query against its SQL, over whole tables."""

import pytest
from harness import compare, connect

from memlake import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()
# A small table may hold no such row; the comparison still has to agree.
MAY_BE_EMPTY = {"task_search", "index_sample", "code_prefilter", "find_units"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    problems = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows at all"]
    assert not problems, "\n".join(problems)
