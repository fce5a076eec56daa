"""Every query of the subpackage that has SQL, against it, over whole tables."""

import pytest
from harness import compare, connect

from memlake.llm import queries

QUERIES, ORACLES = queries.queries(), queries.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    problems = compare(spark, connect(sf_dir), QUERIES[name], ORACLES[name], sf_dir)
    assert not problems, "\n".join(problems)


def test_all_operators():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
