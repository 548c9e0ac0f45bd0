"""Queries with SQL equal DuckDB on whole tables."""

from types import SimpleNamespace

import pytest

from panelwise.llm.queries import ORACLES, QUERIES
from panelwise.plans.check import compare, duck_connection

SF01 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    found = compare(spark, name, SimpleNamespace(build=QUERIES[name], oracle=ORACLES[name]), SF01, duck_connection(SF01), verbose=False)
    assert found["status"] == "match", found


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
