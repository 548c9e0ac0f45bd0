"""Correctness gate: every registered query with an oracle text equals its
DuckDB result at sf0.01 (row count, column types, exact values)."""

import pytest

from panelwise.plans.catalog import REGISTRY
from panelwise.plans.check import compare, duck_connection

from conftest import SF01

ORACLE = sorted(n for n, q in REGISTRY.items() if q.oracle)


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF01)


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, REGISTRY[name], SF01, con, verbose=False)
    assert res["status"] == "match", res


def test_every_query_names_its_operators():
    for q in REGISTRY.values():
        assert q.operators, q.name
